"""Tables out of words placed on pages: lines by height, columns by the nearest header centre.

``words`` has one row a word: the columns that name its page, ``text``, ``x0``, ``x1``, ``top``; ``pages`` one row
a page, with its words as an array. A page is read in one row, which the page bounds, and meets no other. Words
without a page, a text or a place are left out.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import computed, let

WORD = ("text", "x0", "x1", "top")


def line_starts(tops: Column, tolerance: float) -> Column:
    """Places (from 0) in a page's heights, an ascending array, at which its lines start.

    A line starts at the highest word that no line holds, and holds the words that start within
    ``tolerance`` points of it: a line is measured from its first word, so a slope can't join two lines.
    """
    top = lambda i: F.get(tops, i)
    size = F.size(tops)
    far = F.filter(F.sequence(F.lit(0), size - 1), lambda i: (i == 0) | (top(i) - top(i - 1) > tolerance))
    islands = let(far, lambda starts: F.transform(starts, lambda s, k: F.struct(s.alias("first"), (F.coalesce(F.get(starts, k + 1), size) - 1).alias("last"))))
    # an island no higher than the tolerance is a line; a longer one is cut from its first word on
    cut = lambda found, i: F.when(top(i) - top(F.element_at(found, -1)) > tolerance, F.concat(found, F.array(i))).otherwise(found)
    flat = lambda s: top(s["last"]) - top(s["first"]) <= tolerance
    return F.flatten(F.transform(islands, lambda s: F.when(flat(s), F.array(s["first"])).otherwise(F.aggregate(F.sequence(s["first"], s["last"]), F.array(s["first"]), cut))))


def _parts(items: str, starts: str) -> Column:
    """An array cut at its ``starts``. Items are taken one by one: a slice reads all of the array each time."""
    return F.transform(starts, lambda s, k: F.transform(F.sequence(s, F.coalesce(F.get(starts, k + 1), F.size(items)) - 1), lambda i: F.get(items, i)))


def lines_of(words: DataFrame, page: list[str], tolerance: float = 3.0) -> DataFrame:
    """``words`` with ``line``, counted from 0 down the page."""
    sound = words.dropna(subset=[*page, *WORD])
    heights = sound.groupBy(*page).agg(F.sort_array(F.collect_set(F.col("top").cast("double"))).alias("_tops"))
    heights = computed(heights, {"_starts": line_starts(F.col("_tops"), tolerance)})
    lines = heights.select(*page, F.posexplode(_parts("_tops", "_starts")).alias("line", "_tops")).select(*page, "line", F.explode("_tops").alias("_top"))
    return sound.withColumn("_top", F.col("top").cast("double")).join(lines, [*page, "_top"]).drop("_top")


def nearest(centres: Column, at: Column) -> Column:
    """Place (from 1) of the centre, of an array of them, next to ``at``; the first on ties."""
    return let(F.transform(centres, lambda c: F.abs(c - at)), lambda far: F.array_position(far, F.array_min(far))).cast("int")


def rows_of_pages(pages: DataFrame, page: list[str], role: Callable[[Column], Column], least: int = 3, tolerance: float = 3.0, heading: str = "label", words: str = "words") -> DataFrame:
    """Rows of the table on each page, whose ``words`` are an array of struct(text, x0, x1, top): the page, row_no (its line), cells.

    The header comes first, as ``heading`` and the roles. It is the line whose words of four letters or
    more name most distinct roles, ``least`` at least (the first on ties); totals don't count. A role's
    column is where it is named first. Below the header, words left of the first column by half the
    distance of the first two are the label, the others go to the nearest column. Rows without a label
    or without figures are left out, and so are pages without a header.
    """
    kinds = {f.name: f.dataType.typeName() for f in pages.schema[words].dataType.elementType.fields}
    sound = lambda w: reduce(and_, [w[c].isNotNull() & ~F.isnan(w[c]) if kinds[c] in ("float", "double") else w[c].isNotNull() for c in WORD])
    word = lambda w: F.struct(w["top"].cast("double").alias("top"), w["x0"].alias("x0"), w["text"].alias("text"), ((w["x0"] + w["x1"]) / 2).alias("mid"))
    own = computed(pages.dropna(subset=page).select(*page, words), {"_words": F.sort_array(F.transform(F.filter(words, sound), word))}).drop(words).where(F.size("_words") > 0)
    own = computed(own, {"_tops": F.transform("_words", lambda w: w["top"])})
    own = computed(own, {"_starts": line_starts(F.col("_tops"), tolerance)}).drop("_tops")
    own = computed(own, {"_lines": _parts("_words", "_starts")}).drop("_words", "_starts")
    # a line of fewer long words than ``least`` can't name as many roles, so few words are asked for theirs
    named = lambda ws: F.filter(F.transform(ws, lambda w: F.struct(role(w["text"]).alias("role"), w["x0"].alias("x0"), w["mid"].alias("mid"))), lambda r: r["role"].isNotNull() & (r["role"] != "total"))
    own = computed(own, {"_named": F.transform("_lines", lambda ws: let(F.filter(ws, lambda w: F.length(w["text"]) >= 4), lambda ws: F.when(F.size(ws) >= least, named(ws))))})
    roles = lambda ws: F.array_distinct(F.transform(ws, lambda w: w["role"]))
    rank = lambda ws, k: F.when(ws.isNotNull(), let(F.size(roles(ws)), lambda n: F.when(n >= max(least, 1), F.struct(n.alias("n"), (-k).alias("at")))))
    own = computed(own, {"_best": F.array_max(F.transform("_named", rank))}).where("_best is not null")
    own = computed(own, {"_head": -F.col("_best.at"), "_heads": F.get("_named", -F.col("_best.at"))}).drop("_best", "_named")
    centre = lambda r: F.array_min(F.transform(F.filter("_heads", lambda w: w["role"] == r), lambda w: F.struct(w["x0"], w["mid"].alias("mid"))))["mid"]
    own = computed(own, {"_cols": F.array_sort(F.transform(roles(F.col("_heads")), lambda r: F.struct(centre(r).alias("centre"), r.alias("role"))))}).drop("_heads")
    # with one column there is no distance to halve: labels end where the column's middle is
    width = F.coalesce(F.get("_cols", F.lit(1))["centre"] - F.get("_cols", F.lit(0))["centre"], F.lit(0.0))
    own = computed(own, {"_left": F.get("_cols", F.lit(0))["centre"] - width / 2})
    body = own.select(*page, "_head", "_cols", "_left", F.transform("_cols", lambda c: c["centre"]).alias("_centres"), F.posexplode("_lines").alias("row_no", "_words")).where("row_no >= _head")
    place = lambda w: F.when(w["mid"] < F.col("_left"), F.lit(0)).otherwise(nearest(F.col("_centres"), w["mid"]))
    body = computed(body, {"_words": F.sort_array(F.transform("_words", lambda w: F.struct(place(w).alias("place"), w["x0"].alias("x0"), w["text"].alias("text"))))})
    body = body.where((F.col("row_no") == F.col("_head")) | (F.get("_words", F.lit(0))["place"] == 0) & (F.element_at("_words", -1)["place"] > 0))
    filled = F.transform(F.sequence(F.lit(0), F.size("_cols")), lambda i: F.array_join(F.transform(F.filter("_words", lambda w: w["place"] == i), lambda w: w["text"]), " "))
    header = F.concat(F.array(F.lit(heading)), F.transform("_cols", lambda c: c["role"]))
    return body.select(*page, "row_no", F.when(F.col("row_no") == F.col("_head"), header).otherwise(filled).alias("cells"))


def rows_of_words(words: DataFrame, page: list[str], role: Callable[[Column], Column], least: int = 3, tolerance: float = 3.0, heading: str = "label") -> DataFrame:
    """Rows of the table on each page, as ``rows_of_pages`` gives them, of words that come a row each: a page's words meet in one row once."""
    pages = words.dropna(subset=[*page, *WORD]).groupBy(*page).agg(F.collect_list(F.struct(*WORD)).alias("words"))
    return rows_of_pages(pages, page, role, least, tolerance, heading)
