"""Religion counts out of yearbook tables whose cells have been extracted: choice of the table, its header, its total.

``cells``: book, table_no, row_no, cells (array of strings), text (of the page). A book's tables
are read side by side; none of them, and no book, passes through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import RELIGION_HINT, canonical_religion, known_religion
from ..functions.nulls import computed
from ..functions.numbers import is_percent_table, percent_value, watermarked_count
from ..operators.grids import page_score
from ..operators.outline import numbered_level, outline, subtotals, top_sums
from .ingest import clean_label

#: What can come of a book, from best to worst: the best of its tables tells.
OUTCOMES = ["total", "sum of rows", "sum of top rows", "percent", "nested rows", "no figures", "no religions", "no table"]


def header_religion(cell: str | Column) -> Column:
    """Religion of a header cell: the first of its lines that names one, stray letters of a watermark dropped."""
    text = F.coalesce(F.col(cell) if isinstance(cell, str) else cell, F.lit(""))
    plain = lambda s: F.array_join(F.filter(F.split(s, r"\s+"), lambda w: F.length(w) >= 2), " ")
    named = F.transform(F.split(text, "\n"), lambda s: canonical_religion(F.regexp_replace(plain(s), "^[a-z](?=[A-Z])", "")))
    # cells without the letters of a religion, which most are, name nothing
    return F.when(text.rlike(RELIGION_HINT), F.coalesce(known_religion(text), F.try_element_at(F.filter(named, lambda r: r.isNotNull()), F.lit(1))))


def tables_with_figures(cells: DataFrame) -> DataFrame:
    """A row a table: book, table_no, score, is_percent, ``named`` (some cell names a religion or a total), ``rows`` that have figures.

    Rows are struct(row_no, printed, label, figures), figures struct(religion, count), below the header. Cells are read
    before the one shuffle; a table's rows, which its page bounds, meet in one row, so that nothing is joined.
    """
    table = ["book", "table_no"]
    label = F.coalesce(F.get("cells", F.lit(0)), F.lit(""))
    read = computed(cells, {"_roles": F.transform("cells", lambda c: header_religion(c)), "printed": label, "label": clean_label(label)})
    row = F.struct("row_no", F.col("_roles").alias("roles"), "printed", "label", "cells")
    tables = read.groupBy(*table).agg(F.array_sort(F.collect_list(F.when(F.col("cells").isNotNull(), row))).alias("_rows"), F.max(page_score(F.col("text"))).alias("score"))
    religion = lambda r: F.filter(r["roles"], lambda x: x.isNotNull() & (x != "total"))
    most = F.transform("_rows", lambda r: F.size(F.array_distinct(religion(r))))
    found = computed(tables, {"_n": most, "_all": F.flatten(F.transform("_rows", lambda r: r["cells"])), "named": F.exists("_rows", lambda r: F.exists(r["roles"], lambda x: x.isNotNull()))})
    found = computed(found.where(F.size("_all") > 0), {"is_percent": is_percent_table("_all"), "_head": F.when(F.array_max("_n") >= 2, F.get("_rows", F.array_position("_n", F.array_max("_n")).cast("int") - 1))}).drop("_n", "_all")
    at = F.filter(F.transform("_head.roles", lambda x, i: F.struct(i.alias("col"), x.alias("religion"))), lambda c: (c["col"] > 0) & c["religion"].isNotNull() & (c["religion"] != "total"))
    found = computed(found, {"_at": F.coalesce(at, F.expr("cast(array() as array<struct<col:int,religion:string>>)"))})
    value = lambda c: F.when(F.col("is_percent"), percent_value(c)).otherwise(watermarked_count(c))
    figures = lambda r: F.filter(F.transform("_at", lambda c: F.struct(c["religion"].alias("religion"), value(F.get(r["cells"], c["col"])).alias("count"))), lambda f: f["count"].isNotNull())
    body = F.transform(F.filter("_rows", lambda r: r["row_no"] > F.col("_head.row_no")), lambda r: F.struct(r["row_no"].alias("row_no"), r["printed"].alias("printed"), r["label"].alias("label"), figures(r).alias("figures")))
    body = F.filter(F.coalesce(body, F.slice(body, 1, 0)), lambda r: F.size(r["figures"]) > 0)
    return computed(found, {"rows": body}).select(*table, "score", "is_percent", "named", "rows")


def table_figures(cells: DataFrame) -> DataFrame:
    """Long rows of every table: book, table_no, row_no, label, printed label, religion, count, percent, and the table's page score.

    The header is the first of the rows that names most religions, two at least.
    """
    rows = tables_with_figures(cells).select("book", "table_no", "score", "is_percent", F.inline("rows"))
    return rows.select("book", "table_no", "score", "is_percent", "row_no", "printed", "label", F.inline("figures"))


def book_totals(cells: DataFrame, nested_sums: bool = False) -> DataFrame:
    """One outcome a book: book, outcome, religion, count; books without figures have a row of nulls.

    Of a book's tables the best outcome serves (``OUTCOMES``), then the higher page score, then the
    first. A count table gives its row labelled as a total, else the row that equals the sum of the
    others, else the sum of its rows. Where rows are numbered on two levels that would count twice: the table is told
    as nested, without figures; with ``nested_sums``, if every row of the first level equals the sum of the rows
    under it, these rows are added up. A percentage table gives the first row without a number whose shares add up to about 100.
    """
    table = ["book", "table_no"]
    add = lambda values: F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    summed = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in ("row_no", "printed", "label", "figures")], add(F.transform(r["figures"], lambda f: f["count"])).alias("all")))
    marked = computed(tables_with_figures(cells), {"rows": summed})
    marked = computed(marked, {"_sum": add(F.transform("rows", lambda r: r["all"])), "two": F.exists("rows", lambda r: r["printed"].rlike(r"^\s*\d{2}\.")) & F.exists("rows", lambda r: r["printed"].rlike(r"^\s*\d\."))})

    def kind(r: Column) -> Column:
        rest = F.col("_sum") - r["all"]
        return (
            F.when(F.col("is_percent"), F.when(r["all"].between(95, 105) & ~r["printed"].rlike(r"^\s*\d+\.?\s"), "percent"))
            .when(F.lower(r["label"]).rlike("^(jumlah|total)|(jumlah|total)$"), "total")
            .when((F.size("rows") >= 3) & (r["all"] > 0) & (F.abs(r["all"] - rest) <= 0.01 * r["all"]), "total")
        )

    told = F.filter(F.transform("rows", lambda r: F.struct(kind(r).alias("kind"), r["figures"].alias("figures"))), lambda r: r["kind"].isNotNull())
    every = F.flatten(F.transform("rows", lambda r: r["figures"]))
    marked = computed(marked, {"_printed": F.get(told, F.lit(0)), "_every": every})
    religions = F.array_distinct(F.transform("_every", lambda f: f["religion"]))
    sums = F.transform(religions, lambda g: F.struct(g.alias("religion"), add(F.transform(F.filter("_every", lambda f: f["religion"] == g), lambda f: f["count"])).alias("count")))
    open_ = ~F.col("is_percent") & F.col("_printed").isNull() & (F.size("rows") > 0)
    counts = F.when(F.col("_printed").isNotNull(), F.map_from_entries(F.col("_printed.figures"))).when(open_ & ~F.col("two"), F.map_from_entries(sums))
    outcome = F.coalesce(F.col("_printed.kind"), F.when(open_, F.when(F.col("two"), "nested rows").otherwise("sum of rows")))
    found = marked.select(*table, "score", "named", outcome.alias("outcome"), counts.alias("counts"))
    if nested_sums:
        rows = marked.where(open_ & F.col("two")).select(*table, "score", F.inline("rows"))
        long = rows.select(*table, "score", "row_no", numbered_level("printed").alias("level"), F.inline("figures"))
        depth = outline(long.select(*table, "row_no", "level").distinct(), table, "row_no", "level", 2)
        tops = top_sums(subtotals(long.join(depth.drop("level"), [*table, "row_no"]), [*table, "score"], "row_no", "religion", "count"), [*table, "score"], "level", "religion", "count")
        tops = tops.groupBy(*table, "score").agg(F.map_from_arrays(F.collect_list("religion"), F.collect_list("count")).alias("counts")).withColumns({"outcome": F.lit("sum of top rows"), "named": F.lit(True)})
        found = found.unionByName(tops.select(*found.columns))
    rank = F.array_position(F.array(*map(F.lit, OUTCOMES)), F.col("outcome"))
    order = F.when(F.col("outcome").isNotNull(), F.struct(rank.alias("rank"), (-F.col("score")).alias("score"), "table_no"))
    best = found.groupBy("book").agg(F.min_by(F.struct("outcome", "counts"), order).alias("_best"), F.bool_or("named").alias("_named"))
    outcome = F.coalesce(F.col("_best.outcome"), F.when(F.col("_named"), "no figures").otherwise("no religions"))
    return best.select("book", outcome.alias("outcome"), F.explode_outer("_best.counts").alias("religion", "count"))
