"""Tables that run over several pages: down the pages, and across two pages that face each other.

``cells``: book, page, table_no, row_no, cells (array of strings); ``text`` of the page may come along.
All books are joined in one plan; pages are chained by islands within a book, and whether two pages
belong together is a column of the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import norm_label
from ..functions.nulls import computed, let, yes
from ..functions.numbers import watermarked_count
from .ingest import clean_label
from .yearbook import header_religion

TABLE = ["book", "page", "table_no"]
#: Labels of a printed total, and rows that only number the columns.
TOTAL_LABEL, NUMBERING = r"^(jumlah|total)|(jumlah|total)$", r"^\s*(\(\d{1,2}\))?\s*$"


def _religions(cells: Column) -> Column:
    """Religion that each cell names as a header; null for none and for totals."""
    return F.transform(cells, lambda c: let(header_religion(c), lambda r: F.nullif(r, F.lit("total"))))


def _named(roles: Column) -> Column:
    return F.filter(roles, lambda r: r.isNotNull())


def gathered(cells: DataFrame) -> DataFrame:
    """A row a page: book, page and its ``tables``, struct(table_no, rows), rows struct(row_no, cells), both in order."""
    tables = cells.groupBy(*TABLE).agg(F.sort_array(F.collect_list(F.struct("row_no", "cells"))).alias("rows"))
    return tables.groupBy("book", "page").agg(F.sort_array(F.collect_list(F.struct("table_no", "rows"))).alias("tables"))


def _table(table: Column) -> Column:
    """A gathered table as struct(table_no, head, full, width, data, below); head is struct(cells, roles), roles a religion a column.

    The header is the first row that names three religions (``full``), else the first that names any, or none. ``below`` are the rows
    below it but for those that number columns. They are the table's data if the header is full; else ``data`` are, the rows with a
    label and figures that name no religion. Rows are struct(row_no, cells, label).
    """
    some = lambda c: F.coalesce(c, F.lit(""))
    figures = lambda r: F.exists(F.slice(r["cells"], 2, 10_000), lambda c: some(c).rlike(r"\d"))
    numbering = lambda r: F.forall(r["cells"], lambda c: some(c).rlike(NUMBERING)) | some(F.get(r["cells"], F.lit(0))).rlike(r"^\s*\(?\d\)?\s*$")
    slim = lambda rows: F.transform(rows, lambda r: F.struct(r["row_no"].alias("row_no"), r["cells"].alias("cells"), r["label"].alias("label")))

    def row(r: Column) -> Column:
        return let(_religions(r["cells"]), lambda roles: F.struct(
            r["row_no"].alias("row_no"), r["cells"].alias("cells"), roles.alias("roles"), clean_label(some(F.get(r["cells"], F.lit(0)))).alias("label"), F.size(F.array_distinct(_named(roles))).alias("n_roles")
        ))

    def read(rows: Column) -> Column:
        first = lambda n: F.get(F.filter(rows, lambda r: r["n_roles"] >= n), F.lit(0))
        return let(F.coalesce(first(3), first(1)), lambda head: parts(rows, head))

    def parts(rows: Column, head: Column) -> Column:
        full = yes(head["n_roles"] >= 3)
        below = F.when(head.isNotNull(), slim(F.filter(rows, lambda r: (r["row_no"] > head["row_no"]) & ~numbering(r))))
        plain = F.when(~full, slim(F.filter(rows, lambda r: (r["label"] != "") & figures(r) & (F.size(_named(F.slice(r["roles"], 2, 10_000))) == 0))))
        width = F.array_max(F.transform(rows, lambda r: F.size(r["cells"])))
        heading = F.when(head.isNotNull(), F.struct(head["cells"].alias("cells"), head["roles"].alias("roles")))
        return F.struct(table["table_no"].alias("table_no"), heading.alias("head"), full.alias("full"), width.alias("width"), plain.alias("data"), below.alias("below"))

    return let(F.transform(table["rows"], row), read)


def _chain_pages(pages: DataFrame, most: int, facing: bool = False) -> tuple[DataFrame, Window]:
    """Pages of chains, a row each, with the figures of their rows, and the order of a book's pages.

    With ``facing``, the tables with a header on the page after the chain's first come along.
    """
    pages = computed(pages, {"tables": F.transform("tables", _table)})
    data = lambda t: F.when(t["full"], t["below"]).otherwise(t["data"])
    # of the tables with a full header the longest counts, then the first
    ranks = F.transform("tables", lambda t, i: F.when(t["full"] & (F.size(t["below"]) > 0), F.struct(F.size(t["below"]).alias("n"), (-t["table_no"]).alias("at"), i.alias("i"))))
    some = F.exists("tables", lambda t: F.size(data(t)) > 0)
    pages = computed(pages, {"best": F.array_max(ranks)["i"], "some": some})
    pages = pages if facing else pages.where("some")
    heads = F.transform(F.filter("tables", lambda t: t["head"].isNotNull()), lambda t: F.struct(*[t[c].alias(c) for c in ("table_no", "head", "below")]))
    # every window has this one order, which ordinary columns keep, so pages are sorted once; what a chain needs of its pages lies within ``most`` rows
    order = Window.partitionBy("book").orderBy("page")
    before, earlier = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(min(1 - most, -1), -1)
    pages = pages.withColumn("own", F.get("tables", F.col("best"))["head"])
    # pages without rows part a chain like missing ones
    seen = {"last": F.last("own", True).over(before), "prev": F.lag(F.when(F.col("some"), F.col("page"))).over(order)}
    pages = pages.withColumns(seen | ({"next": F.lead(F.struct("page", heads.alias("heads"))).over(order)} if facing else {}))
    fitting = F.filter("tables", lambda t: ~t["full"] & (F.size(t["data"]) > 0) & (t["width"] == F.size(F.col("last.cells"))))
    same = F.when(F.col("own").isNotNull(), _named(F.col("own.roles")) == _named(F.col("last.roles"))).otherwise(F.size(fitting) > 0)
    held = F.when(F.col("own").isNotNull(), F.get("tables", F.col("best"))["below"]).otherwise(F.flatten(F.transform(fitting, lambda t: t["data"])))
    beside = {"facing": F.when(F.col("book").isNotNull() & (F.col("next.page") == F.col("page") + 1), F.col("next.heads"))} if facing else {}
    pages = pages.withColumns({"starts": ~yes((F.col("page") == F.col("prev") + 1) & same), "held": held} | beside).select("book", "page", "starts", "own", "held", *beside)
    pages = pages.withColumn("start", F.last(F.when(F.col("starts"), F.struct("page", "own")), True).over(order))
    pages = pages.where("start.own is not null").where(F.col("page") < F.col("start.page") + most)
    # the figures of the header's religions, for totals among the rows
    roles = F.col("start.own.roles")
    counted = lambda r: F.filter(F.transform(r["cells"], lambda c, i: F.when(F.get(roles, i).isNotNull(), watermarked_count(c))), lambda v: v.isNotNull())
    lines = F.transform("held", lambda r: F.struct(r["cells"].alias("cells"), r["label"].alias("label"), F.aggregate(counted(r), F.lit(0.0), lambda a, v: a + v).alias("all"), F.lower(r["label"]).rlike(TOTAL_LABEL).alias("total")))
    pages = pages.withColumns({"_start": F.col("start.page"), "header": F.col("start.own.cells"), "roles": roles, "lines": lines}).drop("starts", "own", "held", "start")
    pages = pages.withColumns({"sum": F.aggregate("lines", F.lit(0.0), lambda a, r: a + r["all"]), "n": F.size("lines")})
    pages = pages.withColumn("_earlier", F.collect_list(F.struct("_start", "sum", "n")).over(earlier))
    prior = F.aggregate(_mine(F.col("_earlier")), F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n")), lambda a, p: F.struct((a["sum"] + p["sum"]).alias("sum"), (a["n"] + p["n"]).alias("n")))
    pages = pages.withColumns({"prior": prior}).drop("_earlier")
    total = lambda a, r: r["total"] | ((a["n"] >= 2) & (r["all"] > 0) & (F.abs(r["all"] - a["sum"]) <= 0.01 * r["all"]))
    step = lambda a, r: F.struct((a["sum"] + r["all"]).alias("sum"), (a["n"] + 1).alias("n"), (a["ends"] | yes(total(a, r))).alias("ends"))
    ends = F.aggregate("lines", F.struct(F.col("prior.sum").alias("sum"), F.col("prior.n").alias("n"), F.lit(False).alias("ends")), step)["ends"]
    return pages.withColumns({"ends": ends}).drop("sum", "n"), order


def _mine(pages: Column) -> Column:
    return F.filter(pages, lambda p: p["_start"] == F.col("_start"))


def _last(after: Column) -> Column:
    """The page that ends a chain: the first that prints the total, else the last."""
    return F.coalesce(F.array_min(F.transform(F.filter(after, lambda p: p["ends"]), lambda p: p["page"])), F.array_max(F.transform(after, lambda p: p["page"])))


def chained(cells: DataFrame, most: int = 3) -> DataFrame:
    """Tables joined down their pages: book, page (where a table starts), pages, row_no, header, cells.

    A page continues the page before it if its table repeats the header's religions in order, or has
    no header and as many columns, up to ``most`` pages in all and not beyond the page that prints
    the total: a row labelled so, or one that adds up the rows before it. Of a page's tables the one
    with a header counts, the longest, then the first; without one, all of the same width together.
    """
    return chained_pages(gathered(cells), most)


def chained_pages(pages: DataFrame, most: int = 3) -> DataFrame:
    """``chained`` for gathered pages."""
    pages, order = _chain_pages(pages, most)
    of = F.collect_list(F.struct("_start", "page", "ends"))
    earlier, later = order.rowsBetween(min(1 - most, -1), -1), order.rowsBetween(0, max(most - 1, 0))
    pages = pages.withColumns({"_before": of.over(earlier), "_after": of.over(later)}).where(~F.exists(_mine(F.col("_before")), lambda p: p["ends"]))
    last = _last(_mine(F.col("_after")))
    out = pages.select("book", F.col("_start").alias("page"), (last - F.col("_start") + 1).cast("int").alias("pages"), F.col("prior.n").alias("_n"), "header", F.posexplode(F.transform("lines", lambda r: r["cells"])).alias("_at", "cells"))
    return out.select("book", "page", "pages", (F.col("_n") + F.col("_at") + 1).alias("row_no"), "header", "cells")


def _place(entries: Column, key: Column) -> Column:
    """Place of a key among entries that are sorted by it, by halving; null if it is not there."""
    half = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")
    step = lambda s, _: let(half(s), lambda m: F.when(F.get(entries, m)["key"] < key, F.struct((m + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), m.alias("high"))))
    halvings = F.array_repeat(F.lit(0), F.length(F.bin(F.size(entries))))
    low = F.aggregate(halvings, F.struct(F.lit(0).alias("low"), F.size(entries).alias("high")), step)["low"]
    return F.when(key.isNotNull(), let(low, lambda i: F.when(F.get(entries, i)["key"] == key, i)))


def _widened(tables: DataFrame, share: float, least: int) -> DataFrame:
    """``tables`` with the columns of the facing page in ``header`` and in the cells of ``lines``, and their ``pairs``.

    A row a table: header, roles, lines (struct(label, cells, ..)) and facing, the tables on the next page, or null. Labels are looked up in
    sorted arrays, so that a page's time hardly grows faster than its rows, and nothing is joined or shuffled.
    """
    key = lambda label: F.nullif(norm_label(label), F.lit(""))
    have = F.array_compact("roles")
    new = lambda t: F.filter(F.transform(t["head"]["roles"], lambda r, i: F.when(r.isNotNull() & ~F.array_contains(have, r), i)), lambda i: i.isNotNull())
    found = F.filter(F.transform("facing", lambda t: F.struct(*[t[c].alias(c) for c in ("table_no", "head", "below")], new(t).alias("new"))), lambda t: F.size(t["new"]) > 0)
    # a label that comes again has its last row
    once = lambda s: F.filter(s, lambda e, i: ~yes(F.get(s, i + 1)["key"] == e["key"]))
    entries = lambda t: let(F.sort_array(F.filter(F.transform(t["below"], lambda r: F.struct(key(r["label"]).alias("key"), r["row_no"].alias("row_no"), r["cells"].alias("cells"))), lambda e: e["key"].isNotNull())), once)
    tables = computed(tables, {"_found": F.transform(found, lambda t: F.struct(t["table_no"].alias("table_no"), t["head"]["cells"].alias("more"), t["new"].alias("new"), entries(t).alias("entries")))})
    tables = computed(tables, {"_keys": F.when(F.size("_found") > 0, F.transform("lines", lambda r: key(r["label"])))})
    tables = computed(tables, {"_places": F.transform("_found", lambda t: F.transform("_keys", lambda k: _place(t["entries"], k)))})
    n_rows = F.size("lines").cast("long")
    pair = lambda t, n: F.struct(t["table_no"].alias("table_no"), n_rows.alias("n_rows"), n.alias("n_matched"), (n >= F.greatest(F.lit(float(least)), share * n_rows)).alias("accepted"))
    pairs = F.transform("_found", lambda t, i: let(F.size(F.array_compact(F.get("_places", i))).cast("long"), lambda n: pair(t, n)))
    tables = computed(tables, {"pairs": pairs})
    ranks = F.transform("pairs", lambda p, i: F.when(p["accepted"], F.struct((-p["n_matched"]).alias("n"), p["table_no"].alias("table_no"), i.alias("i"))))
    tables = computed(tables, {"_best": F.array_min(ranks)["i"]})
    tables = tables.withColumns({"_one": F.get("_found", F.col("_best")), "_at": F.get("_places", F.col("_best"))})
    add = lambda of: F.transform("_one.new", lambda j: F.get(of, j))
    cells = lambda r, i: F.when(F.col("_best").isNotNull(), F.concat(r["cells"], add(F.get("_one.entries", F.get("_at", i))["cells"]))).otherwise(r["cells"])
    return tables.withColumns({
        "header": F.when(F.col("_best").isNotNull(), F.concat("header", add(F.col("_one.more")))).otherwise(F.col("header")),
        "lines": F.transform("lines", lambda r, i: r.withField("cells", cells(r, i))),
    }).drop("roles", "facing", "_found", "_keys", "_places", "_best", "_one", "_at")


def faced(pages: DataFrame, share: float = 0.6, least: int = 3, most: int = 3) -> DataFrame:
    """``facing_columns`` of the ``chained`` tables of gathered pages, read once: a row a table with book, page, pages, header, lines and pairs.

    Lines are an array of struct(cells, ..) in order, pairs one of struct(table_no, n_rows, n_matched, accepted), or null.
    """
    pages, order = _chain_pages(pages, most, facing=True)
    of = F.collect_list(F.struct("_start", "page", "ends", "lines"))
    tables = pages.withColumn("_after", of.over(order.rowsBetween(0, max(most - 1, 0)))).where("page = _start")
    tables = computed(tables, {"_after": _mine(F.col("_after"))})
    tables = computed(tables, {"_last": _last(F.col("_after"))})
    lines = F.flatten(F.transform(F.filter("_after", lambda p: p["page"] <= F.col("_last")), lambda p: p["lines"]))
    tables = tables.select("book", "page", (F.col("_last") - F.col("page") + 1).cast("int").alias("pages"), "header", "roles", lines.alias("lines"), "facing")
    return _widened(tables, share, least)


def facing_columns(tables: DataFrame, cells: DataFrame, share: float = 0.6, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """``tables`` (as ``chained`` gives them) with the further religions that the next page prints for the same rows, and the pairs.

    A pair of a table and a table of its next page is taken if that names religions which the first
    does not, and as many labels agree as the larger of ``least`` and ``share`` of its rows. Of several
    tables on that page the best match serves, then the first. The second result has a row a pair:
    book, page, table_no, n_rows, n_matched, accepted. A label that the next page repeats has its last row.
    """
    rest = [c for c in tables.columns if c not in ("book", "page", "header")]
    label = clean_label(F.coalesce(F.get("cells", F.lit(0)), F.lit("")))
    own = tables.groupBy("book", "page").agg(F.first("header").alias("header"), F.sort_array(F.collect_list(F.struct(*rest, label.alias("label")))).alias("lines"))
    read = computed(gathered(cells), {"facing": F.filter(F.transform("tables", _table), lambda t: t["head"].isNotNull())})
    wide = _widened(computed(own, {"roles": _religions(F.col("header"))}).join(read.select("book", (F.col("page") - 1).alias("page"), "facing"), ["book", "page"], "left"), share, least)
    out = wide.select("book", "page", "header", F.inline("lines")).select(*tables.columns)
    return out, wide.select("book", "page", F.inline("pairs"))


def joined_tables(cells: DataFrame) -> DataFrame:
    """Tables of all books, joined down and across pages, as ``yearbook.book_totals`` reads them: book, table_no, row_no, cells, text.

    ``cells`` has ``text`` as well; a table takes the text of the page where it starts, whose number is its own.
    """
    tables = faced(gathered(cells))
    printed = F.concat(F.array("header"), F.transform("lines", lambda r: r["cells"]))
    rows = tables.select("book", "page", F.posexplode(printed).alias("row_no", "cells"))
    texts = cells.groupBy("book", "page").agg(F.max("text").alias("text"))
    return rows.join(texts, ["book", "page"], "left").select("book", F.col("page").alias("table_no"), "row_no", "cells", "text")
