"""Semi-structured tables: HTML to grids, grids to long rows, JSON cubes, detector boxes."""

from __future__ import annotations

import html as _html
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


#: The spans that HTML allows at most; a page can't ask for more.
MOST_SPAN = {"colspan": 1000, "rowspan": 65_534}


class _Grids(HTMLParser):
    """Tables of a page as rectangular grids; spans repeat their text, outer tables that only wrap others go."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[dict] = []
        self.done: list[list[list[str]]] = []
        #: of each finished table, how many of its first rows are header rows
        self.heads: list[int] = []

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            if self.stack:
                self.stack[-1]["nested"] = True
            self.stack.append({"rows": [], "kinds": [], "cell": None, "nested": False, "thead": False})
        elif self.stack:
            own = self.stack[-1]
            if tag == "tr":
                self._close_cell()
                self._row(own)
            elif tag in ("thead", "tbody", "tfoot"):
                own["thead"] = tag == "thead"
            elif tag in ("td", "th"):
                self._close_cell()
                if not own["rows"]:
                    self._row(own)
                own["kinds"][-1].append(tag)
                span = {k: min(max(1, int(v)), MOST_SPAN[k]) if (v or "").isdecimal() and len(v) < 10 else 1 for k, v in attrs if k in MOST_SPAN}
                own["cell"] = ([], span.get("rowspan", 1), span.get("colspan", 1))
            elif tag == "br" and own["cell"]:
                own["cell"][0].append(" ")

    def handle_data(self, data):
        if self.stack and self.stack[-1]["cell"]:
            self.stack[-1]["cell"][0].append(data)

    def handle_endtag(self, tag):
        if not self.stack:
            return
        if tag in ("td", "th", "tr"):
            self._close_cell()
        elif tag == "thead":
            self.stack[-1]["thead"] = False
        elif tag == "table":
            self._close_cell()
            own = self.stack.pop()
            if not own["nested"] and own["rows"]:
                self.done.append(_rectangle(own["rows"]))
                head = [kinds[0] == "thead" or len(kinds) > 1 and "td" not in kinds for kinds in own["kinds"]]
                self.heads.append((head + [False]).index(False))

    @staticmethod
    def _row(own):
        own["rows"].append([])
        own["kinds"].append(["thead" if own["thead"] else "tbody"])

    def _close_cell(self):
        own = self.stack[-1]
        if own["cell"]:
            text, down, right = own["cell"]
            own["rows"][-1].append((" ".join("".join(text).split()), down, right))
            own["cell"] = None


def _rectangle(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """Lay cells with spans on a grid and fill short rows with blanks."""
    grid: list[dict[int, str]] = [{} for _ in rows]
    for y, row in enumerate(rows):
        x = 0
        for text, down, right in row:
            while x in grid[y]:
                x += 1
            for dy in range(min(down, len(rows) - y)):
                for dx in range(right):
                    grid[y + dy].setdefault(x + dx, text)
            x += right
    width = max((max(r, default=-1) + 1 for r in grid), default=0)
    return [[r.get(x, "") for x in range(width)] for r in grid]


def html_grids(page: str | None) -> list[list[list[str]]]:
    """Grids of a page, whose markup may be escaped as a whole."""
    return _parsed(page).done


def _parsed(page: str | None) -> _Grids:
    parser = _Grids()
    if page and "<table" not in page.lower() and "&lt;table" in page.lower():
        page = _html.unescape(page)
    parser.feed(page or "")
    parser.close()
    return parser


def column_names(head: list[list[str]], width: int) -> list[str]:
    """Names of columns under stacked header rows: the distinct texts down a column joined by `` | ``, ``col`` and its place where all are blank.

    A name that comes again is numbered from its second on.
    """
    seen: dict[str, int] = {}
    out = []
    for x in range(width):
        name = " | ".join(dict.fromkeys(row[x] for row in head if row[x])) or f"col{x}"
        out.append(f"{name}.{seen[name]}" if name in seen else name)
        seen[name] = seen.get(name, 0) + 1
    return out


def named_tables(page: str | None) -> list[tuple[int, list[str], list[list[str]]]]:
    """Tables of a page as (number, column names, body rows). Rows of a ``thead`` or of ``th`` alone on top are the header, else the first row."""
    parsed = _parsed(page)
    out = []
    for i, (grid, head) in enumerate(zip(parsed.done, parsed.heads, strict=True)):
        head = head or 1
        out.append((i, column_names(grid[:head], len(grid[0])), grid[head:]))
    return out


@F.udtf
class HtmlTables:
    """Table function over a page: ``html_tables(html)`` gives a row a table (table_idx, names, rows).

    With a second, constant argument, names of columns joined by ``;``, it gives a row for each body row: table_idx,
    row_idx and these columns as text, null where the table has none so called; tables that have none of them go.
    """

    @staticmethod
    def analyze(html: AnalyzeArgument, wanted: AnalyzeArgument | None = None) -> AnalyzeResult:
        if wanted is None:
            texts = ArrayType(StringType())
            return AnalyzeResult(StructType([StructField("table_idx", IntegerType()), StructField("names", texts), StructField("rows", ArrayType(texts))]))
        if not wanted.isConstantExpression or not wanted.value:
            raise ValueError("the names of the wanted columns must be a constant text")
        fields = [StructField(name, StringType()) for name in wanted.value.split(";")]
        return AnalyzeResult(StructType([StructField("table_idx", IntegerType()), StructField("row_idx", IntegerType()), *fields]))

    def eval(self, html, wanted=None):
        for i, names, rows in named_tables(html):
            if wanted is None:
                yield i, names, rows
                continue
            at = [names.index(name) if name in names else None for name in wanted.split(";")]
            if any(x is not None for x in at):
                for k, row in enumerate(rows):
                    yield i, k, *[None if x is None else row[x] for x in at]


def html_tables(pages: DataFrame, html: str, wanted: list[str] | None = None) -> DataFrame:
    """``pages`` joined laterally to their tables: the other columns, then what ``HtmlTables`` gives."""
    own = HtmlTables(F.col(html).outer(), F.lit(";".join(wanted))) if wanted else HtmlTables(F.col(html).outer())
    return pages.lateralJoin(own).drop(html)


@F.udf(ArrayType(ArrayType(ArrayType(StringType()))), useArrow=True)
def grids_of(page):
    """Column function of ``html_grids``; HTML can't be parsed by built-in functions."""
    return html_grids(page)


def grid_rows(pages: DataFrame, html: str) -> DataFrame:
    """One row a grid row: the other columns, table_idx, row_idx, cells."""
    rest = [c for c in pages.columns if c != html]
    tables = pages.select(*rest, F.posexplode(grids_of(html)).alias("table_idx", "_grid"))
    return tables.select(*rest, "table_idx", F.posexplode("_grid").alias("row_idx", "cells"))


def grid_to_long(rows: DataFrame, keys: list[str], role: Column, value: Column) -> DataFrame:
    """Long rows of grids whose header names categories.

    ``role`` maps column ``cell`` to a category or null, ``value`` maps it to a number. The
    header is the row with the most distinct categories, two at least (the first on ties);
    later rows give one long row for each category column; the first cell is the label.
    """
    from pyspark.sql import Window

    cells = rows.select(*keys, "table_idx", "row_idx", F.posexplode("cells").alias("col_idx", "cell"))
    table = [*keys, "table_idx"]
    roles = cells.withColumn("role", role)
    heads = roles.where("role is not null and role <> 'total'").groupBy(*table, "row_idx").agg(F.count_distinct("role").alias("_n")).where("_n >= 2")
    heads = heads.withColumn("_best", F.row_number().over(Window.partitionBy(*table).orderBy(F.desc("_n"), "row_idx"))).where("_best = 1")
    heads = heads.select(*table, F.col("row_idx").alias("_head"))
    columns = roles.where("role is not null").join(heads, table).where("row_idx = _head").select(*table, "_head", "col_idx", "role")
    labels = cells.where("col_idx = 0").select(*table, "row_idx", F.col("cell").alias("label"))
    body = cells.join(columns, [*table, "col_idx"]).where("row_idx > _head").withColumn("count", value)
    return body.join(labels, [*table, "row_idx"]).where("count is not null").select(*keys, "table_idx", "row_idx", "label", "role", "count")


#: The statistics office's dynamic cube: five axes of values and labels, and a map of cells.
CUBE = "struct<vervar:array<struct<val:string,label:string>>,var:array<struct<val:string,label:string>>,turvar:array<struct<val:string,label:string>>,tahun:array<struct<val:string,label:string>>,turtahun:array<struct<val:string,label:string>>,datacontent:map<string,double>>"


def axis_or(axis: str, val: str) -> Column:
    """An axis of a cube; where it is absent or empty, the one entry without a label that the cells' ids then hold."""
    return F.when(F.size(axis) > 0, F.col(axis)).otherwise(F.array(F.struct(F.lit(val).alias("val"), F.lit("").alias("label"))))


def cube_cells(cubes: DataFrame, column: str, ids: list[str] | None = None) -> DataFrame:
    """Cells of JSON cubes: the product of the axes, where the concatenated ids name a cell.

    Gives the other columns, the label of each axis, and the id (``<axis>_id``) of those in ``ids``.
    """
    rest = [c for c in cubes.columns if c != column]
    out = cubes.select(*rest, F.from_json(column, CUBE).alias("_c"))
    for axis, val in (("vervar", None), ("var", ""), ("turvar", "0"), ("tahun", None), ("turtahun", "0")):
        entries = F.col(f"_c.{axis}") if val is None else axis_or(f"_c.{axis}", val)
        out = out.withColumn(axis, F.explode(entries))
    key = F.concat(*[F.col(f"{a}.val") for a in ("vervar", "var", "turvar", "tahun", "turtahun")])
    out = out.withColumn("count", F.try_element_at("_c.datacontent", key)).where("count is not null")
    labels = [F.col(f"{a}.label").alias(a) for a in ("vervar", "var", "turvar", "tahun", "turtahun")]
    return out.select(*rest, *labels, *[F.col(f"{a}.val").alias(f"{a}_id") for a in ids or []], "count")


def merge_cubes(cubes: DataFrame, keys: list[str], axis: str, cells: str, order: str) -> DataFrame:
    """Cubes of one variable fetched in parts as one: years once each, cells of later parts on top."""
    entries = cubes.select(*keys, order, F.explode(F.map_entries(cells)).alias("_e"))
    last = entries.groupBy(*keys, F.col("_e.key").alias("_k")).agg(F.max_by("_e.value", order).alias("_v"))
    merged = last.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "_v")))).alias(cells))
    years = cubes.select(*keys, F.explode(axis).alias("_y")).groupBy(*keys).agg(F.array_sort(F.collect_set("_y")).alias(axis))
    return years.join(merged, keys)


def unpivot_counts(df: DataFrame, ids: list[str], columns: dict[str, str]) -> DataFrame:
    """Wide to long: a row for each named column, whose category is ``columns[name]``; null counts go."""
    pairs = [F.struct(F.lit(category).alias("category"), F.col(name).cast("double").alias("count")) for name, category in columns.items()]
    return df.select(*ids, F.inline(F.array(*pairs))).where("count is not null")


def match_boxes(first: Column, second: Column, least: float = 0.5) -> Column:
    """Boxes of two detectors as one list: pairs that overlap by ``least`` or more give the surer one.

    Boxes of the first are taken in order and get the best box of the second that is still free.
    Arrays of struct(text, conf, x0, y0, x1, y1).
    """
    def iou(a: Column, b: Column) -> Column:
        w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
        h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
        union = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - w * h
        return F.when(union > 0, w * h / union).otherwise(0.0)

    start = F.struct(second.alias("free"), F.slice(first, 1, 0).alias("out"))

    def step(state: Column, a: Column) -> Column:
        scored = F.transform(state["free"], lambda b, i: F.struct(iou(a, b).alias("s"), (-i).alias("i"), b.alias("b")))
        best = F.array_max(scored)
        hit = F.coalesce(best["s"] >= least, F.lit(False))
        free = F.when(hit, F.filter(state["free"], lambda _, i: i != -best["i"])).otherwise(state["free"])
        keep = F.when(hit & (best["b"]["conf"] > a["conf"]), best["b"]).otherwise(a)
        return F.struct(free.alias("free"), F.concat(state["out"], F.array(keep)).alias("out"))

    return F.aggregate(first, start, step, lambda s: F.concat(s["out"], s["free"]))


def page_score(text: Column) -> Column:
    """How likely a page holds the table: category words, titles, less contents pages and exclusions."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = ["islam", "protestan", "katolik", "hindu", "budha", "buddha", "konghucu"]
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    head = F.array_join(F.slice(F.split(low, "\n"), 1, 8), "\n")
    return (
        hits + F.when(low.rlike(r"(?s)(jumlah )?penduduk menurut.{0,80}agama|population by.{0,80}religion"), 4).when(low.rlike("agama|religion"), 2).otherwise(0)
        - F.when(head.rlike(r"tempat (ibadah|peribadatan)|places of worship|nikah|marriage"), 4).otherwise(0)
        - F.when(low.rlike(r"daftar (isi|tabel)|table of contents|\.{8,}"), 10).otherwise(0)
    )
