"""Printed tables of categories by unit, whatever their layout, as long rows.

A grid is one printed table: its cells stay in one row while header, layout and columns are settled by
array expressions, so that nothing is shuffled until the rows of tables are in long form. Layouts
read: categories across or down; a second header row; blocks of columns by year, by sex with or
without a total; sub-headings that tell the kind of unit; rows shifted to the left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import PROVINCES, canonical_religion, is_unit_name, norm_label, strip_tags, unit_key, unit_level, year_from_text
from ..functions.nulls import computed, let, yes
from ..functions.numbers import parse_count
from ..operators.grids import grids_of

# How headers of column blocks name the sexes and both together, over normalised labels. 'male' stands
# alone, so that a block headed 'Female' throughout is not taken for both.
BOTH_SEXES = r"jumlah|total|l\s*\+\s*p|laki.*perempuan|\bmale.*female|both"
ONE_SEX = r"laki|perempuan|\bmale|female|\bpria|wanita|l/p|\bl\b|\bp\b"
# Sub-headings that tell the kind of the units below them.
KINDS = {"kabupaten": r"^(kabupaten|kab|regency)(\s*/\s*regency)?$", "kota": r"^(kota|municipality|kota adm(inistrasi)?)(\s*/\s*municipality)?$"}
# Labels of rows that are no units: heads of label columns, shares and rates.
NO_UNIT = ["kabupaten/kota", "kabupaten", "kota", "wilayah", "daerah", "kecamatan", "no", "no."]
NO_COUNT = r"persen|%|rasio|rata rata|proporsi|share"
#: Name of the row that stands for the whole table's unit.
WHOLE = "__PROVINCE__"


def turned(grid: Column) -> Column:
    """A rectangular grid on its side."""
    width = F.greatest(F.coalesce(F.size(F.get(grid, F.lit(0))), F.lit(0)), F.lit(0))
    return F.transform(F.sequence(F.lit(0), width - 1), lambda j: F.transform(grid, lambda row: F.get(row, j)))


def _distinct(names: Column) -> Column:
    """How many categories a row of names holds; totals are none."""
    return F.size(F.array_distinct(F.filter(names, lambda n: n.isNotNull() & (n != "total"))))


def number_like(cell: Column) -> Column:
    """A count or number: no letters, since letter-spaced names are names."""
    return yes(parse_count(cell).isNotNull() & ~cell.rlike("[A-Za-z]"))


def _filled(cell: Column) -> Column:
    return yes(F.trim(cell) != "")


def kind_of(cell: Column) -> Column:
    """The kind of unit that a sub-heading announces, else null."""
    return let(norm_label(cell), lambda s: F.when(s.rlike(KINDS["kabupaten"]), "kabupaten").when(s.rlike(KINDS["kota"]), "kota"))


def oriented(tables: DataFrame, role) -> DataFrame:
    """``tables`` (``grid``) with the categories in a row: ``grid`` turned where a column names more of them; ``names`` (a category a cell) and ``head``.

    The header is the row with most distinct categories, two at least, the first on ties; other tables go.
    """
    named = computed(tables, {"names": F.transform("grid", lambda row: F.transform(row, role))})
    best = lambda m: F.array_max(F.transform(m, _distinct))
    side = computed(named.where(F.size("grid") > 0), {"_across": best(F.col("names")), "_down": best(turned(F.col("names")))})
    flip = F.col("_down") > F.col("_across")
    out = computed(side, {"grid": F.when(flip, turned(F.col("grid"))).otherwise(F.col("grid")), "names": F.when(flip, turned(F.col("names"))).otherwise(F.col("names"))})
    scores = F.transform("names", _distinct)
    return computed(out, {"head": F.array_position(scores, F.array_max(scores)).cast("int") - 1, "_most": F.array_max(scores)}).where("_most >= 2").drop("_across", "_down", "_most")


def header_columns() -> Column:
    """The category columns of an oriented table: struct(at, role, year, label), the label being what stands over the column.

    A blank header cell takes the name below it. A column's year is in its header, below it, or
    in a short cell of the two rows over it.
    """
    at = lambda m, i, j: F.get(F.get(m, i), j)
    head, grid, names = F.col("head"), F.col("grid"), F.col("names")

    def column(j: Column) -> Column:
        role = F.coalesce(at(names, head, j), at(names, head + 1, j))
        over = [F.when(yes(F.length(F.trim(at(grid, head - k, j))) <= 12) & at(names, head - k, j).isNull() & (head >= k), year_from_text(at(grid, head - k, j))) for k in (1, 2)]
        below = F.when(at(names, head + 1, j).isNull(), year_from_text(at(grid, head + 1, j)))
        label = F.array_join(F.array_compact(F.array(*[F.when(head >= k, norm_label(at(grid, head - k, j))) for k in (3, 2, 1)])), " ")
        return F.struct(j.alias("at"), role.alias("role"), F.coalesce(year_from_text(at(grid, head, j)), below, *over).alias("year"), label.alias("label"))

    return F.filter(F.transform(F.sequence(F.lit(0), F.size(F.get(grid, head)) - 1), column), lambda c: c["role"].isNotNull())


def blocks_of(columns: Column) -> Column:
    """Columns in blocks: a category that its block already has starts the next one."""
    empty = F.slice(columns, 1, 0)
    start = F.struct(F.slice(F.array(empty), 1, 0).alias("done"), empty.alias("now"))

    def step(state: Column, c: Column) -> Column:
        again = F.exists(state["now"], lambda x: x["role"] == c["role"])
        done = F.when(again, F.concat(state["done"], F.array(state["now"]))).otherwise(state["done"])
        return F.struct(done.alias("done"), F.when(again, F.array(c)).otherwise(F.concat(state["now"], F.array(c))).alias("now"))

    return F.aggregate(columns, start, step, lambda s: F.concat(s["done"], F.array(s["now"])))


def chosen_columns(columns: Column) -> Column:
    """What is read of a table's columns: struct(role, year, from), the figures of the columns ``from`` added up.

    Blocks that differ in year are all read. Else they are the sexes: the last block for both serves;
    if every block is labelled as one sex they are added up; else the last block, where totals are printed.
    """
    single = lambda cs: F.transform(cs, lambda c: F.struct(c["role"].alias("role"), c["year"].alias("year"), F.array(c["at"]).alias("from")))

    def choose(blocks: Column) -> Column:
        years = F.transform(blocks, lambda b: F.array_sort(F.array_distinct(F.transform(b, lambda c: F.coalesce(c["year"], F.lit(0))))))
        label = lambda b: F.array_join(F.transform(b, lambda c: c["label"]), " ")
        both = F.filter(blocks, lambda b: label(b).rlike(BOTH_SEXES))
        same = lambda role: F.flatten(F.transform(blocks, lambda b: F.transform(F.filter(b, lambda c: c["role"] == role), lambda c: c["at"])))
        added = F.transform(F.get(blocks, F.lit(0)), lambda c: F.struct(c["role"].alias("role"), c["year"].alias("year"), same(c["role"]).alias("from")))
        return (
            F.when((F.size(blocks) < 2) | (F.size(F.array_distinct(years)) > 1), single(F.flatten(blocks)))
            .when(F.size(both) > 0, single(F.element_at(both, -1)))
            .when(F.forall(blocks, lambda b: label(b).rlike(ONE_SEX)), added)
            .otherwise(single(F.element_at(blocks, -1)))
        )

    return F.when(F.size(columns) > 0, let(blocks_of(columns), choose))


def first_row() -> Column:
    """Where the figures start: below the header, and below a second header row: of years and texts, or without any number."""
    below = F.coalesce(F.get("grid", F.col("head") + 1), F.array(F.lit("")))
    year = lambda c: yes(F.trim(c).rlike(r"^(19|20)\d{2}(/\d{2,4})?$"))
    some = F.filter(below, _filled)
    second = (F.exists(some, year) & F.forall(some, lambda c: year(c) | ~number_like(c))) | ~F.exists(below, number_like)
    return F.col("head") + 1 + (second & ~F.exists(below, lambda c: kind_of(c).isNotNull())).cast("int")


def printed_tables(pages: DataFrame, html: str = "html", role=canonical_religion) -> DataFrame:
    """Long rows of the tables on ``pages`` (any columns; ``html``; ``province_code`` and ``year``, the title's, are used if there).

    Gives the other columns, table_idx, row_idx, unit_name, unit_key, level, religion, year, count. A
    printed dash is 0; cells without a number are null, rows without any figure go. So do notes, rows
    of years or shares, and totals of years other than the title's. Rows named as a total or as
    the province are ``__PROVINCE__``. Pages without a table, null and empty ones give no rows.
    """
    keep = [c for c in pages.columns if c != html]
    keys, year = [*keep, "table_idx"], F.col("year").cast("int") if "year" in keep else F.lit(None).cast("int")
    grids = pages.select(F.monotonically_increasing_id().alias("_page"), *keep, F.posexplode(grids_of(html)).alias("table_idx", "grid"))
    tables = computed(oriented(grids, role), {"_cols": header_columns(), "_from": first_row()}).where(F.size("_cols") > 0)
    tables = computed(tables, {"_read": chosen_columns(F.col("_cols")), "_first": F.array_min(F.transform("_cols", lambda c: c["at"])), "_width": F.size(F.get("grid", F.col("head")))})
    rows = tables.select("_page", *keys, "_read", "_first", "_width", "_from", F.posexplode("grid").alias("row_idx", "cells")).where("row_idx >= _from")
    # a row that lacks the cells on the left of its label is moved to the right, under the header
    last = F.array_max(F.transform("cells", lambda c, i: F.when(_filled(c), i + 1).otherwise(0)))
    short = (last < F.col("_width")) & (F.col("_first") >= 2) & (last >= 2) & _filled(F.get("cells", F.lit(0))) & ~number_like(F.get("cells", F.lit(0))) & number_like(F.get("cells", F.lit(1)))
    moved = F.concat(F.array_repeat(F.lit(""), (F.col("_width") - last).cast("int")), F.slice("cells", 1, F.greatest(last, F.lit(0))))
    rows = computed(rows, {"cells": F.when(short, moved).otherwise(F.col("cells"))})
    name = F.get(F.filter("cells", lambda c: _filled(c) & ~number_like(c)), F.lit(0))
    rows = computed(rows, {"_name": F.trim(strip_tags(name))}).where("_name is not null")
    rows = computed(rows, {"_label": norm_label("_name"), "_kind": kind_of(F.col("_name")), "_level": unit_level("_name"), "_role": role(F.col("_name")), "_year": year_from_text("_name")})
    above = Window.partitionBy("_page", "table_idx").orderBy("row_idx").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_above", F.last("_kind", True).over(above)).where("_kind is null")
    total = F.col("_label").rlike("jumlah|total")
    rows = rows.where(is_unit_name("_name") & ~F.col("_label").isin(NO_UNIT) & yes(F.col("_role").isNull() | (F.col("_role") == "total")) & ~F.col("_label").rlike(NO_COUNT))
    rows = rows.where(~yes(total & (F.col("_year") != year)))
    number = lambda js: F.filter(F.transform(js, lambda j: parse_count(F.get("cells", j), True)), lambda v: v.isNotNull())
    value = lambda js: let(number(js), lambda vs: F.when(F.size(vs) > 0, F.aggregate(vs, F.lit(0.0), lambda a, v: a + v)))
    rows = computed(rows, {"_values": F.transform("_read", lambda c: F.struct(c["role"].alias("religion"), F.coalesce(c["year"], year).alias("year"), value(c["from"]).alias("count")))})
    known = F.filter(F.transform("_values", lambda v: v["count"]), lambda n: n.isNotNull())
    years = (F.size(known) >= 2) & F.forall(known, lambda n: n.between(1990, 2035) & (n == F.floor(n)))
    rows = rows.where((F.size(known) > 0) & ~years)
    plain = F.replace(F.col("_label"), F.lit(" "), F.lit(""))
    province = F.create_map(*[F.lit(x) for code, p in PROVINCES.items() for x in (code, p.lower().replace(" ", ""))])
    own = yes(plain == F.try_element_at(province, F.col("province_code").cast("string"))) if "province_code" in keep else F.lit(False)
    whole = own | F.col("_label").rlike("^(provinsi|jumlah|total)")
    level = F.when(F.col("_level") != "unknown", F.col("_level")).otherwise(F.coalesce("_above", F.lit("unknown")))
    out = rows.select(
        *[c for c in keep if c != "year"], "table_idx", "row_idx", F.when(whole, WHOLE).otherwise(F.col("_name")).alias("unit_name"), unit_key("_name").alias("_key"), level.alias("level"), F.inline("_values")
    )
    return out.withColumn("unit_key", F.when(F.col("unit_name") != WHOLE, F.col("_key"))).drop("_key")
