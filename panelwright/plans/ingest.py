"""From published tables to the long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import PROVINCES, canonical_nationality, canonical_permit, header_role, is_unit_name, norm_kanim, norm_label, norm_unit_name, strip_tags, year_from_text
from ..functions.nulls import computed, yes
from ..functions.numbers import parse_count, unit_scale
from ..operators.grids import CUBE, axis_or, cube_cells, html_tables, unpivot_counts
from ..operators.relational import equals_rest, first_per_key
from ..sources.readers import roles_of
from .printed import WHOLE, printed_tables

#: What header a column of an open-data file plays its role under.
ROLES = {"nationality": r"negara|kebangsaan|warga|nationality|country", "region": r"provinsi|kabupaten|kota|wilayah|region|kanim|kantor", "permit": r"izin|ijin|permit|jenis", "year": r"tahun|year", "count": r"jumlah|total|count|orang|nilai"}


def religion_tables(pages: DataFrame) -> DataFrame:
    """Religion counts of HTML tables (``ref``, ``html``, and ``province_code`` and ``year`` if known): ref, table_idx, row_idx, unit_name, unit_key, level, religion, year, count."""
    keep = [c for c in ("ref", "province_code", "year") if c in pages.columns]
    return printed_tables(pages.select(*keep, "html")).where("count is not null")


def foreign_tables(pages: DataFrame) -> DataFrame:
    """Foreign residents of HTML tables, nations across or down: ref, table_idx, nationality, permit_type, year, region_name, region_level, other_label, count.

    Nations lie on the axis that names more of them, the first column on ties; a table needs two. The other axis
    tells permit, year or immigration office; plain labels beside nations in the header are districts.
    A total is one of nations on their axis, one of permits on the other. What a table doesn't tell comes from
    ``year`` and ``province_code`` of the page, if there.
    """
    has = lambda c: F.col(c).cast("string") if c in pages.columns else F.lit(None).cast("string")
    tables = html_tables(pages.select("ref", has("province_code").alias("_province"), has("year").cast("int").alias("_year"), "html"), "html")
    tables = tables.where((F.size("names") >= 2) & (F.size("rows") > 0))
    tables = computed(tables, {"_cols": F.transform(F.slice("names", 2, 10_000), header_role), "_rows": F.transform("rows", lambda r: header_role(F.get(r, F.lit(0))))})
    nations = lambda roles: F.size(F.filter(roles, lambda r: r["role"] == "nationality"))
    tables = tables.withColumns({"_across": nations("_cols"), "_down": nations("_rows")}).where(F.greatest("_across", "_down") >= 2)
    cell = lambda r, i: F.transform(F.slice(r, 2, 10_000), lambda c, j: F.struct(i.alias("i"), j.alias("j"), c.alias("cell")))
    cells = tables.select("ref", "table_idx", "_province", "_year", "_cols", "_rows", "names", (F.col("_down") >= F.col("_across")).alias("_by_row"), F.col("rows").alias("_grid"), F.inline(F.flatten(F.transform("rows", cell))))
    row, col = F.get("_rows", F.col("i")), F.get("_cols", F.col("j"))
    label, name = F.get(F.get("_grid", F.col("i")), F.lit(0)), F.get("names", F.col("j") + 1)
    pick = lambda x, y: F.when(F.col("_by_row"), x).otherwise(y)
    own, other = pick(row, col), pick(col, row)
    rows = cells.select("ref", "table_idx", "_province", "_year", "_by_row", own.alias("own"), other.alias("other"), pick(name, label).alias("other_label"), parse_count("cell").alias("count"))
    rows = rows.withColumn("nationality", F.when(F.col("own.role") == "total", "TOTAL").when(F.col("own.role") == "nationality", F.col("own.value"))).where("nationality is not null and count is not null")
    role, value = F.col("other.role"), F.col("other.value")
    district = (role == "other") & ~F.col("_by_row")
    names = F.create_map(*[F.lit(x) for pair in PROVINCES.items() for x in pair])
    return rows.select(
        "ref", "table_idx", "nationality", F.when(role == "permit", value).when(role == "total", "TOTAL").alias("permit_type"),
        F.when(role == "year", value.try_cast("int")).otherwise(F.col("_year")).alias("year"),
        F.when(role == "kanim", norm_kanim(value)).when(district, F.trim("other_label")).otherwise(F.coalesce(F.try_element_at(names, F.col("_province")), F.col("_province"))).alias("region_name"),
        F.when(role == "kanim", "kanim").when(district, "kabupaten").otherwise("province").alias("region_level"), "other_label", "count",
    )


def open_data_to_long(df: DataFrame, source: str) -> DataFrame:
    """An open-data table with a nation column, or with nations as columns, as long rows."""
    roles = roles_of(df.columns, {k: ROLES[k] for k in ("nationality", "region", "permit", "year", "count")})
    col = lambda k, t="string": F.col(f"`{roles[k]}`").cast(t) if roles[k] else F.lit(None).cast(t)
    fixed = [F.lit(source).alias("source"), F.coalesce(col("region"), F.lit("NATIONAL")).alias("region_name"), canonical_permit(col("permit")).alias("permit_type"), year_from_text(col("year")).alias("year")]
    if roles["nationality"] and roles["count"]:
        return df.select(*fixed, canonical_nationality(col("nationality")).alias("nationality"), parse_count(col("count")).alias("count")).where("nationality is not null and count is not null")
    # the header names nations: their codes come from the same column function, over the header's few labels
    spark = df.sparkSession
    named = spark.createDataFrame([(c,) for c in df.columns], "c string").select("c", canonical_nationality("c").alias("n")).where("n is not null").collect()
    wide = df.select(*fixed, *[parse_count(F.col(f"`{r['c']}`")).alias(r["c"]) for r in named])
    return unpivot_counts(wide, ["source", "region_name", "permit_type", "year"], {r["c"]: r["n"] for r in named}).withColumnRenamed("category", "nationality")


def dynamic_counts(cubes: DataFrame, column: str, category: Column) -> DataFrame:
    """Cells of the office's cubes with a unit code from the label's first four digits, a category and a year."""
    out = cube_cells(cubes, column)
    code = F.nullif(F.regexp_extract("vervar", r"^(\d{4})\b", 1), F.lit(""))
    return out.withColumns({"unit_code": code, "category": category, "year": F.col("tahun").try_cast("int")}).where("category is not null")


#: A category for both sexes together, and each sex, over normalised labels.
ALL_PERSONS, SEXES = r"^(jumlah|total|laki[ -]?laki\s*(\+|dan)\s*perempuan|l\s*\+\s*p)\b", [r"^laki", r"^perempuan|^wanita"]


def population_of(cubes: DataFrame, column: str) -> DataFrame:
    """Persons by unit and year, cube by cube: ``cubes``' other columns (its reference among them), unit_code, unit_name, year, population.

    A cube with one category is taken as it is, one with several by its total, the first in the cube's order, or, where it
    has just the two sexes, by their sum, of units that have both; other splits give nothing. Rows of
    whole provinces, named so or with a code that ends in 00, are left out; the name of another
    province than the cube's ``province_code`` is one too. Units without a code keep their names. Figures
    in thousands or millions, as ``unit``, if there, or the variable's label says, are scaled.
    """
    keep = [c for c in cubes.columns if c != column]
    own = computed(cubes, {"_axis": F.from_json(column, CUBE)["turvar"]})
    own = computed(own, {"_axis": axis_or("_axis", "0")})
    sexes = F.transform("_axis", lambda v: norm_label(v["label"]))
    at = lambda p: F.get(F.transform(F.filter(F.transform(sexes, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda x: x["s"].rlike(p)), lambda x: x["i"]), F.lit(0))
    both = (F.size(sexes) == 2) & at(SEXES[0]).isNotNull() & at(SEXES[1]).isNotNull() & (at(SEXES[0]) != at(SEXES[1]))
    total = F.coalesce(at(ALL_PERSONS), F.lit(0))
    parts = F.when((F.size("_axis") == 1) | at(ALL_PERSONS).isNotNull(), F.array(F.get("_axis", total)["val"])).when(both, F.transform("_axis", lambda v: v["val"]))
    own = computed(own.withColumn("_cube", F.monotonically_increasing_id()), {"_parts": parts}).drop("_axis").where("_parts is not null")
    rows = cube_cells(own, column, ids=["turvar"]).where(F.array_contains("_parts", F.col("turvar_id")))
    region = F.trim(strip_tags("vervar"))
    rows = computed(rows, {"unit_name": region, "_code": F.nullif(F.regexp_extract(region, r"^(\d{4})\s+\S", 1), F.lit("")), "_name": F.regexp_replace(norm_label(region), r"^\d+\s*", "")})
    names = F.create_map(*[F.lit(x) for code, p in PROVINCES.items() for x in (p.lower().replace(" ", ""), code)])
    named = F.try_element_at(names, F.replace("_name", F.lit(" "), F.lit("")))
    whole = F.col("_name").rlike("^provinsi") | F.col("_name").isin("jumlah", "total") | F.col("_code").endswith("00") | (named.isNotNull() if "province_code" in keep else F.lit(False))
    rows = rows.where(is_unit_name("unit_name") & ~F.coalesce(whole, F.lit(False)))
    unit = F.coalesce(F.col("unit"), F.lit("")) if "unit" in keep else F.lit("")
    sums = rows.groupBy("_cube", *keep, "_code", "unit_name", "var", year_from_text("tahun").alias("year"), "turtahun", F.size("_parts").alias("_n")).agg(F.sum("count").alias("_sum"), F.count_distinct("turvar_id").alias("_have"))
    out = sums.where("_have = _n")
    return out.select(*keep, F.col("_code").alias("unit_code"), "unit_name", "year", (F.col("_sum") * unit_scale(unit, F.col("var"))).alias("population"))


def domain_rows(rows: DataFrame, table: list[str], unit: str, title: str | None = None) -> DataFrame:
    """The tables of a district's own domain: a row a category for the district, and its parts beside it.

    ``rows``: the columns that name a table, year, ``unit``, religion, count, and ``title``, the district's name. A
    table's total is, in this order: the rows labelled as total; of each year the units within 3 % of the
    largest, if that equals the sum of the others (three units at least, on the category with the
    largest sum); the unit that bears the district's name, if it has the largest figures, half as much again as the
    second largest; else the sum of the parts. Of several rows the largest serves. Gives the table, year, unit,
    religion, count, level (kabupaten or kecamatan) and ``how``.
    """
    keys = [*table, "year"]
    over = Window.partitionBy
    t, y = over(*table), over(*keys)
    # every step is a window within a table, so tables dealt once are neither shuffled nor joined again
    d = rows.dropDuplicates([*keys, unit, "religion", "count"])
    d = d.withColumn("_label", yes(norm_label(unit).rlike("^(jumlah|total)") | (F.col(unit) == WHOLE)))
    # a unit's figure of a category and year, on one of its rows
    own = over(*keys, "religion", unit)
    d = d.withColumns({"_one": F.row_number().over(own.orderBy("count")) == 1, "_v": F.sum("count").over(own)}).withColumn("_v", F.when(F.col("_one"), F.col("_v")))
    # printed sums, year by year
    d = d.withColumn("_all", F.sum("_v").over(over(*keys, "religion")))
    d = d.withColumn("_top", F.dense_rank().over(y.orderBy(F.desc_nulls_last("_all"), F.asc("religion"))) == 1)
    d = d.withColumn("_t", F.when(F.col("_top"), F.col("_v"))).withColumns({"_n": F.count("_t").over(y), "_max": F.max("_t").over(y)})
    d = d.withColumn("_near", yes(F.col("_t") >= 0.97 * F.col("_max")))
    d = d.withColumns({"_rest": F.sum(F.when(F.col("_top") & F.col("_one"), F.when(~F.col("_near"), F.col("_t")).otherwise(0.0))).over(y), "_k": F.count_if("_near").over(y)})
    equal = F.col("_near") & (F.col("_n") >= 3) & (F.col("_max") > 0) & (F.col("_k") < F.col("_n")) & (F.abs(F.col("_max") - F.col("_rest")) <= 0.01 * F.greatest("_max", "_rest"))
    d = d.withColumn("_equal", F.max(yes(equal)).over(over(*keys, unit))).drop("_all", "_top", "_t", "_n", "_max", "_near", "_rest", "_k", "_one")
    # a name that dominates, over all years
    d = d.withColumn("_every", F.sum("_v").over(over(*table, "religion")))
    d = d.withColumn("_big", F.dense_rank().over(t.orderBy(F.desc_nulls_last("_every"), F.asc("religion"))) == 1)
    each = over(*table, unit)
    d = d.withColumns({"_one": F.row_number().over(each.orderBy("count")) == 1, "_size": F.sum(F.when(F.col("_big"), F.col("_v"))).over(each)}).withColumn("_size", F.when(F.col("_one"), F.col("_size")))
    d = d.withColumn("_rank", F.row_number().over(t.orderBy(F.desc_nulls_last("_size"), F.asc(unit))))
    at = lambda n, c: F.max(F.when(F.col("_rank") == n, F.col(c))).over(t)
    d = d.withColumns({"_s1": at(1, "_size"), "_s2": at(2, "_size"), "_u1": at(1, unit), "_u2": at(2, unit)})
    named = F.when(F.col("_s1") > F.col("_s2"), F.col("_u1")).otherwise(F.greatest("_u1", "_u2"))
    d = d.withColumn("_first", yes(F.col("_s1") >= 1.5 * F.col("_s2")) & F.col(unit).eqNullSafe(named)).drop("_v", "_every", "_big", "_one", "_size", "_rank", "_s1", "_s2", "_u1", "_u2")
    if title:
        name, own_name = norm_unit_name(title), norm_unit_name(unit)
        d = d.withColumn("_first", yes(F.col("_first") & ((own_name == name) | (F.regexp_replace(own_name, r"\s+(19|20)\d\d$", "") == name))))
    else:
        d = d.withColumn("_first", F.lit(False))
    kind = F.when(F.max("_label").over(t), F.when(F.col("_label"), "label")).when(F.max("_equal").over(t), F.when(F.col("_equal"), "equals rest")).when(F.col("_first"), "name")
    d = d.withColumn("how", kind).withColumn("_any", F.max(F.col("how").isNotNull()).over(t))
    d = d.withColumn("_name", F.col(title) if title else F.concat_ws(" ", *[F.col(c).cast("string") for c in table]))
    # a row stands for itself, as a total or a part; the first of a category's parts without a total for their sum too
    d = d.withColumn("_place", F.row_number().over(over(*keys, "religion").orderBy(F.col("how").isNull(), F.desc_nulls_last("count"), F.asc(unit))))
    sums = over(*keys, "religion", "_name")
    d = d.withColumns({"_one": F.row_number().over(sums.orderBy(F.desc_nulls_last("count"))) == 1, "_sum": F.sum("count").over(sums)})
    row = lambda u, c, level, how: F.struct(u.alias(unit), c.alias("count"), F.lit(level).alias("level"), how.cast("string").alias("how"))
    own = F.when(F.col("how").isNull(), row(F.col(unit), F.col("count"), "kecamatan", F.lit(None))).when(F.col("_place") == 1, row(F.col("_name"), F.col("count"), "kabupaten", F.col("how")))
    summed = F.when(~F.col("_any") & F.col("_one") & F.col("count").isNotNull(), row(F.col("_name"), F.col("_sum"), "kabupaten", F.lit("sum")))
    out = d.select(*keys, "religion", F.inline(F.array_compact(F.array(own, summed))))
    return out.select(*keys, unit, "religion", "count", "level", "how")


def domain_total(rows: DataFrame, domain: str, name: str) -> DataFrame:
    """One row a category for a whole unit out of a table of its parts.

    A row labelled as the total serves; else the unit that equals the sum of the others; else the
    sum of the parts. ``rows``: domain, year, unit, religion, count.
    """
    group = [domain, "year"]
    units = rows.groupBy(*group, "religion", name).agg(F.sum("count").alias("_v"), F.max("count").alias("_largest"))
    told = equals_rest(units, group, "religion", "_v")
    equal = F.col(name).isNotNull() & F.max("equals_rest").over(Window.partitionBy(*group, name))
    told = told.withColumns({"_equal": equal, "_label": yes(norm_label(name).rlike("^(jumlah|total)"))})
    largest = lambda c: F.max(F.when(F.col(c), F.col("_largest"))).alias(f"{c}_v")
    out = told.groupBy(*group, "religion").agg(F.max("_label").alias("_label"), F.max("_equal").alias("_equal"), largest("_label"), largest("_equal"), F.sum("_v").alias("_v"))
    first = lambda a, b, c: F.when(F.col("_label"), a).when(F.col("_equal"), b).otherwise(c)
    return out.select(*group, "religion", first(F.col("_label_v"), F.col("_equal_v"), F.col("_v")).alias("count"), first(F.lit("label"), F.lit("equals rest"), F.lit("sum")).alias("how"))


def clean_label(text: Column) -> Column:
    """A printed label without stray single characters and without the translation that follows a slash."""
    words = F.filter(F.split(F.split_part(text, F.lit("/"), F.lit(1)), r"\s+"), lambda w: F.length(w) > 1)
    return F.array_join(words, " ")


def clean_unit_name(text: Column) -> Column:
    """A printed unit name without its translation: what follows a slash, a kind of unit in English at the end, words that come again."""
    name = F.regexp_replace(F.trim(F.split_part(text, F.lit("/"), F.lit(1))), r"(?i)\s+(regency|municipality|city|district)$", "")
    words = F.split(F.trim(name), r"\s+")
    # words at the end that the name already has are its echo; two words stay at least
    again = F.transform(words, lambda w, i: (i >= 2) & F.array_contains(F.transform(F.slice(words, F.lit(1), i), F.lower), F.lower(w)))
    last = F.array_max(F.transform(again, lambda a, i: F.when(~a, i + 1).otherwise(0)))
    return F.array_join(F.slice(words, F.lit(1), F.greatest(last, F.lit(1))), " ")


def year_from_title(text: Column, other: Column) -> Column:
    """The year behind a religion table's title, in either language of the page, else ``other``."""
    line = F.regexp_replace(text, "\n", " ")
    found = [F.nullif(F.regexp_extract(line, p, 1), F.lit("")) for p in (r"(?i)agama\s*yang\s*dianut.*?,?\s*(20\d\d)", r"(?i)religion.{0,60}?(20\d\d)")]
    return F.coalesce(*[f.cast("int") for f in found], other)


def publications(listed: DataFrame, years: list[int] | None = None, pattern: str | None = None) -> DataFrame:
    """Listed publications (domain, pub_id, title, batch): the last of each, whose title holds one of the years and the pattern, whatever its case."""
    rows = first_per_key(listed, ["domain", "pub_id"], F.desc("batch"), F.asc("title"))
    title = F.coalesce("title", F.lit(""))
    rows = rows.where(title.rlike("|".join(map(str, years)))) if years else rows
    return rows.where(title.rlike(f"(?i){pattern}")) if pattern else rows
