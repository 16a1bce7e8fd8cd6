"""From one long table of counts to a checked wide panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import MAJOR_RELIGIONS, RELIGIONS, ref_part
from ..functions.nulls import computed, half_even, padded, row_sum, yes
from ..operators.relational import best_source, cascade_lookup, drop_by_rules, first_per_key, small, string_set

LONG = [
    ("source", "string"), ("province_code", "string"), ("unit_code", "string"), ("unit_name", "string"), ("year", "int"),
    ("semester", "int"), ("religion", "string"), ("count", "double"), ("ref", "string"),
]
# Sources in order of trust; the source whose tables print percentages; references with known errors.
PREFERENCE = ["arcgis", "pdf", "pdf_da", "bpsvar", "bps", "bps_kabsum", "pdf_da_sum", "pdf_da_pct"]
PERCENT_SOURCE = "pdf_da_pct"
BAD_REFS = ("bps:3300:1881", "bps:6400:321")


def attach_codes(long: DataFrame, codes: DataFrame) -> DataFrame:
    """Unit codes for rows that have none, from ``codes``: province_code, level, unit_key, unit_code.

    Five keys, ever looser: province, level and name; province and name; the same as a district
    where the level is unknown; the name alone; the name alone among districts where it is unknown.
    """
    unknown = F.col("level") == "unknown"
    dim = codes.select(F.col("province_code"), "level", "unit_key", F.col("unit_code").alias("found_code"))
    levels = [
        (["province_code", "level", "unit_key"], {}, None),
        (["province_code", "unit_key"], {}, None),
        (["province_code", "level", "unit_key"], {"level": "kabupaten"}, unknown),
        (["unit_key"], {}, None),
        (["level", "unit_key"], {"level": "kabupaten"}, unknown),
    ]
    open_rows = long.where("unit_code is null and level <> 'kecamatan' or level is null and unit_code is null")
    rest = long.where("not (unit_code is null and level <> 'kecamatan' or level is null and unit_code is null)").withColumn("matched", F.lit(False))
    found = cascade_lookup(open_rows, dim, levels, "found_code")
    found = found.withColumn("unit_code", F.col("found_code")).withColumn("matched", F.col("found_code").isNotNull()).drop("found_code", "match_level")
    return rest.unionByName(found)


def cell_quality(columns: list[str] = RELIGIONS, present: list[str] | None = None) -> Column:
    """What is wrong with a wide row of counts: percent, placeholder, no_religions, partial, or nothing.

    ``present``: the columns that hold a value anywhere in the table; a major column that is
    absent from all of it is not missed in a row.
    """
    values = F.filter(F.array(*[F.col(c) for c in columns]), lambda v: v.isNotNull())
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    nonzero = F.filter(values, lambda v: v != 0)
    alike = F.exists(nonzero, lambda v: F.size(F.filter(nonzero, lambda x: x == v)) >= 4)
    major = [c for c in MAJOR_RELIGIONS if c in (present if present is not None else columns)]
    missing = F.exists(F.array(*[F.col(c).isNull() for c in major]), lambda m: m) if major else F.lit(False)
    return (
        F.when((F.size(values) >= 3) & total.between(99, 101) & (F.array_max(values) <= 100), "percent")
        .when(alike, "placeholder")
        .when(F.size(values) == 0, "no_religions")
        .when(missing, "partial")
        .otherwise("")
    )


def repair_totals(wide: DataFrame, columns: list[str] = RELIGIONS) -> DataFrame:
    """Totals checked against the sum of the columns: off by over a tenth they give way to it, absent they are filled by it."""
    sums = F.when(F.col("quality") == "partial", F.lit(None).cast("double")).otherwise(row_sum(columns))
    out = computed(wide, {"total_reported": F.col("total"), "_sum": sums})
    ratio = F.try_divide(F.col("total"), F.col("_sum"))
    off = yes(~ratio.between(0.9, 1.1))
    out = computed(out, {"total": F.coalesce(F.when(~off, F.col("total")), F.col("_sum"))})
    return out.withColumn("total_is_sum", yes(F.col("total") == F.col("_sum"))).drop("_sum")


def panel_rows(long: DataFrame, rules: DataFrame | None = None, bad_refs: tuple[str, ...] = BAD_REFS) -> DataFrame:
    """Rows that may enter the panel: with code, count and year, of no sub-district, no known bad reference and no curated rule."""
    rows = long.where("unit_code is not null and count is not null and year is not null").where(yes(~F.col("ref").isin(*bad_refs)) if bad_refs else F.lit(True))
    if "level" in rows.columns:
        rows = rows.where(~yes(F.col("level") == "kecamatan"))
    rows = rows.withColumn("semester", F.coalesce("semester", F.lit(0)))
    return drop_by_rules(rows, rules, ["unit_code", "year", "ref"]) if rules is not None else rows


CELL = ["unit_code", "year", "semester"]


def lost_exact(rows: DataFrame, wanted: str = "konghucu", preference: list[str] = PREFERENCE) -> DataFrame:
    """Cells, by year, whose serving reference lacks the ``wanted`` category although another reference has it.

    ``rows``: as ``panel_rows`` returns them.
    """
    best = best_source(rows, CELL, "source", "ref", "religion", preference)
    held = best.groupBy(*CELL).agg(F.bool_or(F.col("religion") == wanted).alias("chosen"))
    anywhere = rows.where(F.col("religion") == wanted).select(*CELL).distinct()
    return held.where(~yes(F.col("chosen"))).join(anywhere, CELL, "left_semi").groupBy("year").agg(F.count(F.lit(1)).alias("n_lost"))


def percent_to_counts(panel: DataFrame, columns: list[str] = RELIGIONS) -> DataFrame:
    """Rows out of percentage tables as counts of the official population, without their total; those without a population go."""
    percent = yes(F.col("sources") == PERCENT_SOURCE)
    held = panel.where(~percent | F.col("population").isNotNull())
    counts = {c: F.when(percent, F.rint(F.col(c) / 100 * F.col("population"))).otherwise(F.col(c)) for c in columns}
    return computed(held, counts | {"total": F.when(~percent, F.col("total"))})


def build_panel(
    long: DataFrame, population: DataFrame | None = None, rules: DataFrame | None = None, bad_refs: tuple[str, ...] = BAD_REFS, preference: list[str] = PREFERENCE
) -> DataFrame:
    """The wide panel: one row a unit, year and semester.

    Sub-districts, rows without code, count or year, and known bad references go; then curated
    rules; then the best reference serves each cell. Where populations are given, rows of
    percentage tables become counts, or go. Unusable rows go; totals are repaired; tables of
    parts of a unit, and totals far from the population, go where one is known. A category that
    no served cell has is not missed in a row; to learn which these are runs a job when called.
    """
    best = best_source(panel_rows(long, rules, bad_refs), CELL, "source", "ref", "religion", preference)
    names = [*RELIGIONS, "total"]
    cell = lambda c: F.first(F.when(F.col("religion") == c, F.col("count")), ignorenulls=True).alias(c)
    panel = best.groupBy(*CELL).agg(
        *map(cell, names), string_set("source").alias("sources"), F.min("ref").alias("ref"), F.min_by("ref", F.when(F.col("religion") == "konghucu", F.col("source"))).alias("konghucu_ref")
    )
    held = panel.agg(*[F.count(c).alias(c) for c in names]).first()
    present = [c for c in names if held[c]]
    if population is not None:
        panel = percent_to_counts(panel.join(population.select("unit_code", "year", "population"), ["unit_code", "year"], "left"))
    else:
        panel = panel.withColumn("population", F.lit(None).cast("double"))
    panel = computed(panel, {"quality": cell_quality(present=present)}).where("quality not in ('percent', 'placeholder', 'no_religions')")
    panel = repair_totals(panel)
    panel = computed(panel, {
        "konghucu_share": F.try_divide("konghucu", "total"), **upper_bound("konghucu", "lainnya"), "total_to_pop": F.try_divide("total", "population"),
    })
    part = yes(F.col("total_to_pop") < 0.3) & yes(ref_part("ref", 2).rlike(r"^\d{4}$") & ~ref_part("ref", 2).endswith("00"))
    far = yes((F.col("total_to_pop") > 1.5) | (F.col("total_to_pop") < 0.5))
    panel = panel.where(~part & ~far)
    return panel.withColumns({"konghucu_share_pop": F.try_divide("konghucu", "population"), "konghucu_ub_share_pop": F.try_divide("konghucu_ub", "population")})


def upper_bound(exact: str, other: str) -> dict[str, Column]:
    """An exact count or, where there is none, the residual category that holds it; and whether it is the residual."""
    return {f"{exact}_ub": F.coalesce(exact, other), f"{exact}_ub_is_{other}": F.col(exact).isNull() & F.col(other).isNotNull()}


def scale_populations(long: DataFrame, ref: str, value: str, scale: Column, most: float = 7e6) -> DataFrame:
    """Values of each series times the factor that its unit of count names, unless they are plain persons already.

    A series whose median would pass ``most`` by the factor, and does not without it, is left as it
    is. A series' median comes from its distinct values with their counts.
    """
    held = long.withColumn("_scale", scale)
    mid = held.groupBy(ref).agg(F.median(value).alias("_mid"))
    out = held.join(small(mid), ref, "left")
    plain = yes((F.col("_scale") > 1) & (F.col("_mid") * F.col("_scale") > most) & (F.col("_mid") <= most))
    return out.withColumn("population", F.col(value) * F.when(plain, F.lit(1.0)).otherwise(F.col("_scale"))).drop("_scale", "_mid")


def reconcile_series(long: DataFrame, unit: str, year: str, ref: str, value: str, low: float = 3e3, high: float = 7e6, spread: float = 1.5) -> DataFrame:
    """One value a unit and year out of several series.

    Implausible values go; where a cell has two or more, values over ``spread`` times off the
    cell's median go; of the rest the series with the widest coverage serves, then the lesser name.
    """
    ok = long.where(F.col(value).between(low, high) & F.col(unit).isNotNull() & F.col(year).isNotNull())
    cell = Window.partitionBy(unit, year)
    # a series may hold a third of all rows: it is counted with partial sums, not gathered
    series = ok.groupBy(F.col(ref).alias("_ref")).agg(F.count(F.lit(1)).alias("coverage"))
    ok = ok.join(small(series), F.col(ref).eqNullSafe(F.col("_ref")), "left").drop("_ref")
    ok = ok.withColumns({"_mid": F.median(value).over(cell), "_n": F.count(value).over(cell)})
    ratio = F.try_divide(F.col(value), F.col("_mid"))
    ok = ok.where((F.col("_n") < 2) | yes(ratio.between(1 / spread, spread)))
    stats = ok.groupBy(unit, year).agg(F.count_distinct(value).alias("n_values"), half_even(F.try_divide(F.max(value), F.min(value)), 3).alias("spread"))
    best = first_per_key(ok, [unit, year], F.desc("coverage"), F.asc(ref)).select(unit, year, ref, value, "coverage")
    return best.join(stats, [unit, year])


def correct_years(long: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Years that a book of a known year cannot print become the year before the book's; unlisted books need a year from 2000 to 2030."""
    out = long.join(small(catalogue.select("ref", F.col("year").alias("_book"))), "ref", "left")
    possible = (F.col("year") == F.col("_book") - 1) | (F.col("year") == F.col("_book") - 2)
    year = F.when(F.col("_book").isNotNull() & ~yes(possible), F.col("_book") - 1).otherwise(F.col("year"))
    return out.withColumn("year", year).where(F.col("_book").isNotNull() | F.col("year").between(2000, 2030)).drop("_book")


def foreign_panel(long: DataFrame, province_rows: DataFrame | None = None, permits: list[str] | None = None, nation: str = "CHN") -> DataFrame:
    """Foreign residents by unit and year: one column a permit for one nation, all its permits, all foreigners.

    ``permits``: those to have a column; by default all that occur, which a job finds. ``wna_resident``
    sums the rows of nation WNA, ``foreign_total`` those of TOTAL. ``province_rows`` (province_code,
    year, nationality, count) adds ``chn_province_any``, what its province has.
    """
    rows = long.where("unit_code is not null and count is not null").withColumn("permit", F.coalesce("permit_type", F.lit("ANY")))
    own = F.col("nationality") == nation
    if permits is None:  # a closed list of kinds
        permits = sorted(r["permit"] for r in rows.where(own).select("permit").distinct().collect())
    of = lambda cond: F.sum(F.when(cond, F.col("count")))
    out = rows.groupBy("unit_code", "year").agg(
        *[of(own & (F.col("permit") == p)).alias(f"chn_{p.lower()}") for p in permits if p.lower() != "any"],
        of(own).alias("chn_any"), of(F.col("nationality") == "WNA").alias("wna_resident"), of(F.col("nationality") == "TOTAL").alias("foreign_total"),
        string_set("source").alias("sources"),
    )
    if province_rows is None:
        return out
    context = province_rows.where(own).groupBy(padded("province_code", 2).alias("province_code"), "year").agg(F.sum("count").alias("chn_province_any"))
    return out.withColumn("province_code", F.substring("unit_code", 1, 2)).join(small(context), ["province_code", "year"], "left")
