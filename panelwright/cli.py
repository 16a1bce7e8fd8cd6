"""Command line: the plans over CSV or Parquet files.

    python -m panelwright.cli harmonise --long long.csv --codes codes.csv --out panel
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.labels import PROVINCES, norm_kanim, unit_key, unit_level
from .functions.nulls import padded
from .operators.relational import absent_codes, allocate, anchor_outliers, base_without_target, jumps, to_schema
from .operators.spatial import road_points
from .plans import census, detect, estimate, harmonise, ingest, matching, pages, rollup, yearbook
from .session import local_session
from .sources.readers import fetch_cost, read_codebook, read_drop_rules, read_lines, read_polygons, read_strings


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table; CSV columns are text, so that codes keep their zeros."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_strings(spark, path)


def harmonise_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Long tables and codes to the panel, with breaks and outliers."""
    long = to_schema(load(spark, a.long), harmonise.LONG).withColumns({"unit_key": unit_key("unit_name"), "level": unit_level("unit_name")})
    codes = matching.code_table(load(spark, a.codes))
    population = load(spark, a.population).select(padded("unit_code").alias("unit_code"), F.col("year").cast("int").alias("year"), F.col("population").cast("double").alias("population")) if a.population else None
    rules = read_drop_rules(spark, a.rules) if a.rules else None
    panel = harmonise.build_panel(harmonise.attach_codes(long, codes), population, rules)
    return {"panel": panel, "breaks": jumps(panel, ["unit_code"], ["year", "semester"], "konghucu"), "outliers": anchor_outliers(panel, "unit_code", "total", "population")}


def aggregate_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Images and places to place, point-year and unit-year panels."""
    images, places = load(spark, a.images), load(spark, a.places)
    images = images.withColumns({c: F.col(c).cast("double") for c in images.columns if c.startswith("n_") or c.endswith("area")})
    level = rollup.place_level(images, places).cache()
    points = rollup.point_year(level)
    return {"place": level, "point_year": points, "unit_year": rollup.unit_year(points)}


def classify_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Boxes with their sign types."""
    boxes = load(spark, a.boxes)
    return {"boxes": detect.classify_boxes(detect.describe_boxes(boxes))}


def score_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Scores of guesses against labels."""
    labels = load(spark, a.labels).withColumns({c: F.col(c).try_cast("int") for c in (a.truth, a.guess)})
    return {"score": rollup.classification_score(labels, a.truth, a.guess)}


def allocate_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Counts of offices spread over the units that they serve."""
    facts = load(spark, a.facts).withColumn("count", F.col("count").cast("double"))
    cross = load(spark, a.crosswalk).withColumn("weight", F.col("weight").try_cast("double"))
    return {"allocated": allocate(facts, cross, "kanim", "unit_code", "weight", "count")}


def describe_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Summary of one column."""
    return {"describe": estimate.describe(load(spark, a.table).withColumn(a.column, F.col(a.column).cast("double")), a.column)}


def investment_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Investment reports by unit and year, and the places that no code was found for."""
    raw, codes = load(spark, a.raw), load(spark, a.codes)
    amount = a.amount or "investasi_us_ribu"
    lost = matching.match_investment_units(raw, codes).where("unit_code is null").groupBy("provinsi", "kabupaten_kota").agg(F.sum(F.col(amount).try_cast("double")).alias(amount))
    return {"investment": matching.load_investment(raw, codes, amount), "unmatched": lost}


def estimate_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Every specification of the investment regressions, and summaries of the outcomes."""
    numbers = ["population", "total", "total_to_pop", "konghucu", "konghucu_ub", "buddha", "kristen", "katolik"]
    panel = load(spark, a.panel)
    panel = panel.withColumns({c: F.col(c).try_cast("double") for c in numbers if c in panel.columns} | {"unit_code": padded("unit_code"), "year": F.col("year").cast("int")})
    if "konghucu_ub_is_lainnya" in panel.columns:
        panel = panel.withColumn("konghucu_ub_is_lainnya", F.col("konghucu_ub_is_lainnya").cast("boolean"))
    chinese = load(spark, a.chinese).withColumns({c: F.col(c).try_cast("double") for c in ("n_chinese_sample", "chinese_share")}) if a.chinese else None
    own = estimate.usable(panel, chinese)
    grid = estimate.specification_grid(own, matching.investment_column(load(spark, a.investment), a.column or "value"))
    changes = {f"change_{y}": estimate.change_summary(estimate.two_period(own, y, 2021, 2023), "change_fixedpop") for y in ("konghucu", "konghucu_ub")}
    return {"grid": spark.createDataFrame([tuple(r.values()) for r in grid], "spec string, n long, coef_d_inv double, se double, p double")} | changes


def pages_of(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Files as ref and one column of their whole text."""
    return spark.read.option("wholetext", "true").text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("ref"), F.col("value").alias(column))


def religion_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Religion counts of HTML tables."""
    return {"religion": ingest.religion_tables(pages_of(spark, a.html, "html"))}


def foreign_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Foreign residents of HTML tables."""
    return {"foreign": ingest.foreign_tables(pages_of(spark, a.html, "html"))}


def open_data_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """An open-data table as long rows."""
    return {"foreign": ingest.open_data_to_long(load(spark, a.table), a.source or "ckan")}


def foreign_panel_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Foreign residents at unit level and their panel."""
    long = load(spark, a.long).withColumns({"count": F.col("count").try_cast("double"), "year": F.col("year").try_cast("int")})
    cross = load(spark, a.crosswalk).select(norm_kanim("kanim").alias("kanim_norm"), padded("unit_code").alias("unit_code"), F.col("weight").try_cast("double").alias("weight")) if a.crosswalk else None
    out = matching.allocate_foreign(long, load(spark, a.codes) if a.codes else None, cross)
    return {"allocated": out, "panel": harmonise.foreign_panel(out, long.where("region_level = 'province'"))}


def population_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Official population out of JSON cubes, one series a unit and year."""
    long = ingest.population_of(pages_of(spark, a.cubes, "js"), "js")
    return {"population": harmonise.reconcile_series(long.where("unit_code is not null"), "unit_code", "year", "ref", "population"), "long": long}


def census_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Shares of a census extract by unit, with the unit codes of their labels."""
    shares, _ = census.unit_shares(load(spark, a.extract), read_codebook(spark, a.codebook), a.unit, a.weight, a.ethnic, a.religion, float(a.total or census.PERSONS_2010), a.province)
    if not a.codes:
        return {"census": shares}
    named = shares.withColumns({"provinsi": F.col("geo1_label") if a.province else F.lit(None).cast("string"), "kabupaten_kota": F.col("geo2_label")})
    return {"census": matching.match_investment_units(named, load(spark, a.codes)).drop("provinsi", "kabupaten_kota")}


def yearbook_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Religion totals of yearbooks whose cells have been extracted (JSON lines: book, page, table_no, row_no, cells, text), tables joined over pages."""
    cells = spark.read.schema("book string, page int, table_no int, row_no int, cells array<string>, text string").json(a.cells)
    # the joined tables are read many times: they are settled in a file first
    joined = f"{a.out.rstrip('/')}/joined_tables.parquet"
    pages.joined_tables(cells).write.mode("overwrite").parquet(joined)
    return {"yearbooks": yearbook.book_totals(spark.read.parquet(joined))}


def domains_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Units with a usable count in a base year and none in a target year, and the provinces that the panel lacks."""
    panel = load(spark, a.panel).withColumn("year", F.col("year").try_cast("int"))
    usable = F.col(a.column or "konghucu")
    if "total_to_pop" in panel.columns:
        usable = F.when(F.col("total_to_pop").try_cast("double").between(0.8, 1.25), usable)
    years = lambda text: [int(y) for y in text.split(",")]
    provinces = panel.where("unit_code is not null").select(F.substring("unit_code", 1, 2).alias("province_code"))
    return {"domains": base_without_target(panel, "unit_code", "year", usable, years(a.base), years(a.target)), "provinces": absent_codes(provinces, "province_code", PROVINCES)}


def sample_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Points along roads inside units."""
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    units = read_polygons(spark, a.units, a.field).select("unit_id", F.transform("rings", lambda r: F.transform(r, point)).alias("rings"))
    roads = read_lines(spark, a.roads, a.highways.split(",") if a.highways else None)
    roads = roads.select(F.xxhash64(F.to_json("line")).alias("road"), F.transform("line", point).alias("line"))
    return {"points": road_points(units, roads, "unit_id", "rings", "road", "line", float(a.spacing or 50), int(a.most or 300))}


def plan_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Images still to fetch."""
    places = load(spark, a.places).withColumn("bearing", F.col("bearing").try_cast("double"))
    done = load(spark, a.done) if a.done else spark.createDataFrame([], "path string")
    return {"plan": detect.plan_images(places, done, [float(x) for x in (a.offsets or "90,270").split(",")], a.folder or "images")}


def validate_command(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    """Images for hand labels."""
    images = load(spark, a.images).withColumn("n_cjk_boxes", F.col("n_cjk_boxes").cast("int"))
    return {"sample": detect.validation_sample(images, int(a.hits or 100), int(a.blank or 100))}


COMMANDS = {
    "harmonise": (harmonise_command, ["long", "codes"], ["population", "rules"]),
    "aggregate": (aggregate_command, ["images", "places"], []),
    "classify": (classify_command, ["boxes"], []),
    "score": (score_command, ["labels", "truth", "guess"], []),
    "allocate": (allocate_command, ["facts", "crosswalk"], []),
    "describe": (describe_command, ["table", "column"], []),
    "investment": (investment_command, ["raw", "codes"], ["amount"]),
    "estimate": (estimate_command, ["panel", "investment"], ["chinese", "column"]),
    "religion-tables": (religion_command, ["html"], []),
    "foreign-tables": (foreign_command, ["html"], []),
    "open-data": (open_data_command, ["table"], ["source"]),
    "foreign-panel": (foreign_panel_command, ["long"], ["codes", "crosswalk"]),
    "population": (population_command, ["cubes"], []),
    "census": (census_command, ["extract", "codebook", "unit", "weight", "ethnic", "religion"], ["province", "codes", "total"]),
    "yearbooks": (yearbook_command, ["cells"], []),
    "domains": (domains_command, ["panel", "base", "target"], ["column"]),
    "sample": (sample_command, ["units", "roads", "field"], ["highways", "spacing", "most"]),
    "plan-images": (plan_command, ["places"], ["done", "offsets", "folder"]),
    "validate-export": (validate_command, ["images"], ["hits", "blank"]),
}


def flat(df: DataFrame) -> DataFrame:
    """``df`` for a CSV file: nested columns as JSON text."""
    nested = ("array", "map", "struct")
    return df.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() in nested else F.col(f.name) for f in df.schema.fields])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command and write its tables below --out."""
    parser = argparse.ArgumentParser(prog="panelwright", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name, (f, needed, optional) in COMMANDS.items():
        sub = commands.add_parser(name, help=f.__doc__)
        for x in needed:
            sub.add_argument(f"--{x}", required=True)
        for x in optional:
            sub.add_argument(f"--{x}")
        sub.add_argument("--out", required=True)
        sub.add_argument("--format", choices=["parquet", "csv"], default="parquet")
    cost = commands.add_parser("cost", help="Cost of fetching images")
    cost.add_argument("--images", type=int, required=True)
    args = parser.parse_args(argv)
    if args.command == "cost":
        print(fetch_cost(args.images))
        return 0
    spark = spark or local_session("*")
    for name, df in COMMANDS[args.command][0](spark, args).items():
        path = f"{args.out.rstrip('/')}/{name}.{args.format}"
        if args.format == "csv":
            flat(df).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)
        else:
            df.write.mode("overwrite").parquet(path)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
