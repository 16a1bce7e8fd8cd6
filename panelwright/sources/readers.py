"""Readers of the files that panels start from. Paths go through Spark, never through open()."""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import blank_to_null


def read_strings(spark: SparkSession, path: str | list[str], **options: str) -> DataFrame:
    """A CSV with a header, every column as text; codes keep their leading zeros. Gzip is read as it is."""
    return spark.read.options(header="true", **options).csv(path)


def read_drop_rules(spark: SparkSession, path: str) -> DataFrame:
    """Curated rules: unit_code, year, ref, reason. '#' starts a comment, blank means any; a missing file has no rules."""
    schema = "unit_code string, year int, ref string, reason string"
    try:
        raw = read_strings(spark, path, comment="#")
        columns = raw.columns
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
    col = lambda c: blank_to_null(c) if c in columns else F.lit(None).cast("string")
    return raw.select(col("unit_code").alias("unit_code"), col("year").try_cast("double").cast("int").alias("year"), col("ref").alias("ref"), col("reason").alias("reason"))


def read_tabular(spark: SparkSession, path: str) -> DataFrame:
    """Small open-data files of unknown kind: JSON (flattened one level), or CSV in UTF-8 or Latin-1 with ',' or ';'.

    The kind is told file by file, the encoding from all of it; Spark's own readers take the files, those of a kind together,
    and the kinds are put side by side by name. Spreadsheets need a reader that is not part of
    Spark, and raise.
    """
    content, start = F.col("content"), F.ltrim(F.substring("content", 1, 4096).cast("string"), F.lit("\ufeff \r\n\t"))
    line = F.split_part(start, F.lit("\n"), F.lit(1))
    kind = F.when(F.hex(F.substring("content", 1, 2)).isin("504B") | (F.hex(F.substring("content", 1, 4)) == "D0CF11E0"), "sheet").when(start.rlike(r"^[\[{]"), "json").otherwise("csv")
    encoding = F.when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("ISO-8859-1")
    sep = F.when(F.regexp_count(line, F.lit(";")) > F.regexp_count(line, F.lit(",")), ";").otherwise(",")
    files = spark.read.format("binaryFile").load(path).select("path", kind.alias("kind"), encoding.alias("encoding"), sep.alias("sep"))
    groups = files.groupBy("kind", "encoding", "sep").agg(F.array_sort(F.collect_list("path")).alias("paths")).orderBy("kind", "encoding", "sep").collect()
    if not groups:
        raise FileNotFoundError(path)
    if any(g["kind"] == "sheet" for g in groups):
        raise NotImplementedError("spreadsheets: convert to CSV first")
    out = None
    for g in groups:
        if g["kind"] == "json":
            part = flatten(spark.read.option("multiLine", "true").json(g["paths"]))
        else:
            part = read_strings(spark, g["paths"], sep=g["sep"], encoding=g["encoding"])
            part = part.toDF(*[c.lstrip("\ufeff").strip() for c in part.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Struct columns as their fields, arrays of structs as rows."""
    for f in df.schema.fields:
        if f.dataType.typeName() == "array" and f.dataType.elementType.typeName() == "struct":
            df = df.withColumn(f.name, F.explode_outer(f.name))
    cols = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "struct":
            cols += [F.col(f"`{f.name}`.`{g}`").alias(f"{f.name}.{g}") for g in f.dataType.names]
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(cols)


_LINE = "array<array<double>>"


def read_polygons(spark: SparkSession, path: str, id_field: str) -> DataFrame:
    """GeoJSON polygons: unit_id and rings (array of rings of points); raises if a feature lacks the id."""
    text = spark.read.option("wholetext", "true").text(path)
    kind = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
    rows = text.select(F.explode(F.from_json("value", kind)["features"]).alias("f"))
    unit = F.try_element_at("f.properties", F.lit(id_field))
    unit = F.when(unit.isNull(), F.raise_error(F.lit(f"feature without {id_field}"))).otherwise(unit)
    shape = F.col("f.geometry.coordinates")
    one = F.array(F.from_json(shape, "array<array<array<double>>>"))
    many = F.from_json(shape, "array<array<array<array<double>>>>")
    parts = F.when(F.col("f.geometry.type") == "MultiPolygon", many).otherwise(one)
    return rows.select(unit.alias("unit_id"), F.explode(parts).alias("rings"))


def read_lines(spark: SparkSession, path: str, highways: list[str] | None = None) -> DataFrame:
    """GeoJSON lines: highway and line (array of points); kept if the road class is absent or listed, or all without a list."""
    text = spark.read.option("wholetext", "true").text(path)
    kind = "struct<features:array<struct<properties:map<string,string>,geometry:struct<type:string,coordinates:string>>>>"
    rows = text.select(F.explode(F.from_json("value", kind)["features"]).alias("f")).withColumn("highway", F.try_element_at("f.properties", F.lit("highway")))
    if highways is not None:
        rows = rows.where(F.col("highway").isNull() | F.col("highway").isin(highways))
    shape = F.col("f.geometry.coordinates")
    lines = F.when(F.col("f.geometry.type") == "MultiLineString", F.from_json(shape, f"array<{_LINE}>")).otherwise(F.array(F.from_json(shape, _LINE)))
    return rows.select("highway", F.explode(lines).alias("line"))


def _categories(text):
    """(variable, code, label) of an XML codebook's categories."""
    out, bare = [], lambda e: e.tag.rsplit("}", 1)[-1]
    for var in (e for e in ET.fromstring(text).iter() if bare(e) == "var"):
        for cat in (e for e in var if bare(e) == "catgry"):
            part = {bare(e): (e.text or "").strip() for e in cat}
            out.append((var.get("ID") or var.get("name"), part.get("catValu"), part.get("labl")))
    return out


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """The categories of XML codebooks, one or several files: var, code, label; name spaces don't matter."""
    text = spark.read.option("wholetext", "true").text(path)
    categories = F.udf(_categories, "array<struct<var:string,code:string,label:string>>", useArrow=True)
    return text.select(F.inline(categories("value")))


def roles_of(columns: list[str], patterns: dict[str, str]) -> dict[str, str | None]:
    """Role to column: for each role the first column in order that matches and is not taken yet."""
    from ..operators.relational import pick_column

    taken: set[str] = set()
    out: dict[str, str | None] = {}
    for role, pattern in patterns.items():
        out[role] = pick_column(columns, pattern, taken)
        if out[role]:
            taken.add(out[role])
    return out


def image_path(folder: str, pano, heading):
    """Path of an image by pano and heading: rounded half to even, from 0 to 359, three digits."""
    return F.format_string(f"{folder}/%s_%03d.jpg", pano, F.pmod(F.rint(heading), F.lit(360)).cast("int"))


def fetch_cost(images: int, usd_per_thousand: float = 7.0) -> float:
    """Cost of so many images in dollars."""
    return round(images * usd_per_thousand / 1000, 2)


def parse_json_pages(pages: list[str]) -> list[dict]:
    """Rows of a paged list service whose answer is [{page info}, [rows]]; unavailable answers have none."""
    out = []
    for text in pages:
        js = json.loads(text)
        data = js.get("data") if isinstance(js, dict) else None
        if isinstance(data, list) and len(data) > 1 and isinstance(data[1], list):
            out += data[1]
    return out
