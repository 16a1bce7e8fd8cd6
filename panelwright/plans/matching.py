"""Names of places in outside files matched to unit codes, and what is summed over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import country_group, norm_kanim, norm_label, province_code, unit_key, unit_level
from ..functions.nulls import padded, yes
from ..operators.relational import allocate, cascade_lookup, small
from .estimate import convert_investment


def _joined(text: str | Column) -> Column:
    """A normalised label without spaces, its kind of unit kept."""
    return F.replace(norm_label(text), F.lit(" "), F.lit(""))


def code_table(codes: DataFrame) -> DataFrame:
    """``codes`` (unit_code, unit_name) with province_code, level, unit_key and full_key.

    Where the name does not tell the level, the third digit of the code does: 7 is a kota.
    """
    code = padded("unit_code")
    by_code = F.when(F.substring(code, 3, 1) == "7", "kota").otherwise("kabupaten")
    level = F.when(unit_level("unit_name") == "unknown", by_code).otherwise(unit_level("unit_name"))
    return codes.select(
        code.alias("unit_code"), "unit_name", F.substring(code, 1, 2).alias("province_code"), level.alias("level"),
        unit_key("unit_name").alias("unit_key"), _joined("unit_name").alias("full_key"),
    )


def match_investment_units(raw: DataFrame, codes: DataFrame, province: str = "provinsi", name: str = "kabupaten_kota") -> DataFrame:
    """``raw`` with ``unit_code``: places of investment reports by names that drop or keep their kind.

    Six keys, ever looser, of which each has to name one unit: province, level and name; province
    and name; the name alone; level and name; the name as it is printed with its prefix; and,
    where no district is printed so, the name as a town's without its prefix. The fourth to sixth
    find districts whose province is filed differently and 'Kota Baru' for 'Kotabaru'. Each pair of province and name is
    resolved once, and the rows joined to the pairs.
    """
    pairs = _matched(raw.select(province, name).distinct(), codes, province, name).select(F.col(province).alias("_province"), F.col(name).alias("_name"), "unit_code")
    same = F.col(province).eqNullSafe(F.col("_province")) & F.col(name).eqNullSafe(F.col("_name"))
    return raw.drop("unit_code").join(small(pairs), same, "left").drop("_province", "_name")


def _matched(raw: DataFrame, codes: DataFrame, province: str, name: str) -> DataFrame:
    """``raw`` with ``unit_code``, by the keys of ``match_investment_units``."""
    table = code_table(codes)
    plain = F.regexp_replace(F.col(name), r"(?i)^kota adm\.?\s+", "Kota ")
    bare = F.regexp_replace(F.col(name), r"(?i)^(kabupaten|kota adm\.?|kota)\s+", "")
    rows = raw.withColumns({"province_code": province_code(province), "level": unit_level(name), "unit_key": unit_key(plain), "full_key": _joined(bare)})
    levels = [(["province_code", "level", "unit_key"], {}, None), (["province_code", "unit_key"], {}, None), (["unit_key"], {}, None), (["level", "unit_key"], {}, None), (["full_key"], {}, None)]
    found = cascade_lookup(rows, table, levels, "unit_code").withColumnRenamed("unit_code", "_first").withColumn("_printed", F.col("full_key"))
    district = table.where("level = 'kabupaten'").select(F.col("full_key").alias("_printed"), F.lit(True).alias("_district")).distinct()
    found = found.join(district, "_printed", "left").withColumn("full_key", F.concat(F.lit("kota"), "_printed")).drop("match_level")
    town = F.col("_first").isNull() & ~yes(F.col("level") == "kabupaten") & F.col("_district").isNull()
    found = cascade_lookup(found, table.select("full_key", "unit_code"), [(["full_key"], {}, None)], "unit_code")
    code = F.coalesce("_first", F.when(town, F.col("unit_code")))
    return found.withColumn("unit_code", code).select(*raw.columns, "unit_code")


def load_investment(raw: DataFrame, codes: DataFrame, amount: str = "investasi_us_ribu") -> DataFrame:
    """Investment reports (provinsi, kabupaten_kota, status_penanaman_modal, negara, year, amount) by unit and year.

    Rows without a match are left out; ``match_investment_units`` tells which.
    """
    rows = match_investment_units(raw, codes).where("unit_code is not null")
    return convert_investment(rows.select(
        "unit_code", F.col("year").cast("int").alias("year"), F.col("status_penanaman_modal").alias("status"), country_group("negara").alias("origin"), F.col(amount).try_cast("double").alias("amount")
    ))


def investment_column(table: DataFrame, column: str = "value") -> DataFrame:
    """unit_code of four digits, year, and a column of amounts as ``value``; what is no number is 0."""
    return table.select(padded("unit_code").alias("unit_code"), F.col("year").cast("int").alias("year"), F.coalesce(F.col(column).try_cast("double"), F.lit(0.0)).alias("value"))


def allocate_foreign(long: DataFrame, codes: DataFrame | None = None, crosswalk: DataFrame | None = None) -> DataFrame:
    """Foreign residents at unit level: districts by name, immigration offices spread by a crosswalk.

    District and sub-district rows get ``unit_code`` by province, level and name, else by province
    and name where that names one unit. Office rows are spread over the units of ``crosswalk``
    (kanim_norm, unit_code, weight), ``allocated``; those it lacks stay without a code. Rows of
    other regions are left out.
    """
    region = F.col("region_level")
    local = long.where(region.isin("kabupaten", "kecamatan"))
    if codes is None:
        local = local.withColumn("unit_code", F.lit(None).cast("string"))
    else:
        keyed = local.withColumns({"level": unit_level("region_name"), "unit_key": unit_key("region_name")})
        levels = [(["province_code", "level", "unit_key"], {}, None), (["province_code", "unit_key"], {}, None)]
        local = cascade_lookup(keyed, code_table(codes), levels, "unit_code").drop("match_level")
    names = [*long.columns, "unit_code", "allocated"]
    local = local.withColumn("allocated", F.lit(False)).select(*names)
    offices = long.where(region == "kanim").withColumn("kanim_norm", norm_kanim("region_name"))
    if crosswalk is None:
        return local.unionByName(offices.withColumns({"unit_code": F.lit(None).cast("string"), "allocated": F.lit(False)}).select(*names))
    return local.unionByName(allocate(offices, crosswalk, "kanim_norm", "unit_code", "weight", "count").select(*names))


def summed_shares(matched: DataFrame, sums: list[str], shares: dict[str, tuple[str, str]], label: str, unit: str = "unit_code") -> DataFrame:
    """Census tabulations that share a code as one row: sums, a label, and shares taken anew from the sums.

    ``shares``: name to (part, whole); null where the whole is not positive.
    """
    out = matched.where(F.col(unit).isNotNull()).groupBy(unit).agg(*[F.sum(c).alias(c) for c in sums], F.min(label).alias(label))
    return out.withColumns({name: F.when(F.col(whole) > 0, F.col(part) / F.col(whole)) for name, (part, whole) in shares.items()})
