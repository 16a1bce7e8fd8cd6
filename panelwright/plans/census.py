"""Census extracts tabulated by the categories of their codebook.

Which codes mean what is a dimension made in the plan: the codebook's labels are matched, and the extract is joined to
the codes that match. A set without a code stops the plan, so that a misread codebook can't give zeros.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.relational import bounded

# How a codebook's labels name the categories.
CHINESE = r"(?i)\b(chinese|cina|china|tionghoa|tionghua)\b"
KONGHUCU = r"(?i)kong\s?hu\s?cu|khong\s?hu\s?cu|confuc"
BUDDHIST = r"(?i)budd?h|buda"
# Fixed value: persons counted in the census of 2010.
PERSONS_2010 = 237_641_326


def category_codes(codebook: DataFrame, variable: str, pattern: str, needed: bool = True) -> DataFrame:
    """The distinct codes (``code``) of a variable whose label matches; raises when run, if ``needed`` and there is none."""
    own = codebook.where((F.upper("var") == variable.upper()) & F.coalesce(F.col("label").rlike(pattern), F.lit(False))).select(F.trim("code").alias("code")).distinct()
    if not needed:
        return own
    # one row tells whether the set is empty; it is asked of every row, so that no row passes unasked
    size = own.agg(F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") == 0, F.raise_error(F.lit(f"no category of {variable} has a label like {pattern}")).cast("string"))
    asked = size.select(checked.alias("code")).where("code is not null")
    return own.unionByName(asked)


def flagged(people: DataFrame, column: str, codes: DataFrame, flag: str) -> DataFrame:
    """``people`` with a boolean: whether the column's code is one of ``codes``."""
    own = bounded(codes.select(F.col("code").alias("_code"), F.lit(True).alias("_is")))
    out = people.join(own, F.trim(F.col(column).cast("string")) == F.col("_code"), "left")
    return out.withColumn(flag, F.coalesce("_is", F.lit(False))).drop("_code", "_is")


def label_of(codebook: DataFrame, variable: str) -> DataFrame:
    """code and label of a variable; of several labels the least."""
    return codebook.where(F.upper("var") == variable.upper()).groupBy(F.trim("code").alias("code")).agg(F.min("label").alias("label"))


def unit_shares(people: DataFrame, codebook: DataFrame, unit: str, weight: str, ethnic: str, religion: str, census_total: float, province: str | None = None) -> tuple[DataFrame, Observation]:
    """Weighted persons by unit: all, Chinese, Konghucu, Konghucu and Buddhist among the Chinese, the Chinese sample and shares.

    Weights whose sum is over ten times the census have two implied decimals. The observation holds ``weighted``, their sum
    after that, and ``plausible``, whether it lies between half and twice the census. A weight that can't be read is 0;
    units and provinces have their codebook's labels, blank without one. The province is the commonest of a unit's rows,
    the least on ties. Runs a job for the sum of weights and one for each set of codes when called.
    """
    rows = people.withColumn("_w", F.coalesce(F.col(weight).try_cast("double"), F.lit(0.0))).where(F.col(unit).isNotNull())
    for column, pattern, flag, needed in ((ethnic, CHINESE, "_cn", True), (religion, KONGHUCU, "_kh", True), (religion, BUDDHIST, "_bd", False)):
        rows = flagged(rows, column, category_codes(codebook, column, pattern, needed), flag)
    of = lambda c: F.sum(F.when(c, F.col("_w")).otherwise(0.0))
    cn, kh, bd = F.col("_cn"), F.col("_kh"), F.col("_bd")
    name = F.col(unit).cast("string").alias("geo2")
    sums = rows.groupBy(name).agg(
        F.sum("_w").alias("pop"), of(cn).alias("chinese"), of(kh).alias("konghucu"), of(cn & kh).alias("konghucu_chinese"), of(cn & bd).alias("buddha_chinese"), F.count_if(cn).alias("n_chinese_sample"),
        *([F.mode(F.col(province).cast("string"), True).alias("_province")] if province else []),
    )
    total = people.agg(F.sum(F.col(weight).try_cast("double"))).first()[0] or 0.0
    scale = 0.01 if total > 10 * census_total else 1.0
    sums = sums.withColumns({c: F.col(c) * scale for c in ("pop", "chinese", "konghucu", "konghucu_chinese", "buddha_chinese")})
    labels = bounded(label_of(codebook, unit).select(F.col("code").alias("geo2"), F.col("label").alias("geo2_label")))
    out = sums.join(labels, "geo2", "left").fillna("", ["geo2_label"])
    if province:
        provinces = bounded(label_of(codebook, province).select(F.col("code").alias("_province"), F.col("label").alias("geo1_label")))
        out = out.join(provinces, "_province", "left").fillna("", ["geo1_label"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    out = out.withColumns({"chinese_share": share("chinese", "pop"), "konghucu_of_chinese": share("konghucu_chinese", "chinese"), "buddha_of_chinese": share("buddha_chinese", "chinese")})
    seen = Observation("census")
    out = out.observe(seen, F.sum("pop").alias("weighted"), F.sum("pop").between(0.5 * census_total, 2 * census_total).alias("plausible"))
    return out.drop("_province"), seen
