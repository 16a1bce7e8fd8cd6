"""Rows numbered on several levels: who stands under whom, and whether printed subtotals add up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import yes

#: Numberings from the outermost level on: '01.' before '1.'.
TWO_LEVELS = [r"^\s*\d{2}\.", r"^\s*\d\."]


def numbered_level(label: str | Column, patterns: list[str] = TWO_LEVELS) -> Column:
    """The level (from 1) of the first numbering that a label starts with, else null."""
    text, out = F.col(label) if isinstance(label, str) else label, F
    for k, pattern in enumerate(patterns, 1):
        out = out.when(text.rlike(pattern), F.lit(k))
    return out


def outline(rows: DataFrame, table: list[str], order: str, level: str, depth: int) -> DataFrame:
    """``rows`` with ``parent``: the ``order`` of the row that each stands under, the last one before it of a smaller level.

    ``level`` counts from 1 to ``depth``; rows of the first level, and rows without one, have no parent.
    """
    before = Window.partitionBy(*table).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parent = F
    for k in range(2, depth + 1):
        parent = parent.when(F.col(level) == k, F.last(F.when(F.col(level) < k, F.col(order)), True).over(before))
    return rows.withColumn("parent", parent if depth > 1 else F.lit(None).cast(rows.schema[order].dataType))


def subtotals(rows: DataFrame, table: list[str], order: str, category: str, value: str, tol: float = 0.01) -> DataFrame:
    """``rows`` (as ``outline`` gives them, a row a category) with ``below``, the sum of the rows right under each, and ``adds_up``.

    ``adds_up`` is null for rows with nothing under them; else whether the printed value lies within ``tol`` of the sum.
    """
    # each row counts for itself and for the row that it stands under, whose table it shares: nothing is joined
    own, under = F.struct(F.col(order).alias("_at"), F.lit(False).alias("_under")), F.struct(F.col("parent").alias("_at"), F.lit(True).alias("_under"))
    both = rows.select("*", F.inline(F.when(F.col("parent").isNotNull(), F.array(own, under)).otherwise(F.array(own))))
    met = Window.partitionBy(*table, "_at", category)
    out = both.withColumn("below", F.sum(F.when(F.col("_under"), F.col(value))).over(met)).where("not _under").drop("_at", "_under")
    near = yes(F.abs(F.col(value) - F.col("below")) <= tol * F.greatest(F.abs(F.col(value)), F.abs(F.col("below"))))
    return out.withColumn("adds_up", F.when(F.col("below").isNotNull(), near))


def top_sums(rows: DataFrame, table: list[str], level: str, category: str, value: str) -> DataFrame:
    """A total a category of the tables whose every printed subtotal adds up: the sum of their first level. Others give nothing."""
    top = F.col(level) == 1
    sums = rows.groupBy(*table, category).agg(F.sum(F.when(top, F.col(value))).alias(value), F.count_if(top).alias("_tops"), F.min(F.coalesce("adds_up", F.lit(True))).alias("_all"), F.count("adds_up").alias("_n"))
    w = Window.partitionBy(*table)
    sums = sums.withColumns({"_all": F.min("_all").over(w), "_n": F.sum("_n").over(w)})
    return sums.where("_all and _n > 0 and _tops > 0").select(*table, category, value)
