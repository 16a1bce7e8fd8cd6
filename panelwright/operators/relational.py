"""Relational operators of panel building, with explicit ties and null keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import half_even, yes

#: Bytes up to which a dimension is broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint, given only where the optimiser's size estimate is under ``BROADCAST_BYTES``."""
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= BROADCAST_BYTES else df


def bounded(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast hint, given only where a job finds ``rows`` rows and ``BROADCAST_BYTES`` of text at most: for lists whose size no statistics tell."""
    width = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(16))
    n, size = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(width)).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= BROADCAST_BYTES else df


def to_schema(df: DataFrame, schema: list[tuple[str, str]]) -> DataFrame:
    """Columns in the order and types given; absent ones are null."""
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in schema])


def pick_column(columns: list[str], pattern: str, taken: set[str] = frozenset()) -> str | None:
    """First column whose name matches a pattern and isn't taken: the role a header plays."""
    import re

    return next((c for c in columns if c not in taken and re.search(pattern, c, re.I)), None)


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key, the first in the given order; null keys are a key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def only_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``; raises if a key occurs twice."""
    again = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"key {keys} occurs more than once: {again[0].asDict()}")
    return df


def cascade_lookup(facts: DataFrame, dim: DataFrame, levels: list[tuple[list[str], dict[str, str], Column | None]], value: str) -> DataFrame:
    """Resolve ``value`` through ever looser keys; the first level that finds one wins.

    A level is (key columns, {key column: constant that stands in for the fact's}, condition on
    the fact or None). At each level only keys that name one dimension row count. Null keys
    find nothing. Lookups run over the distinct keys of the facts, and come back null-safe.
    """
    names = sorted({k for keys, _, _ in levels for k in keys} | {c for _, _, cond in levels if cond is not None for c in facts.columns if c in dim.columns and c != value})
    keys_only = facts.select(*names).distinct()
    out, found = keys_only, []
    for i, (keys, fixed, condition) in enumerate(levels):
        own = only_unique(dim.where(F.expr(" and ".join(f"{k} is not null" for k in keys))), keys)
        own = own.select(*[F.col(k).alias(f"_{i}_{k}") for k in keys], F.col(value).alias(f"_found{i}"))
        on = yes(condition) if condition is not None else F.lit(True)
        for k in keys:
            on &= F.col(f"_{i}_{k}") == (F.lit(fixed[k]) if k in fixed else F.col(k))
        out = out.join(small(own), on, "left")
        found.append(F.col(f"_found{i}"))
    resolved = out.select(*[F.col(n).alias(f"_k_{n}") for n in names], F.coalesce(*found).alias(value), F.coalesce(*[F.when(c.isNotNull(), i + 1) for i, c in enumerate(found)]).alias("match_level"))
    same = F.lit(True)
    for n in names:
        same &= F.col(n).eqNullSafe(F.col(f"_k_{n}"))
    return facts.join(resolved, same, "left").drop(*[f"_k_{n}" for n in names])


def best_source(facts: DataFrame, cell: list[str], source: str, ref: str, category: str, preference: list[str]) -> DataFrame:
    """Rows of the one reference that serves each cell best, one row a category.

    Better sources come first in ``preference``, unknown ones last; then references with more
    categories, then the lesser name. Of rows that repeat a category the first source by name stays.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, preference)), F.col(source)), F.lit(0))
    rank = F.when(rank == 0, len(preference) + 1).otherwise(rank)
    tables = facts.groupBy(*cell, ref).agg(F.min(rank).alias("_rank"), F.count_distinct(category).alias("_n"))
    best = first_per_key(tables, cell, F.asc("_rank"), F.desc("_n"), F.asc(ref)).select(*[F.col(c).alias(f"_c_{c}") for c in [*cell, ref]])
    same = F.lit(True)
    for c in [*cell, ref]:
        same &= F.col(c).eqNullSafe(F.col(f"_c_{c}"))
    own = facts.join(best, same, "left_semi")
    return first_per_key(own, [*cell, category], F.asc(source))


def drop_by_rules(df: DataFrame, rules: DataFrame, fields: list[str]) -> DataFrame:
    """Rows that no rule hits. A rule hits rows that agree with it in every field it sets.

    A rule that would hit every row is ignored, and so is one that sets nothing. Rules are
    sorted by the fields they set; each such shape, of which there are at most 2 ^ fields, is
    one anti join on these fields, so no row meets every rule. When called, runs one job over the
    rules and one over ``df``: a rule hits every row if each of its fields has one value and no
    null in all of it, and that value is the rule's.
    """
    wanted = rules.select(*fields).distinct()
    shapes = wanted.select(F.array(*[F.col(f).isNotNull() for f in fields]).alias("s")).distinct().collect()
    only = df.agg(*[F.when((F.min(f) == F.max(f)) & (F.count(f) == F.count(F.lit(1))), F.min(f)).alias(f) for f in fields]).first()
    out = df
    for shape in sorted(tuple(r["s"]) for r in shapes):
        on = [f for f, has in zip(fields, shape, strict=True) if has]
        if not on:
            continue
        own = wanted
        for f in fields:
            own = own.where(F.col(f).isNotNull() if f in on else F.col(f).isNull())
        if all(only[f] is not None for f in on):
            everything = F.lit(True)
            for f in on:
                everything &= F.col(f) == F.lit(only[f])
            own = own.where(~everything)
        out = out.join(bounded(own.select(*on)), on, "left_anti")
    return out


def normalised_weights(df: DataFrame, group: list[str], weight: str) -> DataFrame:
    """Weights that add up to one within a group; a null weight counts as one."""
    w = F.coalesce(F.col(weight), F.lit(1.0))
    return df.withColumn(weight, w / F.sum(w).over(Window.partitionBy(*group)))


def allocate(facts: DataFrame, crosswalk: DataFrame, key: str, target: str, weight: str, amount: str) -> DataFrame:
    """Spread amounts over targets by weight; facts without a match stay as they are, not ``allocated``."""
    parts = normalised_weights(crosswalk.where(F.col(key).isNotNull()), [key], weight).select(key, target, weight)
    out = facts.join(small(parts), key, "left")
    done = F.col(target).isNotNull()
    return out.withColumn(amount, F.when(done, F.col(amount) * F.col(weight)).otherwise(F.col(amount))).withColumn("allocated", done).drop(weight)


def jumps(panel: DataFrame, unit: list[str], time: list[str], value: str, ratio: float = 5, least: float = 20, max_gap: float = 4) -> DataFrame:
    """Consecutive observations that differ by more than ``ratio`` times, close in time and large enough to tell."""
    w = Window.partitionBy(*unit).orderBy(*time)
    seen = panel.where(F.col(value).isNotNull())
    seen = seen.withColumns({f"prev_{value}": F.lag(value).over(w), f"prev_{time[0]}": F.lag(time[0]).over(w)})
    low, high = F.least(value, f"prev_{value}"), F.greatest(value, f"prev_{value}")
    gap = F.col(time[0]) - F.col(f"prev_{time[0]}")
    return seen.where(F.col(f"prev_{value}").isNotNull()).where((low > 0) & (gap <= max_gap) & (high >= least) & (F.try_divide(high, low) > ratio))


def anchor_outliers(panel: DataFrame, unit: str, total: str, anchor: str, tol: float = 0.35, least: int = 3) -> DataFrame:
    """Totals that stray from their anchor: the outside figure if positive, else the unit's median of ``least`` or more."""
    w = Window.partitionBy(unit)
    mid = F.when((F.count(total).over(w) >= least) & (F.median(total).over(w) > 0), F.median(total).over(w))
    base = panel.where(F.col(total).isNotNull()).withColumn("anchor", F.when(F.col(anchor) > 0, F.col(anchor)).otherwise(mid))
    ratio = F.try_divide(F.col(total), F.col("anchor"))
    return base.where(F.abs(ratio - 1) > tol).withColumn("ratio", half_even(ratio, 2))


def dense_running_sum(facts: DataFrame, unit: str, year: str, value: str, first: int, last: int) -> DataFrame:
    """Running sum on a grid of every unit and year; years without facts add nothing."""
    sums = facts.groupBy(unit, year).agg(F.coalesce(F.sum(value), F.lit(0.0)).alias(value))
    grid = facts.select(unit).distinct().select(unit, F.explode(F.sequence(F.lit(first), F.lit(last))).alias(year))
    w = Window.partitionBy(unit).orderBy(year).rowsBetween(Window.unboundedPreceding, 0)
    return grid.join(sums, [unit, year], "left").select(unit, year, F.sum(F.coalesce(value, F.lit(0.0))).over(w).alias(f"{value}_stock"))


def demeaned(df: DataFrame, unit: str, columns: list[str]) -> DataFrame:
    """Columns less their mean within a unit."""
    w = Window.partitionBy(unit)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def equals_rest(units: DataFrame, group: list[str], category: str, value: str, tol: float = 0.01) -> DataFrame:
    """``units``, a row a group, category and unit, with ``equals_rest``: whether it is a printed total of the group's largest category.

    Such a unit's value, the largest but for 3 %, equals the sum of the other units'; there are three units at least. All steps
    are windows within a group, so rows dealt by a key of the group are not shuffled again.
    """
    w = Window.partitionBy(*group)
    sums = units.withColumn("_sum", F.sum(value).over(Window.partitionBy(*group, category)))
    sums = sums.withColumn("_place", F.dense_rank().over(w.orderBy(F.desc_nulls_last("_sum"), F.asc(category))))
    top = F.col("_place") == 1
    for c in [*group, category]:
        top &= F.col(c).isNotNull()
    own = F.when(F.col("_top"), F.col(value))
    out = sums.withColumn("_top", top).withColumns({"_n": F.count_if("_top").over(w), "_max": F.max(own).over(w), "_all": F.sum(own).over(w)})
    rest = F.col("_all") - F.col(value)
    hit = (F.col("_n") >= 3) & (F.col("_max") > 0) & (F.col(value) >= 0.97 * F.col("_max")) & (F.abs(F.col(value) - rest) <= tol * F.greatest(F.col(value), rest))
    return out.withColumn("equals_rest", F.col("_top") & yes(hit)).select(*units.columns, "equals_rest")


def equal_to_rest(df: DataFrame, group: list[str], unit: str, category: str, value: str, tol: float = 0.01) -> DataFrame:
    """Units whose value of the group's largest category equals the sum of the other units': printed totals among the rows."""
    units = df.groupBy(*group, category, unit).agg(F.sum(value).alias("_v"))
    return equals_rest(units, group, category, "_v", tol).where("equals_rest").select(*group, unit)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """Up to ``n`` rows a stratum, by hash of the key: the same rows wherever it runs."""
    return first_n(df, [stratum], n, F.xxhash64(F.col(key), F.lit(seed)), F.col(key))


def first_n(df: DataFrame, group: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of a group in an order."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def union_keep_last(older: DataFrame, newer: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """Both tables by name, the newer row of a key that both hold.

    Rows of one table that share a key are settled by ``order`` and then by their content, so
    that the same row stays wherever it runs.
    """
    both = older.withColumn("_batch", F.lit(0)).unionByName(newer.withColumn("_batch", F.lit(1)), allowMissingColumns=True)
    rest = F.to_json(F.struct(*[c for c in both.columns if c != "_batch"]))
    return first_per_key(both, keys, F.desc("_batch"), *order, F.asc(rest)).drop("_batch")


def has_all(df: DataFrame, unit: str, column: str, wanted: list) -> DataFrame:
    """Units that have every wanted value."""
    own = df.where(F.col(column).isin(wanted)).groupBy(unit).agg(F.count_distinct(column).alias("_n"))
    return own.where(F.col("_n") == len(set(wanted))).select(unit)


def base_without_target(panel: DataFrame, unit: str, year: str, value: Column, base: list[int], target: list[int]) -> DataFrame:
    """Units with a value in a base year that lack one in at least one target year: what is worth fetching."""
    seen = panel.where(yes(value.isNotNull()))
    own = seen.where(F.col(year).isin(base)).select(unit).distinct()
    return own.join(has_all(seen, unit, year, target), unit, "left_anti")


def absent_codes(df: DataFrame, code: str, known: dict[str, str]) -> DataFrame:
    """Known codes that no row has: code, name."""
    listed = df.sparkSession.createDataFrame(sorted(known.items()), f"{code} string, name string")
    return listed.join(df.select(code).distinct(), code, "left_anti")


def string_set(column: str, most: int | None = None) -> Column:
    """Distinct values of a group in order, joined by ';'."""
    values = F.array_sort(F.collect_set(column))
    return F.array_join(F.slice(values, 1, most) if most else values, ";")
