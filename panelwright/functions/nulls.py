"""Column helpers with explicit null semantics."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def yes(condition: Column) -> Column:
    """A predicate whose unknown counts as false, so that its negation is true there."""
    return F.coalesce(condition, F.lit(False))


def group_sum(column: str | Column) -> Column:
    """Sum over a group; 0, not null, if nothing adds up."""
    return F.coalesce(F.sum(column), F.lit(0))


def safe_ratio(part: str | Column, whole: str | Column) -> Column:
    """part / whole where whole is positive, else null."""
    part, whole = (F.col(x) if isinstance(x, str) else x for x in (part, whole))
    return F.when(whole > 0, part / whole)


def padded(column: str | Column, width: int = 4) -> Column:
    """Trimmed code, filled with zeros on the left to ``width``; longer codes stay whole."""
    code = F.trim((F.col(column) if isinstance(column, str) else column).cast("string"))
    return F.when(F.length(code) < width, F.lpad(code, width, "0")).otherwise(code)


def blank_to_null(column: str | Column) -> Column:
    """Trimmed text, null if nothing is left."""
    return F.nullif(F.trim(F.col(column) if isinstance(column, str) else column), F.lit(""))


def row_sum(columns: list[str]) -> Column:
    """Sum over the columns of a row; null if all are null."""
    total = reduce(add, [F.coalesce(F.col(c), F.lit(0.0)) for c in columns])
    return F.when(F.coalesce(*[F.col(c) for c in columns]).isNotNull(), total)


def half_even(value: Column, digits: int = 0) -> Column:
    """Round with ties to the even neighbour; whether a double is a tie is told after its multiplication, as numpy does."""
    return F.rint(value * 10.0**digits) / 10.0**digits if digits else F.rint(value)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with columns that are computed once.

    Filters over an ordinary derived column are rewritten over its inputs; through a chain of
    derivations, each naming its inputs many times, the plan then grows beyond bounds. A row's
    worth of ``inline`` stops that rewriting and costs no shuffle.
    """
    fresh = F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    return df.select(*[c for c in df.columns if c not in columns], fresh)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)
