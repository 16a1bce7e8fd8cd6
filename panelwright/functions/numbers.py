"""Numerals as people and printed tables write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import norm_label
from .nulls import let


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def parse_count(text: str | Column, dash_zero: bool = False) -> Column:
    """A count written with '.' for thousands and ',' for decimals, or the other way where groups tell.

    One kind of separator stands for thousands if every group after the first has three digits,
    else for a decimal; with both, dots group and the comma is decimal. A lone dash is a printed
    nil: 0 if ``dash_zero``, else null. Blank, missing-value marks and the unreadable are null.
    """
    raw = F.trim(_col(text).cast("string"))
    digits = F.regexp_replace(raw, r"[^0-9,.\-]", "")
    dot, comma = F.contains(digits, F.lit(".")), F.contains(digits, F.lit(","))
    grouped = lambda sep: F.forall(F.filter(F.split(digits, sep), lambda _, i: i > 0), lambda p: F.length(p) == 3)
    drop = lambda sep: F.replace(digits, F.lit(sep), F.lit(""))
    plain = (
        F.when(dot & comma, F.replace(drop("."), F.lit(","), F.lit(".")))
        .when(dot & grouped("\\."), drop("."))
        .when(comma & grouped(","), drop(","))
        .when(comma, F.replace(digits, F.lit(","), F.lit(".")))
        .otherwise(digits)
    )
    dashes, marks = ["-", "–", "—"], ["", "nan", "None", "n.a.", "na", "NA", "..."]
    return (
        F.when(raw.isin(dashes), F.lit(0.0 if dash_zero else None).cast("double"))
        .when(raw.isin(marks) | digits.isin("", "-"), F.lit(None).cast("double"))
        .otherwise(plain.try_cast("double"))
    )


def watermarked_count(text: str | Column) -> Column:
    """Digits of a cell whose other characters come from a watermark; a lone dash is 0."""
    raw = F.trim(_col(text).cast("string"))
    digits = F.regexp_replace(raw, r"\D", "")
    return F.when(raw.rlike(r"^[\-–—]+$"), F.lit(0.0)).when(F.length(digits) > 0, digits.try_cast("double"))


def percent_value(text: str | Column) -> Column:
    """A percentage of a printed cell: its first number with a decimal comma, else its digits; dashes alone are 0.

    Letters of a watermark and white space are dropped; nothing left is null.
    """
    def of(s: Column) -> Column:
        decimal = F.regexp_extract(s, r"(\d{1,3},\d{1,4})", 1)
        return (
            F.when(s.rlike(r"^[\-–_.]+$"), F.lit(0.0))
            .when(decimal != "", F.replace(decimal, F.lit(","), F.lit(".")).try_cast("double"))
            .otherwise(F.nullif(F.regexp_replace(s, r"\D", ""), F.lit("")).try_cast("double"))
        )

    return let(F.regexp_replace(_col(text).cast("string"), r"[^\d,.\-–_]", ""), of)


def is_percent_table(cells: str | Column) -> Column:
    """An array of cells is a percent table if it has four cells with digits and half of them are comma decimals."""
    numeric = F.filter(_col(cells), lambda c: F.coalesce(c.rlike(r"\d"), F.lit(False)))
    decimal = F.filter(numeric, lambda c: c.rlike(r"\d{1,3}\s*,\s*\d{1,4}"))
    return (F.size(numeric) >= 4) & (2 * F.size(decimal) >= F.size(numeric))


def unit_scale(unit: str | Column, title: str | Column) -> Column:
    """Factor of a table's unit of count; the title decides only where there is no unit."""
    def of(u: Column) -> Column:
        none = u.isin("", "tidak ada satuan", "none") & F.coalesce(F.contains(norm_label(title), F.lit("ribu")), F.lit(False))
        return F.when(F.contains(u, F.lit("ribu")) | F.contains(u, F.lit("000")), 1e3).when(F.contains(u, F.lit("juta")), 1e6).when(none, 1e3).otherwise(1.0)

    return let(F.coalesce(norm_label(unit), F.lit("")), of)
