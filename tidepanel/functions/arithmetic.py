"""Null-keeping scalar helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """``x`` within bounds; null stays null, which bare least and greatest would turn into a bound."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))


def ratio(num: Column, den: Column, low: float | None = None, high: float | None = None) -> Column:
    """num / den, null where den is 0 or null."""
    out = num / F.nullif(den, F.lit(0))
    return out if low is None else clip(out, low, high)


def zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def total(columns: list[str]) -> Column:
    """The sum of the columns, null as 0."""
    out = F.lit(0.0)
    for c in columns:
        out = out + zero(F.col(c))
    return out


def in_use(columns: list[str]) -> Column:
    """How many of the columns are above 0."""
    out = F.lit(0)
    for c in columns:
        out = out + (zero(F.col(c)) > 0).cast("int")
    return out


def not_nan(x: Column) -> Column:
    """NaN as null: a NaN would pass ``IS NOT NULL``, sort highest and spoil means."""
    return F.when(~F.isnan(x), x)
