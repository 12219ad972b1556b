"""Small column expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(condition: Column) -> Column:
    """1 or 0; a comparison with null is 0."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null when b is 0."""
    return F.try_divide(a, b)


def label(condition: Column, yes: str, no: str) -> Column:
    """Two-way label; null takes the second one."""
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))


def confidence(p: Column) -> Column:
    """Probability above one half, scaled to 0..1."""
    return F.greatest(p - 0.5, F.lit(0.0)) * 2


def to_null(x: Column) -> Column:
    """NaN becomes null, so that comparisons behave."""
    return F.when(~F.isnan(x), x)


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")
