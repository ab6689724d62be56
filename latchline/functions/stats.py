"""Statistics as column expressions; nulls in the input never count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sorted_values(value: Column) -> Column:
    """All values of a group in order.  Only for groups that an earlier limit bounds."""
    return F.array_sort(F.collect_list(value))


def by_index(values: Column, q: float) -> Column:
    """``values[min(int(n * q), n - 1)]`` of a sorted array; the upper median for q = 0.5."""
    n = F.size(values)
    return F.get(values, F.least((n * q).cast("int"), n - 1))


def interpolated(value: Column, q: float) -> Column:
    """Linear interpolation at place ``(n - 1) * q``, exact."""
    return F.percentile(value, q)


def slope(y: Column, x: Column) -> Column:
    """Least-squares slope, 0 with fewer than two points."""
    return F.when(F.count(y) < 2, F.lit(0.0)).otherwise(F.coalesce(F.regr_slope(y, x), F.lit(0.0)))


def clamped(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def spread(value: Column) -> Column:
    """Population standard deviation, 0 with fewer than two values."""
    return F.coalesce(F.when(F.count(value) >= 2, F.stddev_pop(value)), F.lit(0.0))
