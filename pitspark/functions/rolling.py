"""Row-count windows that stay NULL until they are full."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def trailing(order: WindowSpec, n: int) -> WindowSpec:
    return order.rowsBetween(-(n - 1), 0)


def full_window(column: Column, order: WindowSpec, n: int, aggregate) -> Column:
    """``aggregate`` over the last n rows, NULL unless all n values are present."""
    frame = trailing(order, n)
    return F.when(F.count(column).over(frame) == n, aggregate(column).over(frame))


def rolling_mean(column: Column, order: WindowSpec, n: int) -> Column:
    return full_window(column, order, n, F.avg)


def rolling_std(column: Column, order: WindowSpec, n: int) -> Column:
    return full_window(column, order, n, F.stddev_samp)


def pct_change(column: Column, order: WindowSpec, n: int) -> Column:
    return F.try_divide(column, F.lag(column, n).over(order)) - 1
