"""Reason codes, ordered classification and fail-closed gates.

A check is a pair ``(code, condition)``. A NULL condition counts as a failed
check, so malformed input never slips through as "unknown".
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Check = tuple[str, Column]


class ValidationError(ValueError):
    """A gate found rows that violate a contract."""


def failed(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(True))


def reason_array(checks: Iterable[Check]) -> Column:
    """All codes whose condition holds, in the order given."""
    codes = [F.when(failed(cond), F.lit(code)) for code, cond in checks]
    return F.array_compact(F.array(*codes))


def first_reason(checks: Iterable[Check]) -> Column:
    """Code of the first failing check, NULL when every check passes."""
    result = None
    for code, cond in checks:
        result = F.when(failed(cond), code) if result is None else result.when(failed(cond), code)
    return result


def violation_counts(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """One row with a BIGINT count per check: a single aggregate over the input."""
    return df.agg(*[F.count_if(failed(cond)).alias(name) for name, cond in checks.items()])


def require_zero(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Raise when any check fails on any row, else return the input unchanged."""
    row = violation_counts(df, checks).first()
    bad = {name: row[name] for name in checks if row[name]}
    if bad:
        raise ValidationError(", ".join(f"{name}: {count} rows" for name, count in bad.items()))
    return df


def require_unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    """Raise when a key occurs twice. Duplicates combine before the shuffle."""
    duplicate = df.groupBy(*keys).count().filter("count > 1").limit(1)
    if not duplicate.isEmpty():
        raise ValidationError(f"duplicate {what} key {tuple(keys)}")
    return df


def split_by_reason(df: DataFrame, checks: Iterable[Check], column: str = "reasons"):
    """(clean rows, quarantined rows with their reasons)."""
    tagged = df.withColumn(column, reason_array(checks))
    return tagged.filter(F.size(column) == 0).drop(column), tagged.filter(F.size(column) > 0)


def finite(column: Column) -> Column:
    """True for a number that is neither NULL, NaN nor infinite."""
    value = column.cast("double")
    infinite = F.abs(value) == F.lit(float("inf"))
    return F.coalesce(~F.isnan(value) & ~infinite, F.lit(False))


def null_unless_finite(column: Column) -> Column:
    return F.when(finite(column), column)


def ohlc_checks(tolerance: float = 0.0, prefix: str = "") -> list[Check]:
    """Daily or minute bar checks; ``tolerance`` is relative to the largest price."""
    o, h, l, c, v = (F.col(prefix + n) for n in ("open", "high", "low", "close", "volume"))
    slack = F.greatest(o, h, l, c) * tolerance
    return [
        ("nonfinite", ~(finite(o) & finite(h) & finite(l) & finite(c) & finite(v))),
        ("nonpositive_price", (F.least(o, h, l, c) <= 0)),
        ("negative_volume", v < 0),
        ("ohlc_bounds", (h + slack < F.greatest(o, c, l)) | (l - slack > F.least(o, c, h))),
    ]
