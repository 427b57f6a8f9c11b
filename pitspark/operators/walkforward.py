"""Chronological splits, expanding folds with purge, availability-purged folds.

Fold geometry depends on distinct dates only, so it is computed on a date table.
Training statistics per fold come from per-date totals, never from joining every
row to every fold.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.reasons import finite, require_unique, require_zero, ValidationError
from .timing import CONTRACT_VERSION, chronology_checks


@dataclass(frozen=True)
class Protocol:
    """Fold sizes in distinct sessions."""

    min_train: int = 1260
    test: int = 252
    purge: int = 5
    max_folds: int = 12

    def __post_init__(self):
        if min(self.min_train, self.test, self.max_folds) <= 0 or self.purge < 0:
            raise ValueError("training, test and fold counts must be positive; purge must be nonnegative")


def date_index(rows: DataFrame, day: str = "d") -> DataFrame:
    """(day, idx, n): distinct dates numbered from zero."""
    order = W.partitionBy(F.lit(0)).orderBy(day)
    whole = W.partitionBy(F.lit(0))
    dates = rows.select(day).distinct()
    return dates.select(day, (F.row_number().over(order) - 1).alias("idx"), F.count(F.lit(1)).over(whole).alias("n"))


def require_dates(dates: DataFrame, minimum: int) -> DataFrame:
    if dates.count() < minimum:
        raise ValidationError(f"at least {minimum} unique sessions are required")
    return dates


def chronological_split(rows: DataFrame, test_fraction: float = 0.20, purge: int = 5, day: str = "d") -> DataFrame:
    """Adds ``role``: train, purged or test by distinct date."""
    if not 0.0 < test_fraction < 1.0 or purge < 0:
        raise ValueError("test_fraction must lie in (0, 1) and purge must be nonnegative")
    dates = date_index(rows, day)
    split = F.floor(F.col("n") * (1.0 - test_fraction)).cast("int")
    role = F.when(F.col("idx") >= split, "test").when(F.col("idx") < split - purge, "train").otherwise("purged")
    return rows.join(dates.select(day, role.alias("role")), day)


def fold_dates(rows: DataFrame, protocol: Protocol, day: str = "d") -> DataFrame:
    """(day, idx, fold): fold is NULL before the first test session."""
    dates = date_index(rows, day)
    start = F.greatest(F.lit(protocol.min_train + protocol.purge), F.col("n") - protocol.max_folds * protocol.test)
    fold = F.when(F.col("idx") >= start, F.floor((F.col("idx") - start) / protocol.test).cast("int") + 1)
    return dates.select(day, "idx", fold.alias("fold"))


def folds(dated: DataFrame, protocol: Protocol) -> DataFrame:
    """(fold, test_from, train_to): at most ``max_folds`` rows; train is ``idx < train_to``."""
    return dated.filter(F.col("fold").isNotNull()).groupBy("fold").agg(F.min("idx").alias("test_from")).withColumn(
        "train_to", F.col("test_from") - protocol.purge
    )


def test_rows(rows: DataFrame, dated: DataFrame, day: str = "d") -> DataFrame:
    return rows.join(dated.filter(F.col("fold").isNotNull()).select(day, "fold"), day)


def _fold_totals(per_date: DataFrame, fold_table: DataFrame, extra=None) -> DataFrame:
    """Per-date totals against at most ``max_folds`` fold rows."""
    known = F.col("idx") < F.col("train_to")
    if extra is not None:
        known = known & extra
    return per_date.join(F.broadcast(fold_table), known)


def base_rates(rows: DataFrame, dated: DataFrame, protocol: Protocol, day: str = "d") -> DataFrame:
    """Training base rate, rows and date range per fold."""
    per_date = (
        rows.groupBy(day).agg(F.count(F.lit(1)).alias("_rows"), F.sum("target").alias("_pos"))
        .join(dated.select(day, "idx"), day)
    )
    return _fold_totals(per_date, folds(dated, protocol)).groupBy("fold").agg(
        F.min(day).alias("train_start"), F.max(day).alias("train_end"), F.sum("_rows").alias("train_rows"),
        (F.sum("_pos") / F.sum("_rows")).alias("base_probability"),
    )


def purged_base_rates(rows: DataFrame, dated: DataFrame, protocol: Protocol, day: str = "d") -> DataFrame:
    """As ``base_rates``, keeping only labels available before the fold's first decision."""
    first_decision = test_rows(rows, dated, day).groupBy("fold").agg(F.min("decision_at").alias("first_decision_at"))
    table = folds(dated, protocol).join(first_decision, "fold")
    per_label = (
        rows.groupBy(day, "label_available_at").agg(F.count(F.lit(1)).alias("_rows"), F.sum("target").alias("_pos"))
        .join(dated.select(day, "idx"), day)
    )
    known = F.col("label_available_at") < F.col("first_decision_at")
    return _fold_totals(per_label, table, known).groupBy("fold", "first_decision_at").agg(
        F.min(day).alias("train_start"), F.max(day).alias("train_end"), F.count_distinct(day).alias("train_sessions"),
        F.sum("_rows").alias("train_rows"), (F.sum("_pos") / F.sum("_rows")).alias("base_probability"),
        F.max("label_available_at").alias("last_label_available_at"),
    )


def require_trainable(rates: DataFrame, protocol: Protocol) -> DataFrame:
    """Every fold needs both classes and, when purged by availability, enough sessions."""
    checks = {"fold lacks both classes": (F.col("base_probability") <= 0) | (F.col("base_probability") >= 1)}
    if "train_sessions" in rates.columns:
        checks["fold lacks training sessions"] = F.col("train_sessions") < protocol.min_train
    return require_zero(rates, checks)


def base_rate_predictions(rows: DataFrame, protocol: Protocol, day: str = "d") -> DataFrame:
    """Test rows with their fold's training base rate as ``base_probability``."""
    dated = fold_dates(rows, protocol, day)
    rates = base_rates(rows, dated, protocol, day).select("fold", "base_probability")
    return test_rows(rows, dated, day).join(F.broadcast(rates), "fold")  # at most max_folds rows


def validate_dataset(rows: DataFrame, symbols: list[str], features: list[str]) -> DataFrame:
    """Fail closed on an empty set, another universe, duplicate keys, labels that disagree, bad order."""
    present = {r["symbol"] for r in rows.select("symbol").distinct().limit(len(symbols) + 1).collect()}
    if present != set(symbols):
        raise ValidationError("each declared symbol must have usable data; the universe may not change")
    require_unique(rows, ["symbol", "target_session"], "target session")
    return require_zero(rows, dataset_checks(features))


def dataset_checks(features: list[str]) -> dict[str, Column]:
    """What no row of a dataset may be: nonfinite, at odds with its label, of another contract or out of order."""
    values_ok = F.lit(True)
    for name in [*features, "target_return"]:
        values_ok = values_ok & finite(F.col(name))
    return {
        "nonfinite value": ~values_ok,
        "label": ~F.col("target").isin(0, 1) | (F.col("target") != (F.col("target_return") > 0).cast("int")),
        "contract": F.col("target_contract_version") != CONTRACT_VERSION,
        **chronology_checks(),
    }
