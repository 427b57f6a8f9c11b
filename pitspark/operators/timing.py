"""Labels with explicit timing: feature, decision, entry, exit and label instants."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.reasons import null_unless_finite, require_zero
from ..functions.times import epoch_micros, utc_midnight
from .features import FEATURE_COLUMNS, raw_features
from .regime import REGIME_COLUMNS, regime_as_of
from .sessions import is_crypto, minutes, schedule

CONTRACT_VERSION = "daily_timing_v3"
LOOKBACK_SESSIONS = 21
TIMING_COLUMNS = ["feature_date", "feature_available_at", "decision_at", "entry_at", "exit_at", "label_available_at"]

OUTPUT_SCHEMA = (
    "symbol string, target_session date, "
    + ", ".join(f"{c} double" for c in FEATURE_COLUMNS + REGIME_COLUMNS)
    + ", target_return double, target int, feature_date date, feature_available_at timestamp, "
    "decision_at timestamp, entry_at timestamp, exit_at timestamp, label_available_at timestamp, "
    "target_contract_version string"
)


def empty_dataset(spark) -> DataFrame:
    """Typed result without rows."""
    return spark.createDataFrame([], OUTPUT_SCHEMA)


def on_calendar(bars: DataFrame, sessions: DataFrame, day: str = "d") -> DataFrame:
    """Drop equity bars dated off the exchange calendar; crypto keeps every day."""
    cal = schedule(sessions).select(F.col("session_date").alias(day))
    crypto = is_crypto(F.col("symbol"))
    return bars.filter(crypto).unionByName(bars.filter(~crypto).join(cal, day, "left_semi"))


def expected_sessions(bars: DataFrame, sessions: DataFrame, day: str = "d") -> DataFrame:
    """Every (symbol, day) a bar is expected for, between the symbol's first and last bar."""
    spans = bars.groupBy("symbol").agg(F.min(day).alias("_from"), F.max(day).alias("_to"))
    crypto = is_crypto(F.col("symbol"))
    daily = spans.select("symbol", F.explode(F.sequence("_from", "_to")).alias(day))
    cal = schedule(sessions).select(F.col("session_date").alias(day))
    return daily.filter(crypto).unionByName(daily.filter(~crypto).join(cal, day, "left_semi"))


def complete_lookback(bars: DataFrame, sessions: DataFrame, day: str = "d") -> DataFrame:
    """(symbol, day) whose last 21 expected sessions all have a bar."""
    present = bars.select("symbol", day, F.lit(1).alias("_present"))
    order = W.partitionBy("symbol").orderBy(day).rowsBetween(-(LOOKBACK_SESSIONS - 1), 0)
    counted = expected_sessions(bars, sessions, day).join(present, ["symbol", day], "left").withColumn(
        "_full", F.sum("_present").over(order) == LOOKBACK_SESSIONS
    )
    return counted.filter("_full").select("symbol", day)


def timing_dataset(bars: DataFrame, sessions: DataFrame, regime: DataFrame, complete_only: bool = True) -> DataFrame:
    """19 features, label and six timing columns per (symbol, target session).

    Equities take features from the exact previous exchange session and decide at
    00:30 UTC of the target day; crypto takes D-2 and decides at D-1 00:30 UTC.
    Features and labels become available 30 minutes after their session ends.
    """
    kept = on_calendar(bars, sessions)
    usable = raw_features(kept).join(complete_lookback(kept, sessions), ["symbol", "d"], "left_semi")
    own = usable.select(
        "symbol", F.col("d").alias("feature_date"), *[null_unless_finite(F.col(c)).alias(c) for c in FEATURE_COLUMNS]
    )
    cal = schedule(sessions).select(
        F.col("session_date").alias("d"), "open_at", "close_at", "previous_session", "previous_close_at"
    )
    crypto = is_crypto(F.col("symbol"))
    targets = kept.select("symbol", "d", (F.col("close") / F.col("open") - 1).alias("target_return"))
    day = utc_midnight(F.col("d"))
    dated = targets.join(cal, "d", "left").select(
        "symbol",
        F.col("d").alias("target_session"),
        "target_return",
        (F.col("target_return") > 0).cast("int").alias("target"),
        F.when(crypto, F.date_sub("d", 2)).otherwise(F.col("previous_session")).alias("feature_date"),
        F.when(crypto, minutes(utc_midnight(F.col("d"), -1), 30))
        .otherwise(minutes(F.col("previous_close_at"), 30))
        .alias("feature_available_at"),
        F.when(crypto, minutes(utc_midnight(F.col("d"), -1), 30)).otherwise(minutes(day, 30)).alias("decision_at"),
        F.when(crypto, day).otherwise(F.col("open_at")).alias("entry_at"),
        F.when(crypto, utc_midnight(F.col("d"), 1)).otherwise(F.col("close_at")).alias("exit_at"),
    ).withColumn("label_available_at", minutes(F.col("exit_at"), 30))
    joined = dated.join(own, ["symbol", "feature_date"], "inner" if complete_only else "left")
    with_regime = regime_as_of(
        joined.withColumn("_decision_us", epoch_micros(F.col("decision_at"))), regime, "_decision_us"
    ).withColumn("target_contract_version", F.lit(CONTRACT_VERSION))
    required = FEATURE_COLUMNS + REGIME_COLUMNS + TIMING_COLUMNS
    out = with_regime.select(
        "symbol", "target_session", *FEATURE_COLUMNS, *REGIME_COLUMNS, "target_return", "target", *TIMING_COLUMNS,
        "target_contract_version",
    )
    return out.dropna(subset=required) if complete_only else out


def chronology_checks() -> dict:
    steps = [
        (F.col("feature_date").cast("timestamp") < F.col("feature_available_at")),
        F.col("feature_available_at") <= F.col("decision_at"),
        F.col("decision_at") < F.col("entry_at"),
        F.col("entry_at") < F.col("exit_at"),
        F.col("exit_at") < F.col("label_available_at"),
    ]
    return {"chronology": ~reduce(lambda a, b: a & b, steps)}


def require_chronology(dataset: DataFrame) -> DataFrame:
    return require_zero(dataset, chronology_checks())
