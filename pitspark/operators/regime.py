"""Market-regime context: panel features and their availability-based attach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.asof import CALENDAR, asof_join
from ..functions.reasons import finite, null_unless_finite, require_unique, require_zero, ValidationError
from ..functions.rolling import pct_change, rolling_std
from ..functions.times import epoch_micros

# Context symbols, regime columns and the age limit of a match.
CONTEXT_SYMBOLS = ("SPY", "QQQ", "IWM", "^VIX", "^TNX")
REGIME_COLUMNS = [
    "market_return_1",
    "market_return_20",
    "market_volatility_20",
    "growth_relative_20",
    "small_relative_20",
    "vix_level",
    "vix_change_5",
    "rate_level",
    "rate_change_20",
]
MAX_CONTEXT_AGE_US = 7 * 86_400 * 1_000_000


def validate_context(bars: DataFrame) -> DataFrame:
    """Every context symbol present, one finite positive close per day."""
    context = bars.filter(F.col("symbol").isin(*CONTEXT_SYMBOLS))
    present = {r["symbol"] for r in context.select("symbol").distinct().collect()}  # at most five rows
    missing = sorted(set(CONTEXT_SYMBOLS) - present)
    if missing:
        raise ValidationError(f"missing market context symbols: {missing}")
    require_unique(context, ["symbol", "d"], "context bar")
    return require_zero(context, context_checks())


def context_checks() -> dict:
    return {"missing_day": F.col("d").isNull(), "invalid_close": ~finite(F.col("close")) | (F.col("close") <= 0)}


def regime_table(bars: DataFrame) -> DataFrame:
    """(d, nine regime columns), NULL where a series has no value that day.

    Equity columns run over the days on which all three equity series exist; the
    volatility and rate changes run over their own days. One row a day.
    """
    context = bars.filter(F.col("symbol").isin(*CONTEXT_SYMBOLS)).select("symbol", "d", "close")
    pick = lambda s: F.max(F.when(F.col("symbol") == s, F.col("close")))
    panel = context.groupBy("d").agg(
        pick("SPY").alias("spy"), pick("QQQ").alias("qqq"), pick("IWM").alias("iwm"),
        pick("^VIX").alias("vix"), pick("^TNX").alias("rate"),
    )
    # one row a day: a single ordered sequence of a few thousand rows
    days = W.partitionBy(F.lit(0)).orderBy("d")
    equity = panel.dropna(subset=["spy", "qqq", "iwm"]).withColumn("_r", pct_change(F.col("spy"), days, 1))
    spy20 = pct_change(F.col("spy"), days, 20)
    equity = equity.select(
        "d",
        F.col("_r").alias("market_return_1"),
        spy20.alias("market_return_20"),
        rolling_std(F.col("_r"), days, 20).alias("market_volatility_20"),
        (pct_change(F.col("qqq"), days, 20) - spy20).alias("growth_relative_20"),
        (pct_change(F.col("iwm"), days, 20) - spy20).alias("small_relative_20"),
    )
    vix = panel.dropna(subset=["vix"]).select(
        "d", F.col("vix").alias("vix_level"), pct_change(F.col("vix"), days, 5).alias("vix_change_5")
    )
    rate = panel.dropna(subset=["rate"]).select(
        "d", F.col("rate").alias("rate_level"), (F.col("rate") - F.lag("rate", 20).over(days)).alias("rate_change_20")
    )
    joined = equity.join(vix, "d", "full").join(rate, "d", "full")
    return joined.select("d", *[null_unless_finite(F.col(c)).alias(c) for c in REGIME_COLUMNS])


def regime_as_of(cutoffs: DataFrame, regime: DataFrame, cutoff: str) -> DataFrame:
    """``cutoffs`` plus the nine columns known at ``cutoff`` (epoch microseconds).

    A value dated D is available at D+1 00:00 UTC and goes stale after seven
    calendar days. Each column skips its own NULLs. The match runs on distinct
    cutoffs, which a calendar bounds, and is joined back to the rows.
    """
    available = regime.withColumn("_avail", epoch_micros(F.date_add("d", 1).cast("timestamp")))
    distinct = cutoffs.select(cutoff).distinct()
    matched = asof_join(
        distinct.withColumn("_k", F.lit(0)),
        available.withColumn("_k", F.lit(0)),
        ["_k"],
        cutoff,
        "_avail",
        {c: F.col(c) for c in REGIME_COLUMNS},
        tolerance=MAX_CONTEXT_AGE_US,
        bin_width=CALENDAR,
    ).select(cutoff, *REGIME_COLUMNS)
    return cutoffs.join(matched, cutoff, "left")


def attach_regime(dataset: DataFrame, regime: DataFrame, day: str = "d", complete_only: bool = True) -> DataFrame:
    """Attach by target date (cutoff = target day 00:00 UTC); drop incomplete rows."""
    rows = dataset.withColumn("_cutoff", epoch_micros(F.col(day).cast("timestamp")))
    joined = regime_as_of(rows, regime, "_cutoff").drop("_cutoff")
    return joined.dropna(subset=REGIME_COLUMNS) if complete_only else joined


def latest_regime(as_of: DataFrame, regime: DataFrame, day: str = "feature_as_of") -> DataFrame:
    """Regime known after a completed bar: cutoff is the following day 00:00 UTC."""
    rows = as_of.withColumn("_cutoff", epoch_micros(F.date_add(day, 1).cast("timestamp")))
    joined = regime_as_of(rows, regime, "_cutoff").drop("_cutoff")
    complete = F.lit(True)
    for name in REGIME_COLUMNS:
        complete = complete & F.col(name).isNotNull()
    return joined.withColumn("regime_complete", complete)
