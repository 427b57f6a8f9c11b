"""Daily asset features and next-session labels.

Bars are one row per (symbol, day), so a symbol window holds one row a day for
however long the market has existed: it is bounded by the calendar, not by the
volume of the data the bars were built from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.reasons import null_unless_finite, ohlc_checks, require_unique, require_zero
from ..functions.rolling import full_window, pct_change, rolling_mean, rolling_std

CONTRACT_VERSION = "daily_pit_v2"
BOUND_TOLERANCE = 1e-12

# The ten daily features in contract order.
FEATURE_COLUMNS = [
    "return_1",
    "return_5",
    "return_20",
    "volatility_5",
    "volatility_20",
    "ma_gap_5",
    "ma_gap_20",
    "range_pct",
    "volume_z20",
    "rsi_14",
]


def validate_daily_bars(bars: DataFrame, key: str = "symbol", day: str = "d") -> DataFrame:
    """Fail closed on duplicate days, NULL, non-finite, non-positive or unordered OHLCV."""
    require_unique(bars, [key, day], "daily bar")
    return require_zero(bars, daily_bar_checks(day))


def daily_bar_checks(day: str = "d") -> dict:
    return {"missing_day": F.col(day).isNull(), **dict(ohlc_checks(BOUND_TOLERANCE))}


def raw_features(bars: DataFrame, key: str = "symbol", day: str = "d") -> DataFrame:
    """The ten features as known after each bar (not yet shifted)."""
    order = W.partitionBy(key).orderBy(day)
    close, volume, ret = F.col("close"), F.col("volume"), F.col("return_1")
    # three layers, so every window expression is evaluated once
    changes = bars.withColumns(
        {
            "return_1": pct_change(close, order, 1),
            "return_5": pct_change(close, order, 5),
            "return_20": pct_change(close, order, 20),
            "_change": close - F.lag(close).over(order),
            "_mean_5": rolling_mean(close, order, 5),
            "_mean_20": rolling_mean(close, order, 20),
            "_volume_mean": rolling_mean(volume, order, 20),
            "_volume_std": rolling_std(volume, order, 20),
        }
    )
    # greatest() skips NULL, so the first change needs its own guard
    gain = F.when(F.col("_change").isNotNull(), F.greatest(F.col("_change"), F.lit(0.0)))
    loss = F.when(F.col("_change").isNotNull(), F.greatest(-F.col("_change"), F.lit(0.0)))
    rolled = changes.withColumns(
        {
            "volatility_5": rolling_std(ret, order, 5),
            "volatility_20": rolling_std(ret, order, 20),
            "_up": full_window(gain, order, 14, F.avg),
            "_down": full_window(loss, order, 14, F.avg),
        }
    )
    up, down = F.col("_up"), F.col("_down")
    rsi = (
        F.when((down == 0) & (up > 0), F.lit(100.0))
        .when((down == 0) & (up == 0), F.lit(50.0))
        .otherwise(100.0 - 100.0 / (1.0 + F.try_divide(up, down)))
    )
    featured = rolled.withColumns(
        {
            "ma_gap_5": F.try_divide(close, F.col("_mean_5")) - 1,
            "ma_gap_20": F.try_divide(close, F.col("_mean_20")) - 1,
            "range_pct": F.try_divide(F.col("high") - F.col("low"), close),
            "volume_z20": F.try_divide(volume - F.col("_volume_mean"), F.nullif(F.col("_volume_std"), F.lit(0.0))),
            "rsi_14": F.when(up.isNotNull() & down.isNotNull(), rsi),
        }
    )
    return featured.select(*bars.columns, *FEATURE_COLUMNS)


def daily_dataset(bars: DataFrame, key: str = "symbol", day: str = "d", complete_only: bool = True) -> DataFrame:
    """Features shifted one session plus the open-to-close label of the target session."""
    order = W.partitionBy(key).orderBy(day)
    featured = raw_features(bars, key, day)
    shifted = {c: null_unless_finite(F.lag(c).over(order)) for c in FEATURE_COLUMNS}
    target_return = F.try_divide(F.col("close"), F.col("open")) - 1
    labelled = featured.select(
        key,
        day,
        *[shifted[c].alias(c) for c in FEATURE_COLUMNS],
        null_unless_finite(target_return).alias("target_return"),
    ).withColumn("target", (F.col("target_return") > 0).cast("int"))
    return labelled.dropna(subset=[*FEATURE_COLUMNS, "target_return"]) if complete_only else labelled


def latest_snapshot(bars: DataFrame, key: str = "symbol", day: str = "d") -> DataFrame:
    """Unshifted features of the latest bar per symbol, with a ``complete`` flag.

    An incomplete latest row is reported as such; an older row never replaces it.
    """
    featured = raw_features(bars, key, day)
    latest = W.partitionBy(key).orderBy(F.desc(day))
    row = featured.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1")
    complete = F.lit(True)
    for name in FEATURE_COLUMNS:
        complete = complete & null_unless_finite(F.col(name)).isNotNull()
    return row.select(key, F.col(day).alias("feature_as_of"), *FEATURE_COLUMNS, complete.alias("complete"))


def require_complete(snapshot: DataFrame) -> DataFrame:
    return require_zero(snapshot, {"not enough completed history": ~F.col("complete")})
