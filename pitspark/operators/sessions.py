"""Session calendar lookups, completed bars and capture plans.

The calendar is an input table (one row per exchange session). Crypto trades in
UTC days and needs no table. Symbols ending in ``-USD`` are crypto; the capture
plans use the slash form of the pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.reasons import require_zero
from ..functions.times import utc_midnight

PUBLICATION_MINUTES = 30
CRYPTO_PAIR = "BTC/USD"


def minutes(stamp: Column, n: Column | int) -> Column:
    return F.timestamp_add("MINUTE", F.lit(n) if isinstance(n, int) else n, stamp)


def seconds(stamp: Column, n: int) -> Column:
    return F.timestamp_add("SECOND", F.lit(n), stamp)


def is_crypto(symbol: Column) -> Column:
    return F.upper(symbol).endswith("-USD")


def _schedule(sessions: DataFrame) -> DataFrame:
    """Calendar keyed by day with previous and next session: one row per session day."""
    order = W.partitionBy("calendar").orderBy("session_date")
    return sessions.select(
        "calendar",
        "session_date",
        "open_at",
        "close_at",
        F.lag("session_date").over(order).alias("previous_session"),
        F.lag("close_at").over(order).alias("previous_close_at"),
        F.lead("session_date").over(order).alias("next_session"),
        F.lead("open_at").over(order).alias("next_open_at"),
        F.lead("close_at").over(order).alias("next_close_at"),
    )


def schedule(sessions: DataFrame, calendar: str = "XNYS") -> DataFrame:
    return _schedule(sessions.filter(F.col("calendar") == calendar)).drop("calendar")


def session_bounds(rows: DataFrame, sessions: DataFrame, day: str = "d") -> DataFrame:
    """Adds ``open_at``/``close_at``; ``is_session`` is FALSE for an equity day off the calendar."""
    cal = schedule(sessions).select(F.col("session_date").alias(day), "open_at", "close_at")
    joined = rows.join(cal, day, "left")
    crypto = is_crypto(F.col("symbol"))
    return joined.withColumns(
        {
            "open_at": F.when(crypto, utc_midnight(F.col(day))).otherwise(F.col("open_at")),
            "close_at": F.when(crypto, utc_midnight(F.col(day), 1)).otherwise(F.col("close_at")),
        }
    ).withColumn("is_session", F.col("open_at").isNotNull())


def next_session(rows: DataFrame, sessions: DataFrame, day: str = "d") -> DataFrame:
    """Adds ``next_session``; NULL for an equity day that is not a session (see ``require_sessions``)."""
    cal = schedule(sessions).select(F.col("session_date").alias(day), "next_session")
    joined = rows.join(cal, day, "left")
    return joined.withColumn(
        "next_session", F.when(is_crypto(F.col("symbol")), F.date_add(day, 1)).otherwise(F.col("next_session"))
    )


def require_sessions(rows: DataFrame) -> DataFrame:
    return require_zero(rows, {"feature date is not a session": F.col("next_session").isNull()})


def completed_bars(bars: DataFrame, sessions: DataFrame, now: Column, day: str = "d") -> DataFrame:
    """Bars whose session closed at least 30 minutes before ``now``; off-calendar equity rows drop."""
    bounded = session_bounds(bars, sessions, day)
    ready = minutes(F.col("close_at"), PUBLICATION_MINUTES) <= now
    return bounded.filter(F.coalesce(ready, F.lit(False))).select(*bars.columns)


def valid_bar(tolerance: float = 1e-12) -> Column:
    """Single settlement bar: finite positive OHLC within bounds."""
    o, h, l, c = (F.col(n) for n in ("open", "high", "low", "close"))
    slack = F.greatest(o, h, l, c) * tolerance
    broken = (h + slack < F.greatest(o, c)) | (l - slack > F.least(o, c)) | (l > h)
    prices_ok = (F.least(o, h, l, c) > 0) & (F.greatest(o, h, l, c) < F.lit(float("inf")))
    present = o.isNotNull() & h.isNotNull() & l.isNotNull() & c.isNotNull()
    return F.coalesce(present & prices_ok & ~broken, F.lit(False))


def _completed_sessions(sessions: DataFrame, now: Column) -> DataFrame:
    return schedule(sessions).filter(minutes(F.col("close_at"), PUBLICATION_MINUTES) <= now)


def study_plan(symbols: DataFrame, sessions: DataFrame, now: Column, last_sessions: int, stock_feed: str = "sip"):
    """Three targets per planned session for the latest completed sessions.

    Equities: open + 5 min, midpoint floored to the minute, close - 5 min.
    Crypto pair: 00:35, 12:00 and 23:55 UTC of the latest completed UTC days.
    """
    rank = W.partitionBy(F.lit(0)).orderBy(F.desc("session_date"))
    stock_days = (
        _completed_sessions(sessions, now)
        .withColumn("_rn", F.row_number().over(rank))
        .filter(F.col("_rn") <= last_sessions)
        .select("session_date", "open_at", "close_at")
    )
    half = (F.unix_micros("close_at") - F.unix_micros("open_at")) / 2
    middle = F.date_trunc("minute", F.timestamp_micros((F.unix_micros("open_at") + half).cast("bigint")))
    stock = stock_days.select(
        "session_date", "open_at", "close_at", minutes(F.col("open_at"), 5).alias("opening"),
        middle.alias("midday"), minutes(F.col("close_at"), -5).alias("closing"),
    )
    latest_day = F.date_sub(F.to_date(minutes(now, -PUBLICATION_MINUTES)), 1)
    crypto_day = symbols.filter(F.col("symbol") == CRYPTO_PAIR).select("symbol").distinct().select(
        "symbol",
        F.explode(F.sequence(F.date_sub(latest_day, last_sessions - 1), latest_day)).alias("session_date"),
    )
    start = utc_midnight(F.col("session_date"))
    crypto = crypto_day.select(
        "symbol", "session_date", start.alias("open_at"), utc_midnight(F.col("session_date"), 1).alias("close_at"),
        minutes(start, 35).alias("opening"), minutes(start, 720).alias("midday"), minutes(start, 1435).alias("closing"),
        F.lit("crypto_us").alias("feed"),
    )
    equities = symbols.filter(F.col("symbol") != CRYPTO_PAIR).select("symbol").distinct()
    # the plan is symbols x the last few sessions
    days = stock.agg(F.collect_list(F.struct(*stock.columns))).scalar()  # last_sessions rows at most
    planned = equities.select("symbol", F.inline(days)).withColumn("feed", F.lit(stock_feed)).unionByName(crypto)
    targets = F.array(
        *[F.struct(F.lit(n).alias("window_name"), F.col(n).alias("target_at")) for n in ("opening", "midday", "closing")]
    )
    return planned.select("symbol", "session_date", "feed", "open_at", "close_at", F.inline(targets))


def capture_windows(sessions: DataFrame, now: Column) -> DataFrame:
    """Entry and exit targets of the latest completed exchange session and UTC day."""
    crypto_day = F.date_sub(F.to_date(minutes(now, -PUBLICATION_MINUTES)), 1)
    latest = _completed_sessions(sessions, now).agg(
        F.max_by(F.struct("session_date", "open_at", "close_at"), "session_date").alias("s")
    )
    stock = latest.select(
        F.lit("stocks").alias("market"), "s.session_date", F.col("s.open_at").alias("session_start"),
        F.col("s.close_at").alias("session_end"), minutes(F.col("s.open_at"), 5).alias("entry_at"),
        minutes(F.col("s.close_at"), -5).alias("exit_at"),
    )
    start = crypto_day.cast("timestamp")
    crypto = latest.select(
        F.lit("crypto").alias("market"), crypto_day.alias("session_date"), start.alias("session_start"),
        F.timestamp_add("DAY", F.lit(1), start).alias("session_end"), minutes(start, 35).alias("entry_at"),
        minutes(start, 1435).alias("exit_at"),
    )
    return stock.unionByName(crypto)


def replay_windows(plan: DataFrame) -> DataFrame:
    """[target-5 s, target+2 s) for every planned target, flagged when it leaves its session."""
    start, end = seconds(F.col("target_at"), -5), seconds(F.col("target_at"), 2)
    inside = (F.col("open_at") <= start) & (end <= F.col("close_at"))
    return plan.select("*", start.alias("window_start"), end.alias("window_end"), inside.alias("inside_session"))


def require_inside(windows: DataFrame) -> DataFrame:
    return require_zero(windows, {"window leaves its session": ~F.col("inside_session")})


def eligible_symbols(symbols: DataFrame, sessions: DataFrame, now: Column) -> DataFrame:
    """Each requested symbol once, with ``eligible`` and the reason when it is skipped.

    Eligible: an equity, and the target after the latest finished session has not
    opened (one minute of margin).
    """
    finished = _completed_sessions(sessions, now).agg(
        F.max_by(
            F.struct(
                F.col("next_open_at").alias("target_open"), F.col("next_session").alias("target_session"),
                F.col("session_date").alias("feature_session"),
            ),
            "session_date",
        )
    ).scalar()
    open_ahead = F.coalesce(now < minutes(F.col("target_open"), -1), F.lit(False))
    crypto = F.col("symbol").endswith("-USD")
    return (
        symbols.select("symbol").distinct().select("symbol", finished.alias("_f")).select("symbol", "_f.*")
        .select(
            "symbol", "feature_session", "target_session", (~crypto & open_ahead).alias("eligible"),
            F.when(crypto, "crypto_requires_delayed_entry_target")
            .when(~open_ahead, "no_future_session_with_completed_features").alias("reason"),
        )
    )
