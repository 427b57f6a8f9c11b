"""Registered queries: daily features, regime, sessions and timing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features as feat
from ..operators import regime as reg
from ..operators import sessions as ses
from ..operators import timing
from . import oracle_features as O
from . import oracle_views as V
from . import views
from .registry import query

_D = "CAST(d AS VARCHAR) AS d"
_FEATURES = feat.FEATURE_COLUMNS
_REGIME = reg.REGIME_COLUMNS
_NOW = "2000-06-15 21:10:00"


# levels are quoted prices passed through, and their difference has seven digits at most:
# rounding those at six can tie differently
_LEVELS = ("vix_level", "rate_level")


def rounded(columns, digits=6):
    return [
        F.col(c) if c in _LEVELS else F.round(c, 9 if c == "rate_change_20" else digits).alias(c) for c in columns
    ]


def day_text(name="d"):
    return F.col(name).cast("string").alias(name)


@query("E1 E2 E3 E4 E5 E6 E7 E8 E9 E10 E16", V.with_views(V.BARS, O.raw_features()) + f"SELECT symbol, {_D}, {O.rounded(_FEATURES)} FROM raw")
def raw_daily_features(spark, sf):
    return feat.raw_features(views.bars(spark, sf)).select("symbol", day_text(), *rounded(_FEATURES))


_SHIFT = ", ".join(f"lag({c}) OVER (PARTITION BY symbol ORDER BY d) AS {c}" for c in _FEATURES)
_DATASET = f"""shifted AS (SELECT symbol, d, close/open-1 AS target_return, {_SHIFT} FROM raw),
dataset AS (SELECT *, CASE WHEN target_return>0 THEN 1 ELSE 0 END AS target FROM shifted
  WHERE {' AND '.join(c + ' IS NOT NULL' for c in _FEATURES)})"""


@query(
    "E12 E13 E14 E16 A24",
    V.with_views(V.BARS, O.raw_features(), _DATASET)
    + f"SELECT symbol, {_D}, round(target_return,6) AS target_return, CAST(target AS BIGINT) AS target, {O.rounded(_FEATURES)} FROM dataset",
)
def daily_features(spark, sf):
    return feat.daily_dataset(views.bars(spark, sf)).select(
        "symbol", day_text(), F.round("target_return", 6).alias("target_return"), F.col("target").cast("bigint").alias("target"),
        *rounded(_FEATURES),
    )


@query(
    "E15",
    V.with_views(V.BARS, O.raw_features())
    + f"SELECT symbol, CAST(d AS VARCHAR) AS feature_as_of, {O.rounded(_FEATURES)} FROM raw "
    "QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC)=1",
)
def latest_features(spark, sf):
    snapshot = feat.latest_snapshot(views.bars(spark, sf))
    return snapshot.select("symbol", day_text("feature_as_of"), *rounded(_FEATURES))


@query(
    "G4",
    V.with_views(V.BARS)
    + """SELECT symbol, count(*) AS bars, count(*)-count(DISTINCT d) AS duplicate_days,
 count(*) FILTER (least(open,high,low,close)<=0) AS nonpositive_price, count(*) FILTER (volume<0) AS negative_volume,
 count(*) FILTER (high+greatest(open,high,low,close)*1e-12<greatest(open,close,low)
   OR low-greatest(open,high,low,close)*1e-12>least(open,close,high)) AS ohlc_bounds FROM bars GROUP BY symbol""",
)
def bar_validation_report(spark, sf):
    from ..functions.reasons import ohlc_checks

    checks = dict(ohlc_checks(feat.BOUND_TOLERANCE))
    return (
        views.bars(spark, sf).groupBy("symbol", "d").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(checks[c]).alias(c) for c in ("nonpositive_price", "negative_volume", "ohlc_bounds")],
        ).groupBy("symbol").agg(
            F.sum("n").alias("bars"), F.sum(F.col("n") - 1).alias("duplicate_days"),
            *[F.sum(c).alias(c) for c in ("nonpositive_price", "negative_volume", "ohlc_bounds")],
        )
    )


@query(
    "F1 F2 F3 F4 F5 F6 F7 F8 F9 F10",
    V.with_views(V.BARS, O.regime_table()) + f"SELECT {_D}, {O.rounded(_REGIME)} FROM regime",
)
def regime_context(spark, sf):
    return reg.regime_table(views.bars(spark, sf)).select(day_text(), *rounded(_REGIME))


@query(
    "F11 F13",
    V.with_views(
        V.BARS, O.raw_features(), _DATASET, O.regime_table(),
        "keyed AS (SELECT *, d::TIMESTAMP AS cut FROM dataset)", O.regime_attach("keyed", "cut"),
    )
    + f"SELECT symbol, {_D}, CAST(target AS BIGINT) AS target, {O.rounded(_REGIME)} FROM attached WHERE "
    + " AND ".join(f"{c} IS NOT NULL" for c in _REGIME),
)
def regime_attached(spark, sf):
    bars = views.stored(views.bars(spark, sf))
    joined = reg.attach_regime(feat.daily_dataset(bars), reg.regime_table(bars))
    return joined.select("symbol", day_text(), F.col("target").cast("bigint").alias("target"), *rounded(_REGIME))


@query(
    "F14",
    V.with_views(
        V.BARS, O.regime_table(),
        "lastday AS (SELECT symbol, max(d) AS d, max(d)::TIMESTAMP + INTERVAL 1 DAY AS cut FROM bars GROUP BY symbol)",
        O.regime_attach("lastday", "cut"),
    )
    + f"SELECT symbol, CAST(d AS VARCHAR) AS feature_as_of, {O.rounded(_REGIME)} FROM attached",
)
def latest_regime(spark, sf):
    bars = views.stored(views.bars(spark, sf))
    last = bars.groupBy("symbol").agg(F.max("d").alias("feature_as_of"))
    return reg.latest_regime(last, reg.regime_table(bars)).select("symbol", day_text("feature_as_of"), *rounded(_REGIME))


_SCHEDULE = """cal AS (SELECT *, lag(session_date) OVER (ORDER BY session_date) AS previous_session,
  lag(close_at) OVER (ORDER BY session_date) AS previous_close_at, lead(session_date) OVER (ORDER BY session_date) AS next_session,
  lead(open_at) OVER (ORDER BY session_date) AS next_open_at FROM sessions)"""


@query(
    "G1 G2",
    V.with_views(V.BARS, V.SESSIONS, _SCHEDULE)
    + f"""SELECT b.symbol, CAST(b.d AS VARCHAR) AS d,
  epoch_us(CASE WHEN symbol LIKE '%-USD' THEN b.d::TIMESTAMP ELSE open_at END) AS open_us,
  epoch_us(CASE WHEN symbol LIKE '%-USD' THEN b.d::TIMESTAMP + INTERVAL 1 DAY ELSE close_at END) AS close_us,
  CAST(CASE WHEN symbol LIKE '%-USD' THEN b.d+1 ELSE next_session END AS VARCHAR) AS next_session
  FROM bars b LEFT JOIN cal ON b.d=cal.session_date""",
)
def session_lookup(spark, sf):
    cal = views.sessions(spark, sf)
    rows = views.bars(spark, sf).select("symbol", "d")
    bounded = ses.next_session(ses.session_bounds(rows, cal), cal)
    return bounded.select(
        "symbol", day_text(), F.unix_micros("open_at").alias("open_us"), F.unix_micros("close_at").alias("close_us"),
        day_text("next_session"),
    )


@query(
    "G3 A5",
    V.with_views(V.BARS, V.SESSIONS)
    + f"""SELECT symbol, count(*) AS n, CAST(max(d) AS VARCHAR) AS last_day FROM bars LEFT JOIN sessions ON d=session_date
  WHERE (CASE WHEN symbol LIKE '%-USD' THEN d::TIMESTAMP + INTERVAL 1 DAY ELSE close_at END) + INTERVAL 30 MINUTE
    <= TIMESTAMP '{_NOW}' GROUP BY symbol""",
)
def completed_daily_bars(spark, sf):
    kept = ses.completed_bars(views.bars(spark, sf), views.sessions(spark, sf), F.lit(_NOW).cast("timestamp"))
    return kept.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.max("d").cast("string").alias("last_day"))


_CRYPTO = "symbol LIKE '%-USD'"
_TIMING = f"""kept AS (SELECT * FROM bars WHERE {_CRYPTO} OR d IN (SELECT session_date FROM sessions)),
{O.raw_features("kept", "own")},
spans AS (SELECT symbol, min(d) AS a, max(d) AS b FROM kept GROUP BY symbol),
expected AS (SELECT symbol, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM spans WHERE {_CRYPTO}
  UNION ALL SELECT symbol, session_date FROM spans JOIN sessions ON session_date BETWEEN a AND b WHERE NOT {_CRYPTO}),
lookback AS (SELECT e.symbol, e.d, count(k.d) OVER (PARTITION BY e.symbol ORDER BY e.d ROWS 20 PRECEDING) AS n
  FROM expected e LEFT JOIN kept k ON e.symbol=k.symbol AND e.d=k.d),
usable AS (SELECT own.* FROM own JOIN lookback USING (symbol, d) WHERE n=21),
dated AS (SELECT symbol, k.d AS target_session, close/open-1 AS target_return,
  CASE WHEN {_CRYPTO} THEN k.d-2 ELSE previous_session END AS feature_date,
  CASE WHEN {_CRYPTO} THEN (k.d-1)::TIMESTAMP + INTERVAL 30 MINUTE ELSE previous_close_at + INTERVAL 30 MINUTE END AS feature_available_at,
  CASE WHEN {_CRYPTO} THEN (k.d-1)::TIMESTAMP ELSE k.d::TIMESTAMP END + INTERVAL 30 MINUTE AS decision_at,
  CASE WHEN {_CRYPTO} THEN k.d::TIMESTAMP ELSE open_at END AS entry_at,
  CASE WHEN {_CRYPTO} THEN (k.d+1)::TIMESTAMP ELSE close_at END AS exit_at
  FROM kept k LEFT JOIN cal ON k.d=cal.session_date),
paired AS (SELECT t.*, {', '.join('u.' + c for c in _FEATURES)} FROM dated t JOIN usable u ON t.symbol=u.symbol AND t.feature_date=u.d)"""
_TIMED = V.with_views(
    V.BARS, V.SESSIONS, _SCHEDULE, _TIMING, O.regime_table(), O.regime_attach("paired", "decision_at")
)
_NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in _FEATURES + _REGIME + ["feature_available_at", "entry_at", "exit_at"])


@query(
    "G5 G6 G7 G8 G9 G10 G11 G12 F11",
    _TIMED
    + f"""SELECT symbol, CAST(target_session AS VARCHAR) AS target_session, CAST(feature_date AS VARCHAR) AS feature_date,
  round(target_return,6) AS target_return, epoch_us(feature_available_at) AS feature_available_us, epoch_us(decision_at) AS decision_us,
  epoch_us(entry_at) AS entry_us, epoch_us(exit_at) AS exit_us, epoch_us(exit_at + INTERVAL 30 MINUTE) AS label_us,
  {O.rounded(_FEATURES + _REGIME)} FROM attached WHERE {_NOT_NULL}""",
)
def timing_labels(spark, sf):
    bars = views.stored(views.bars(spark, sf))
    data = timing.timing_dataset(bars, views.stored(views.sessions(spark, sf)), reg.regime_table(bars))
    stamps = {
        "feature_available_us": "feature_available_at", "decision_us": "decision_at", "entry_us": "entry_at",
        "exit_us": "exit_at", "label_us": "label_available_at",
    }
    return data.select(
        "symbol", day_text("target_session"), day_text("feature_date"), F.round("target_return", 6).alias("target_return"),
        *[F.unix_micros(c).alias(n) for n, c in stamps.items()], *rounded(_FEATURES + _REGIME),
    )


@query(
    "G12",
    _TIMED
    + f"""SELECT count(*) AS n, count(*) FILTER (NOT (feature_date::TIMESTAMP < feature_available_at AND feature_available_at<=decision_at
   AND decision_at<entry_at AND entry_at<exit_at)) AS chronology,
  count(*)-count(DISTINCT symbol||target_session) AS duplicate_keys, count(DISTINCT symbol) AS symbols
  FROM attached WHERE {_NOT_NULL}""",
)
def timing_chronology_report(spark, sf):
    bars = views.stored(views.bars(spark, sf))
    data = timing.timing_dataset(bars, views.stored(views.sessions(spark, sf)), reg.regime_table(bars))
    per_key = data.groupBy("symbol", "target_session").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(timing.chronology_checks()["chronology"]).alias("bad")
    )
    return per_key.agg(
        F.sum("rows").alias("n"), F.sum("bad").alias("chronology"), F.sum(F.col("rows") - 1).alias("duplicate_keys"),
        F.count_distinct("symbol").alias("symbols"),
    )


@query(
    "G13 G11",
    "SELECT NULL::VARCHAR AS symbol, NULL::VARCHAR AS target_session, "
    + ", ".join(f"NULL::DOUBLE AS {c}" for c in _FEATURES + _REGIME)
    + ", NULL::BIGINT AS target FROM lineitem WHERE l_shipdate < DATE '1900-01-01'",
)
def timing_without_targets(spark, sf):
    """No usable target gives a typed result without rows."""
    bars = views.stored(views.bars(spark, sf).filter(F.col("d") < F.lit("1900-01-01").cast("date")))
    data = timing.timing_dataset(bars, views.sessions(spark, sf), reg.regime_table(bars))
    typed = timing.empty_dataset(spark).unionByName(data.select(*timing.empty_dataset(spark).columns))
    return typed.select("symbol", day_text("target_session"), *_FEATURES, *_REGIME, F.col("target").cast("bigint").alias("target"))


_PLAN = f"""stock AS (SELECT * FROM sessions WHERE close_at + INTERVAL 30 MINUTE <= TIMESTAMP '{_NOW}'
  QUALIFY row_number() OVER (ORDER BY session_date DESC) <= 5),
syms AS (SELECT DISTINCT CASE WHEN symbol='BTC-USD' THEN 'BTC/USD' ELSE symbol END AS symbol FROM (SELECT {V.SYMBOL} AS symbol FROM lineitem)),
planned AS (
  SELECT symbol, session_date, 'sip' AS feed, open_at, close_at, open_at + INTERVAL 5 MINUTE AS opening,
    date_trunc('minute', open_at + (close_at-open_at)/2) AS midday, close_at - INTERVAL 5 MINUTE AS closing
  FROM syms, stock WHERE symbol<>'BTC/USD'
  UNION ALL SELECT symbol, dd::DATE, 'crypto_us', dd, dd + INTERVAL 1 DAY, dd + INTERVAL 35 MINUTE, dd + INTERVAL 12 HOUR, dd + INTERVAL 1435 MINUTE
  FROM syms, (SELECT unnest(generate_series((TIMESTAMP '{_NOW}'-INTERVAL 30 MINUTE)::DATE::TIMESTAMP - INTERVAL 5 DAY,
    (TIMESTAMP '{_NOW}'-INTERVAL 30 MINUTE)::DATE::TIMESTAMP - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS dd) WHERE symbol='BTC/USD'),
plan AS (SELECT symbol, session_date, feed, open_at, close_at, 'opening' AS window_name, opening AS target_at FROM planned
  UNION ALL SELECT symbol, session_date, feed, open_at, close_at, 'midday', midday FROM planned
  UNION ALL SELECT symbol, session_date, feed, open_at, close_at, 'closing', closing FROM planned)"""


def _plan(spark, sf):
    symbols = views.bars(spark, sf).select(
        F.when(F.col("symbol") == "BTC-USD", "BTC/USD").otherwise(F.col("symbol")).alias("symbol")
    )
    return ses.study_plan(symbols, views.sessions(spark, sf), F.lit(_NOW).cast("timestamp"), 5)


@query(
    "G14 G16",
    V.with_views(V.SESSIONS, _PLAN)
    + """SELECT symbol, CAST(session_date AS VARCHAR) AS session_date, feed, window_name, epoch_us(target_at) AS target_us,
  epoch_us(target_at - INTERVAL 5 SECOND) AS start_us, epoch_us(target_at + INTERVAL 2 SECOND) AS end_us,
  (open_at <= target_at - INTERVAL 5 SECOND AND target_at + INTERVAL 2 SECOND <= close_at) AS inside_session FROM plan""",
)
def replay_plan(spark, sf):
    return ses.replay_windows(_plan(spark, sf)).select(
        "symbol", day_text("session_date"), "feed", "window_name", F.unix_micros("target_at").alias("target_us"),
        F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"), "inside_session",
    )


@query(
    "G15",
    V.with_views(V.SESSIONS)
    + f"""SELECT 'stocks' AS market, CAST(session_date AS VARCHAR) AS session_date, epoch_us(open_at) AS start_us, epoch_us(close_at) AS end_us,
  epoch_us(open_at + INTERVAL 5 MINUTE) AS entry_us, epoch_us(close_at - INTERVAL 5 MINUTE) AS exit_us FROM sessions
  WHERE close_at + INTERVAL 30 MINUTE <= TIMESTAMP '{_NOW}' QUALIFY row_number() OVER (ORDER BY session_date DESC)=1
  UNION ALL SELECT 'crypto', CAST(c::DATE AS VARCHAR), epoch_us(c), epoch_us(c + INTERVAL 1 DAY), epoch_us(c + INTERVAL 35 MINUTE),
  epoch_us(c + INTERVAL 1435 MINUTE) FROM (SELECT (TIMESTAMP '{_NOW}'-INTERVAL 30 MINUTE)::DATE::TIMESTAMP - INTERVAL 1 DAY AS c)""",
)
def capture_plan(spark, sf):
    out = ses.capture_windows(views.sessions(spark, sf), F.lit(_NOW).cast("timestamp"))
    return out.select(
        "market", day_text("session_date"), F.unix_micros("session_start").alias("start_us"),
        F.unix_micros("session_end").alias("end_us"), F.unix_micros("entry_at").alias("entry_us"),
        F.unix_micros("exit_at").alias("exit_us"),
    )


@query(
    "G17 M10",
    V.with_views(V.BARS, V.SESSIONS, _SCHEDULE)
    + f"""SELECT symbol, CAST(session_date AS VARCHAR) AS feature_session, CAST(next_session AS VARCHAR) AS target_session,
  (symbol NOT LIKE '%-USD' AND TIMESTAMP '{_NOW}' < next_open_at - INTERVAL 1 MINUTE) AS eligible,
  CASE WHEN symbol LIKE '%-USD' THEN 'crypto_requires_delayed_entry_target'
    WHEN NOT (TIMESTAMP '{_NOW}' < next_open_at - INTERVAL 1 MINUTE) THEN 'no_future_session_with_completed_features' END AS reason
  FROM (SELECT DISTINCT symbol FROM bars), (SELECT * FROM cal WHERE close_at + INTERVAL 30 MINUTE <= TIMESTAMP '{_NOW}'
    QUALIFY row_number() OVER (ORDER BY session_date DESC)=1)""",
)
def eligible_symbols(spark, sf):
    out = ses.eligible_symbols(views.bars(spark, sf), views.sessions(spark, sf), F.lit(_NOW).cast("timestamp"))
    return out.withColumns(
        {c: F.col(c).cast("string") for c in ("feature_session", "target_session")}
    )
