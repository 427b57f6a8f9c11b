"""Registered queries: bar and quote quality, study, replay, admission."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import MINUTE_NS, SECOND_NS
from ..operators import admission as adm
from ..operators import quality as ql
from ..operators import replay as rp
from ..operators import study as st
from ..sources import marketdata as md
from . import oracle_market as M
from . import views
from .oracle_views import with_views
from .registry import query

_BY = ["symbol", "w"]
# Waits, ages and latencies scaled to the event density of the driver tables.
_WAIT = 30 * MINUTE_NS
_LAT = (0, 600_000, 1_800_000)
_AGE_MS = 30 * 60 * 1000
_BIN = 60 * MINUTE_NS
_HALF = views.HALF_BLOCK_NS


def _quotes(spark, sf):
    return views.quote_records(spark, sf)


def _keyed(spark, sf):
    """Quote records with the envelope of their window."""
    return _quotes(spark, sf).join(views.quote_windows(spark, sf), _BY)


def _instants(spark, sf):
    return ql.quote_instants(ql.unique_quotes(ql.classify_quotes(_keyed(spark, sf)), _BY), _BY)


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


# ---- parsing ----------------------------------------------------------------


@query(
    "A16 A17 A18 I5",
    with_views(M.EVENTS, M.QUOTE_RECORDS)
    + "SELECT symbol, w, event_ns, bid, ask, bid_size, ask_size, tape, CASE WHEN cond_ok THEN 'R' ELSE 'R,X' END AS conditions, CASE WHEN event_id%307=0 THEN 'OTHER' ELSE symbol END AS record_symbol FROM qrec",
)
def parsed_quotes(spark, sf):
    return md.parse_quotes(views.quote_pages(spark, sf)).select(
        "symbol", "w", "event_ns", "bid", "ask", "bid_size", "ask_size", "tape",
        F.array_join("conditions", ",").alias("conditions"), "record_symbol",
    )


@query(
    "A17 J13",
    with_views(M.EVENTS)
    + "SELECT symbol, w, count(*) AS pages, count(*) AS records, true AS complete, CAST(0 AS BIGINT) AS unreadable_pages FROM copies GROUP BY 1,2",
)
def quote_envelopes(spark, sf):
    return md.envelope_summary(views.quote_pages(spark, sf), _BY)


@query(
    "A16 A18 I1",
    with_views(M.EVENTS)
    + f"""SELECT symbol, w, CASE WHEN event_id%211=0 THEN NULL WHEN event_id%83=0 THEN ns ELSE ns//{M.MIN}*{M.MIN} END AS event_ns, value AS o,
  CASE WHEN event_id%41=0 THEN value*0.5::DOUBLE ELSE value*1.01::DOUBLE END AS h, (event_id%7)::DOUBLE AS v,
  CASE WHEN event_id%67<>0 THEN CASE WHEN event_id%59=0 THEN event_id%5+0.5::DOUBLE ELSE (event_id%5)::DOUBLE END END AS n, event_id%67=0 AS n_not_a_number, event_id%73=0 AS vw_not_a_number FROM copies""",
)
def parsed_bars(spark, sf):
    return md.parse_bars(views.bar_pages(spark, sf)).select("symbol", "w", "event_ns", "o", "h", "v", "n", "n_not_a_number", "vw_not_a_number")


# ---- bar quality ------------------------------------------------------------

_BAR_REC = f"""brec AS (SELECT symbol, w, w//4 AS day, CASE WHEN event_id%211=0 THEN NULL WHEN event_id%83=0 THEN ns ELSE ns//{M.MIN}*{M.MIN} END AS event_ns,
  value AS o, CASE WHEN event_id%41=0 THEN value*0.5::DOUBLE ELSE value*1.01::DOUBLE END AS h, value*0.99::DOUBLE AS l, value AS c, (event_id%7)::DOUBLE AS v,
  CASE WHEN event_id%67<>0 THEN CASE WHEN event_id%59=0 THEN event_id%5+0.5::DOUBLE ELSE (event_id%5)::DOUBLE END END AS n, event_id%67=0 AS nbad, event_id%73=0 AS vbad FROM copies),
spans AS (SELECT DISTINCT symbol, w//4 AS day, (w//4)*86400000000000+1800000000000 AS start_ns, (w//4)*86400000000000+84600000000000 AS end_ns FROM windows),
bcls AS (SELECT b.*, start_ns, end_ns, coalesce(event_ns<start_ns OR event_ns>=end_ns,false) AS outside,
  CASE WHEN event_ns IS NULL THEN 'invalid_or_naive_timestamp' WHEN event_ns%{M.MIN}<>0 THEN 'not_exact_minute' WHEN least(o,h,l,c)<=0 THEN 'nonfinite_or_invalid_value'
   WHEN h+greatest(o,h,l,c)*1e-12<greatest(o,l,c) THEN 'invalid_ohlc_bounds' WHEN nbad THEN 'nonnumeric_value' WHEN n<>floor(n) THEN 'noninteger_trade_count' WHEN vbad THEN 'nonnumeric_value' END AS reason0
  FROM brec b JOIN spans USING (symbol, day)),
bcl AS (SELECT *, CASE WHEN NOT outside THEN reason0 END AS reason FROM bcls),
sigs AS (SELECT symbol, day, event_ns, o,h,l,c,v,n, count(*) AS copies FROM bcl WHERE NOT outside AND reason IS NULL GROUP BY ALL),
mins AS (SELECT symbol, day, event_ns, count(*) AS k, sum(copies) AS recs, max(v) AS v FROM sigs GROUP BY 1,2,3)"""
_BARS = with_views(M.EVENTS, M.WINDOWS, _BAR_REC)


def _bar_inputs(spark, sf):
    day_ns = 24 * 60 * MINUTE_NS
    day = F.expr("w div 4")
    spans = views.quote_windows(spark, sf).select("symbol", day.alias("day")).distinct().select(
        "symbol", "day", (F.col("day") * F.lit(day_ns) + 30 * MINUTE_NS).alias("start_ns"),
        (F.col("day") * F.lit(day_ns) + (day_ns - 30 * MINUTE_NS)).alias("end_ns"),
    )
    records = views.bar_records(spark, sf).withColumn("day", day)
    return spans, records


@query(
    "I1 I2 I3 I4 I17",
    _BARS
    + """SELECT s.symbol, s.day, CAST(1380 AS BIGINT) AS expected_minutes, coalesce(received,0) AS received_count, coalesce(outside,0) AS outside_session_count,
  coalesce(valid,0) AS valid_count, coalesce(zero,0) AS zero_volume_count, coalesce(conflicts,0) AS conflicting_minute_count,
  CAST(coalesce(crecs,0) AS BIGINT) AS conflicting_record_count, CAST(coalesce(dups,0) AS BIGINT) AS identical_duplicate_count,
  CAST(coalesce(errors,0)+coalesce(crecs,0) AS BIGINT) AS invalid_count, 1380-coalesce(valid,0) AS missing_count, coalesce(valid,0)/1380 AS coverage_ratio FROM spans s
  LEFT JOIN (SELECT symbol, day, count(*) AS received, count(*) FILTER (outside) AS outside, count(reason) AS errors FROM bcl GROUP BY 1,2) r USING (symbol, day)
  LEFT JOIN (SELECT symbol, day, count(*) FILTER (k=1) AS valid, count(*) FILTER (k=1 AND v=0) AS zero, count(*) FILTER (k>1) AS conflicts,
    sum(recs) FILTER (k>1) AS crecs, sum(recs-k) AS dups FROM mins GROUP BY 1,2) m USING (symbol, day)""",
)
def minute_bar_quality(spark, sf):
    spans, records = _bar_inputs(spark, sf)
    return ql.bar_quality(spans, records, ["symbol", "day"])


@query(
    "I1 I4",
    _BARS + "SELECT symbol, reason, count(*) AS records FROM bcl WHERE reason IS NOT NULL GROUP BY 1,2",
)
def bar_reason_histogram(spark, sf):
    spans, records = _bar_inputs(spark, sf)
    classified = ql.classify_bars(records.join(spans, ["symbol", "day"]))
    return ql.reason_histogram(classified, ["symbol"])


@query(
    "I2 I3",
    _BARS
    + f"""SELECT symbol, day, count(*) AS missing, min(event_ns) AS first_missing_ns, max(event_ns) AS last_missing_ns FROM (
  SELECT symbol, day, unnest(generate_series(start_ns, end_ns-{M.MIN}, {M.MIN})) AS event_ns FROM spans) e
  ANTI JOIN (SELECT * FROM mins WHERE k=1) m USING (symbol, day, event_ns) GROUP BY 1,2""",
)
def missing_minutes(spark, sf):
    spans, records = _bar_inputs(spark, sf)
    by = ["symbol", "day"]
    valid = ql.valid_minutes(ql.classify_bars(records.join(spans, by)), by)
    return ql.missing_minutes(spans, valid, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("missing"), F.min("event_ns").alias("first_missing_ns"), F.max("event_ns").alias("last_missing_ns")
    )


# ---- quote quality ----------------------------------------------------------

_Q = with_views(M.EVENTS, M.QUOTE_RECORDS, M.WINDOWS, M.QUALITY)


@query("I5 I4", _Q + "SELECT symbol, reason, count(*) AS records FROM cls WHERE reason IS NOT NULL AND NOT outside GROUP BY 1,2")
def quote_reason_histogram(spark, sf):
    return ql.reason_histogram(ql.classify_quotes(_keyed(spark, sf)), ["symbol"])


@query("I6 I7", _Q + "SELECT symbol, w, event_ns, bid, ask, round(mid,8) AS mid_price, round(spread,6) AS full_spread_bps FROM uq")
def unique_valid_quotes(spark, sf):
    out = ql.unique_quotes(ql.classify_quotes(_keyed(spark, sf)), _BY)
    return out.select("symbol", "w", "event_ns", "bid", "ask", F.round("mid_price", 8).alias("mid_price"), *r6("full_spread_bps"))


def _hourly_targets(spark, sf):
    hours = F.explode(F.sequence(F.col("start_ns"), F.col("end_ns") - 1, F.lit(60 * MINUTE_NS)))
    return views.quote_windows(spark, sf).select("symbol", "w", hours.alias("target_ns"))


_TARGETS = f"targets AS (SELECT symbol, w, unnest(generate_series(start_ns, end_ns-1, {60 * M.MIN})) AS target_ns FROM windows)"


@query(
    "I8 I9",
    with_views(M.EVENTS, M.QUOTE_RECORDS, M.WINDOWS, M.QUALITY, _TARGETS, M.first_quote("targets", "target_ns", "symbol,w", _WAIT, "fq"))
    + "SELECT symbol, target_ns, first_ns, first_count, ambiguous, bid, ask, round(mid,8) AS mid_price, round(spread,6) AS full_spread_bps FROM fq",
)
def forward_quotes(spark, sf):
    out = ql.first_quotes(_hourly_targets(spark, sf), _instants(spark, sf), _BY, wait_ns=_WAIT, bin_width=_BIN)
    return out.select(
        "symbol", "target_ns", "first_ns", "first_count", "ambiguous", "bid", "ask", F.round("mid_price", 8).alias("mid_price"), *r6("full_spread_bps")
    )


@query(
    "I10",
    _Q
    + """SELECT symbol, count(*) AS count, round(min(spread),6) AS min, round(avg(spread),6) AS mean, round(max(spread),6) AS max,
  round(quantile_cont(spread,0.5),6) AS median, round(quantile_cont(spread,0.9),6) AS p90, round(quantile_cont(spread,0.95),6) AS p95 FROM uq GROUP BY symbol""",
)
def spread_distribution(spark, sf):
    quotes = ql.unique_quotes(ql.classify_quotes(_keyed(spark, sf)), _BY)
    out = ql.spread_distribution(views.stored(quotes.select("symbol", "full_spread_bps")), ["symbol"])
    return out.select("symbol", "count", *r6("min", "mean", "max", "median", "p90", "p95"))


@query(
    "I11 I6",
    _Q
    + f"""SELECT symbol, w, received AS received_count, invalid AS invalid_count, outside AS outside_fetch_window_count, before_t AS before_target_count,
  after_t AS after_deadline_count, coalesce(valid,0) AS valid_count, coalesce(timely,0) AS timely_valid_quote_count, ok-coalesce(valid,0) AS identical_duplicate_count FROM (
  SELECT symbol, w, count(*) AS received, count(*) FILTER (reason IS NOT NULL AND NOT outside) AS invalid, count(*) FILTER (outside) AS outside,
   count(*) FILTER (event_ns<target_ns) AS before_t, count(*) FILTER (event_ns>target_ns+{_WAIT}) AS after_t, count(*) FILTER (NOT outside AND reason IS NULL) AS ok FROM cls GROUP BY 1,2) a
  LEFT JOIN (SELECT symbol, w, count(*) AS valid, count(*) FILTER (event_ns BETWEEN target_ns AND target_ns+{_WAIT}) AS timely FROM uq GROUP BY 1,2) b USING (symbol, w)""",
)
def window_counters(spark, sf):
    classified = ql.classify_quotes(_keyed(spark, sf))
    return ql.window_counters(classified, ql.unique_quotes(classified, _BY), _BY, wait_ns=_WAIT)


_SRC_REASONS = """list_filter([CASE WHEN declared_symbol<>symbol THEN 'quotes_declares_wrong_symbol' END,
  CASE WHEN observed_ns<end_ns THEN 'quotes_observation_time_missing_or_before_window_end' END,
  CASE WHEN NOT complete THEN 'fetch_incomplete_or_truncated' END,
  CASE WHEN symbol<>'BTC/USD' AND feed<>'sip' THEN 'quote_feed_differs_from_bar_feed' END], lambda x: x IS NOT NULL)"""


def _study_windows(spark, sf):
    """Planned windows with strict envelope checks; targets open at the block start."""
    bar_feed = F.when(F.col("symbol") == "BTC/USD", "crypto_us").otherwise("sip")
    windows = views.quote_windows(spark, sf).withColumns({"target_ns": F.col("start_ns"), "bar_feed": bar_feed})
    return windows.withColumn("source_reasons", st.strict_source_reasons(views.BLOCK_NS))


_STUDY_W = f"sw AS (SELECT symbol, w, window_name, session_date, feed, complete, start_ns AS target_ns, {_SRC_REASONS} AS source_reasons FROM windows)"


@query(
    "I12 I13 J3",
    with_views(M.EVENTS, M.WINDOWS, _STUDY_W)
    + "SELECT symbol, w, array_to_string(source_reasons,',') AS source_reasons FROM sw",
)
def fetch_source_reasons(spark, sf):
    return _study_windows(spark, sf).select("symbol", "w", F.array_join("source_reasons", ",").alias("source_reasons"))


_LEGS = f"""en0 AS (SELECT w//4 AS day, symbol, w, start_ns AS target_ns FROM windows WHERE w%4=1), ex0 AS (SELECT w//4 AS day, symbol, w, start_ns AS target_ns FROM windows WHERE w%4=3),
{M.first_quote("en0", "target_ns", "symbol,w", 60 * M.MIN, "en")}, {M.first_quote("ex0", "target_ns", "symbol,w", 60 * M.MIN, "ex")},
benv AS (SELECT symbol, day, CASE WHEN symbol='BTC/USD' THEN 'crypto_us' WHEN symbol='XOM' AND day%2=0 THEN 'iex' ELSE 'sip' END AS bf, day%11<>0 AS bc,
  list_filter([CASE WHEN day%17=0 THEN 'bars_declares_wrong_symbol' END, CASE WHEN day%13=0 THEN 'bars_observation_time_missing_or_before_window_end' END], lambda x: x IS NOT NULL) AS br,
  coalesce(errors,0)+coalesce(crecs,0) AS bad, 1380-coalesce(valid,0) AS missing FROM spans LEFT JOIN (SELECT symbol, day, count(reason) AS errors FROM bcl GROUP BY 1,2) r USING (symbol, day)
  LEFT JOIN (SELECT symbol, day, count(*) FILTER (k=1) AS valid, sum(recs) FILTER (k>1) AS crecs FROM mins GROUP BY 1,2) m USING (symbol, day)),
quoted AS (SELECT en.symbol, en.day, en.bid AS eb, en.ask AS ea, en.mid AS em, en.spread AS es, en.ambiguous AS eamb, ex.bid AS xb, ex.mid AS xm, ex.spread AS xs, ex.ambiguous AS xamb,
  e.feed AS ef, x.feed AS xf, e.complete AS ec, x.complete AS xc, e.entry_reasons AS er, x.exit_reasons AS xr
  FROM en JOIN ex USING (symbol, day) JOIN sw2 e ON e.symbol=en.symbol AND e.w=en.w JOIN sw2 x ON x.symbol=ex.symbol AND x.w=ex.w),
legs AS (SELECT * FROM quoted FULL JOIN benv USING (symbol, day)),
judged AS (SELECT *, list_concat(list_concat(list_concat(list_concat(list_filter([CASE WHEN NOT coalesce(bc,false) THEN 'bars_fetch_incomplete' END, CASE WHEN NOT coalesce(ec,false) THEN 'entry_quotes_fetch_incomplete' END,
   CASE WHEN NOT coalesce(xc,false) THEN 'exit_quotes_fetch_incomplete' END], lambda x: x IS NOT NULL), coalesce(br,[])), coalesce(er,[])), coalesce(xr,[])),
  list_filter([CASE WHEN bf IS NULL OR ef IS NULL OR xf IS NULL THEN 'unknown_or_unsupported_feed_for_symbol' END, CASE WHEN bf IS DISTINCT FROM ef OR ef IS DISTINCT FROM xf THEN 'cross_feed_quote_pair_forbidden' END,
   CASE WHEN eamb THEN 'entry_first_quote_ambiguous_without_sequence' END, CASE WHEN em IS NULL AND NOT coalesce(eamb,false) THEN 'entry_has_no_valid_timely_quote' END,
   CASE WHEN xamb THEN 'exit_first_quote_ambiguous_without_sequence' END, CASE WHEN xm IS NULL AND NOT coalesce(xamb,false) THEN 'exit_has_no_valid_timely_quote' END], lambda x: x IS NOT NULL)) AS blocking FROM legs),
pairs AS (SELECT *, len(blocking)=0 AS usable, list_concat(blocking, list_filter([CASE WHEN bad>0 THEN 'bar_quality_contains_invalid_or_conflicting_records' END,
  CASE WHEN missing>0 THEN 'bar_quality_has_missing_minutes' END], lambda x: x IS NOT NULL)) AS reasons FROM judged)"""
_LEG_REASONS = ", ".join(
    f"""{name}_l AS (SELECT symbol, w, list_filter([CASE WHEN declared_symbol<>symbol THEN '{name}_quotes_declares_wrong_symbol' END,
  CASE WHEN observed_ns<end_ns THEN '{name}_quotes_observation_time_missing_or_before_window_end' END], lambda x: x IS NOT NULL) AS {name}_reasons FROM windows)"""
    for name in ("entry", "exit")
) + ", sw2 AS (SELECT * FROM windows JOIN entry_l USING (symbol, w) JOIN exit_l USING (symbol, w))"
_PAIRS = with_views(M.EVENTS, M.QUOTE_RECORDS, M.WINDOWS, M.QUALITY, _BAR_REC, _LEG_REASONS, _LEGS)


def _pairs(spark, sf):
    """Opening against closing window of each day, beside the day's bars."""
    windows = views.quote_windows(spark, sf).withColumns({"target_ns": F.col("start_ns"), "day": F.expr("w div 4")})
    name = F.when(F.col("window_name") == "opening", "entry").otherwise("exit")
    checks = {
        leg: ql.reason_array(ql.source_reasons(f"{leg}_quotes", "quotes", F.col("target_ns"), F.col("target_ns") + F.lit(60 * MINUTE_NS + 1)))
        for leg in ("entry", "exit")
    }
    planned = windows.filter(F.col("window_name").isin("opening", "closing")).withColumn("reasons", F.when(name == "entry", checks["entry"]).otherwise(checks["exit"]))
    found = ql.first_quotes(planned, _instants(spark, sf), _BY, wait_ns=60 * MINUTE_NS, bin_width=_BIN)
    leg = lambda name: found.filter(F.col("window_name") == name)
    spans, records = _bar_inputs(spark, sf)
    bars = ql.bar_leg(views.bar_envelopes(spans), records, ["symbol", "day"])
    return ql.cost_pairs(leg("opening"), leg("closing"), ["symbol", "day"], bars)


@query(
    "I13 I14 I16",
    _PAIRS
    + """SELECT symbol, day, array_to_string(reasons,',') AS reasons, CASE WHEN usable THEN round(xm/em-1,6) END AS gross_mid_return,
  CASE WHEN usable THEN round(xb/ea-1,6) END AS touch_long_return, CASE WHEN usable THEN round((es+xs)/2,6) END AS approximate_round_trip_spread_bps,
  CASE WHEN usable THEN round(((xm/em-1)-(xb/ea-1))*10000,4) END AS spread_drag_bps FROM pairs""",
)
def touch_cost_pairs(spark, sf):
    out = _pairs(spark, sf)
    return out.select(
        "symbol", "day", F.array_join("reasons", ",").alias("reasons"),
        *r6("gross_mid_return", "touch_long_return", "approximate_round_trip_spread_bps"),
        F.round("spread_drag_bps", 4).alias("spread_drag_bps"),
    )


@query(
    "I15",
    _PAIRS
    + """SELECT symbol, day, fee AS assumed_fee_bps, round((es+xs)/2+fee,6) AS spread_plus_fee_bps FROM pairs, (SELECT unnest([0,5,10,25,50])::DOUBLE AS fee) WHERE usable""",
)
def fee_scenarios(spark, sf):
    return ql.fee_scenarios(_pairs(spark, sf)).select("symbol", "day", "assumed_fee_bps", *r6("spread_plus_fee_bps"))


# ---- study ------------------------------------------------------------------

_LATS = f"shifted AS (SELECT sw.*, latency_ms, target_ns+latency_ms*1000000 AS shifted_ns FROM sw, (SELECT unnest([{','.join(str(x) for x in _LAT)}])::BIGINT AS latency_ms))"
_SCEN = """scen0 AS (SELECT *, list_concat(source_reasons, list_filter([CASE WHEN ambiguous THEN 'first_quote_ambiguous_without_sequence' WHEN mid IS NULL THEN 'no_valid_timely_quote' END], lambda x: x IS NOT NULL)) AS rs FROM lq),
scen1 AS (SELECT *, len(rs)=0 AS available FROM scen0),
scen AS (SELECT a.symbol, a.w, a.window_name, a.session_date, a.feed, a.latency_ms, a.available, a.ambiguous, a.source_reasons,
  CASE WHEN a.available AND NOT z.available THEN list_append(a.rs,'zero_latency_baseline_unavailable') ELSE a.rs END AS reasons,
  CASE WHEN a.available THEN a.spread END AS spread, CASE WHEN a.available THEN (a.first_ns-a.shifted_ns)/1e9 END AS wait_seconds,
  a.available AND z.available AS paired, CASE WHEN a.available AND z.available THEN (a.first_ns-z.first_ns)/1e6 END AS gap_ms,
  CASE WHEN a.available AND z.available THEN (a.ask/z.ask-1)*10000 END AS ask_bps, CASE WHEN a.available AND z.available THEN (a.bid/z.bid-1)*10000 END AS bid_bps
  FROM scen1 a JOIN scen1 z ON a.symbol=z.symbol AND a.w=z.w AND z.latency_ms=0)"""
_STUDY = with_views(
    M.EVENTS, M.QUOTE_RECORDS, M.WINDOWS, M.QUALITY, _STUDY_W, _LATS, M.first_quote("shifted", "shifted_ns", "symbol,w", _WAIT, "lq"), _SCEN
)


def _scenarios(spark, sf):
    return st.latency_scenarios(_study_windows(spark, sf), _instants(spark, sf), _BY, _LAT, _WAIT, _BIN)


@query(
    "J1 J2 J3 J11",
    _STUDY
    + """SELECT symbol, w, latency_ms, available, paired AS paired_with_zero, array_to_string(reasons,',') AS reasons, round(spread,6) AS full_spread_bps,
  round(wait_seconds,6) AS wait_seconds, round(gap_ms,6) AS event_gap_ms, round(ask_bps,4) AS ask_displacement_bps, round(bid_bps,4) AS bid_displacement_bps FROM scen""",
)
def latency_scenarios(spark, sf):
    out = _scenarios(spark, sf)
    return out.select(
        "symbol", "w", "latency_ms", "available", "paired_with_zero",
        F.array_join("reasons", ",").alias("reasons"), *r6("full_spread_bps", "wait_seconds", "event_gap_ms"),
        *[F.round(c, 4).alias(c) for c in ("ask_displacement_bps", "bid_displacement_bps")],
    )


@query(
    "J5 J7 J8 J12",
    _STUDY
    + """, pool AS (SELECT symbol, count(DISTINCT feed)<=1 AS ok FROM scen GROUP BY 1)
SELECT symbol, window_name, latency_ms, count(*) AS expected_samples, count(*) FILTER (available AND ok) AS available_samples,
  count(*) FILTER (NOT (available AND ok)) AS unavailable_samples, count(*) FILTER (available AND ok AND paired) AS paired_with_zero_samples,
  round(quantile_cont(spread,0.5) FILTER (available AND ok),6) AS spread_median, round(quantile_cont(spread,0.9) FILTER (available AND ok),6) AS spread_p90,
  round(max(spread) FILTER (available AND ok),6) AS spread_max, round(max(abs(ask_bps)) FILTER (available AND ok AND paired),4) AS ask_displacement_absolute_max,
  round(max(abs(bid_bps)) FILTER (available AND ok AND paired),4) AS bid_displacement_absolute_max, round(quantile_cont(spread,0.5) FILTER (available AND ok AND paired),6) AS paired_spread_median,
  round(quantile_cont(gap_ms,0.5) FILTER (available AND ok AND paired),6) AS gap_median_ms FROM scen JOIN pool USING (symbol) GROUP BY 1,2,3""",
)
def study_latency_summary(spark, sf):
    out = st.aggregate_latency(_scenarios(spark, sf))
    return out.select(
        "symbol", "window_name", "latency_ms", "expected_samples", "available_samples",
        "unavailable_samples", "paired_with_zero_samples", *r6("spread_median", "spread_p90", "spread_max", "gap_median_ms"),
        *[F.round(c, 4).alias(c) for c in ("ask_displacement_absolute_max", "bid_displacement_absolute_max")], *r6("paired_spread_median"),
    )


_OBS = f"""cnt AS (SELECT symbol, w, count(*) AS received, count(*) FILTER (reason IS NOT NULL AND NOT outside) AS invalid FROM cls GROUP BY 1,2),
ucnt AS (SELECT symbol, w, count(*) AS valid, count(*) FILTER (event_ns BETWEEN w*{M.BLOCK} AND w*{M.BLOCK}+{_WAIT}) AS timely FROM uq GROUP BY 1,2),
obs AS (SELECT s.*, sw.complete, coalesce(received,0) AS received, coalesce(invalid,0) AS invalid, coalesce(valid,0) AS valid, coalesce(timely,0) AS timely
  FROM scen s JOIN sw USING (symbol, w) LEFT JOIN cnt USING (symbol, w) LEFT JOIN ucnt USING (symbol, w) WHERE latency_ms=0)"""


def _observations(spark, sf):
    windows = _study_windows(spark, sf)
    keyed = _quotes(spark, sf).join(windows.select(*_BY, "start_ns", "end_ns", "target_ns"), _BY)
    classified = ql.classify_quotes(keyed)
    counters = ql.window_counters(classified, ql.unique_quotes(classified, _BY), _BY, wait_ns=_WAIT)
    return st.observation_windows(windows, counters, _scenarios(spark, sf), _BY)


@query(
    "J4 J6 J11 J12",
    _STUDY
    + ", "
    + _OBS
    + """, pool AS (SELECT symbol, count(DISTINCT feed)<=1 AS ok FROM windows GROUP BY 1), po AS (SELECT obs.*, pool.ok, CASE WHEN available AND pool.ok THEN spread END AS sp FROM obs JOIN pool USING (symbol))
  SELECT symbol, window_name, count(*) AS expected_samples, count(*) FILTER (available AND ok) AS usable_selected_samples, count(*) FILTER (NOT (available AND ok)) AS unusable_selected_samples,
  count(*) FILTER (len(source_reasons)=0 AND valid>0 AND ok) AS usable_distribution_samples, count(*) FILTER (received=0) AS missing_window_count, count(*) FILTER (NOT complete) AS incomplete_window_count,
  count(*) FILTER (invalid>0) AS invalid_quote_window_count, CAST(sum(invalid) AS BIGINT) AS invalid_quote_record_count,
  count(*) FILTER (len(list_filter(source_reasons, lambda r: r<>'fetch_incomplete_or_truncated'))>0) AS invalid_source_metadata_window_count, count(*) FILTER (len(source_reasons)>0) AS unusable_source_window_count,
  count(*) FILTER (timely=0) AS no_timely_valid_quote_window_count, count(*) FILTER (ambiguous) AS ambiguous_first_quote_window_count, count(sp) AS selected_spread_count,
  round(quantile_cont(sp,0.5),6) AS selected_spread_median, round(quantile_cont(sp,0.9),6) AS selected_spread_p90 FROM po GROUP BY 1,2""",
)
def study_window_summary(spark, sf):
    drop = ("selected_spread_min", "selected_spread_max", "selected_spread_absolute_max")
    return st.aggregate_windows(_observations(spark, sf)).drop(*drop).withColumns({c: F.round(c, 6) for c in ("selected_spread_median", "selected_spread_p90")})


@query(
    "J6",
    _STUDY
    + ", "
    + _OBS
    + """ SELECT symbol, window_name, reason, count(*) AS rows FROM (SELECT symbol, window_name,
  unnest(CASE WHEN invalid>0 THEN list_append(reasons,'window_contains_invalid_quotes_excluded_from_statistics') ELSE reasons END) AS reason FROM obs) GROUP BY 1,2,3""",
)
def study_reason_counts(spark, sf):
    return st.reason_counts(_observations(spark, sf), ["symbol", "window_name"])


@query(
    "J9 J10 I12",
    _BARS
    + """, env AS (SELECT *, day%17<>0 AND day%13<>0 AND day%11<>0 AS usable, CASE WHEN symbol='BTC/USD' THEN 'crypto_us' WHEN symbol='XOM' AND day%2=0 THEN 'iex' ELSE 'sip' END AS feed FROM spans),
  pool AS (SELECT symbol, count(DISTINCT feed)<=1 AS ok FROM env GROUP BY 1),
  ses AS (SELECT s.symbol, s.day, usable AND ok AS good, coalesce(valid,0) AS valid, coalesce(zero,0) AS zero, coalesce(crecs,0) AS crecs, coalesce(errors,0) AS errors FROM env s JOIN pool USING (symbol)
  LEFT JOIN (SELECT symbol, day, count(reason) AS errors FROM bcl GROUP BY 1,2) r USING (symbol, day)
  LEFT JOIN (SELECT symbol, day, count(*) FILTER (k=1) AS valid, count(*) FILTER (k=1 AND v=0) AS zero, sum(recs) FILTER (k>1) AS crecs FROM mins GROUP BY 1,2) m USING (symbol, day))
  SELECT symbol, count(*) AS expected_sessions, CAST(sum(1380) AS BIGINT) AS expected_minutes, CAST(sum(valid) AS BIGINT) AS observed_valid_minutes,
  CAST(sum(CASE WHEN good THEN valid ELSE 0 END) AS BIGINT) AS source_usable_valid_minutes, count(*) FILTER (good) AS source_usable_sessions,
  count(*) FILTER (good AND valid=1380) AS all_minutes_present_sessions, CAST(sum(1380-valid) AS BIGINT) AS observed_missing_minutes,
  CAST(sum(errors+crecs) AS BIGINT) AS observed_invalid_bar_records, CAST(sum(zero) AS BIGINT) AS observed_zero_volume_minutes, round(quantile_cont(CASE WHEN good THEN valid/1380 END,0.5),9) AS daily_coverage_median
  FROM ses GROUP BY symbol""",
)
def minute_coverage_totals(spark, sf):
    spans, records = _bar_inputs(spark, sf)
    by = ["symbol", "day"]
    envelopes = views.bar_envelopes(spans).withColumn("source_usable", st.bar_source_usable())
    quality = ql.bar_quality(spans, records, by).join(envelopes.select(*by, "feed", "source_usable"), by)
    totals = st.coverage_totals(st.require_one_per_session(quality, by))
    kept = [c for c in totals.columns if not c.startswith("daily_coverage_")]
    return totals.select(*kept, F.round("daily_coverage_median", 9).alias("daily_coverage_median"))


@query(
    "J13",
    with_views(M.EVENTS, M.WINDOWS)
    + """SELECT count(*) AS planned_segments, count(*) FILTER (complete) AS attempted_segments, count(*) FILTER (complete) AS successful_segments,
  count(*) FILTER (NOT complete) AS skipped_segments, CAST(sum(pages) AS BIGINT) AS pages, CAST(0 AS BIGINT) AS raw_bars, CAST(sum(records) AS BIGINT) AS raw_quotes
  FROM (SELECT n.*, coalesce(c.records,0) AS records FROM windows n LEFT JOIN (SELECT symbol, w, count(*) AS records FROM copies GROUP BY 1,2) c USING (symbol, w))""",
)
def capture_totals(spark, sf):
    records = md.envelope_summary(views.quote_pages(spark, sf), _BY).select(*_BY, "records")
    envelopes = views.quote_windows(spark, sf).join(records, _BY, "left").na.fill(0, ["records"])
    return st.capture_totals(envelopes.withColumn("attempted", F.col("complete")))


# ---- replay -----------------------------------------------------------------

_DECIDE = with_views(M.EVENTS, M.QUOTE_RECORDS, M.WINDOWS, M.REPLAY, M.states("src", "target_ns", _AGE_MS * 1_000_000, "stt"))


def _replay_inputs(spark, sf):
    records = _keyed(spark, sf)
    windows = rp.usable_windows(views.quote_windows(spark, sf), records, _BY, lookback=_HALF, lookahead=_HALF)
    return windows, rp.events(records, _BY), records


@query(
    "K1 K3 K4 K7 K9",
    _DECIDE
    + """SELECT symbol, w, status, CASE WHEN status<>'SOURCE_REJECTED' THEN last_ns END AS event_ns, array_to_string(reasons,',') AS reasons,
  CASE WHEN status IN ('VALID','STALE') THEN bid END AS bid, CASE WHEN status IN ('VALID','STALE') THEN ask END AS ask FROM stt""",
)
def replay_states(spark, sf):
    windows, events, _ = _replay_inputs(spark, sf)
    out = rp.states(windows, events, _BY, "target_ns", _AGE_MS, _BIN)
    return out.select(
        "symbol", "w", "status", "event_ns", F.array_join("reasons", ",").alias("reasons"),
        F.col("quote.bid").alias("bid"), F.col("quote.ask").alias("ask"),
    )


@query(
    "K2 K3 K5 K6",
    with_views(M.EVENTS, M.QUOTE_RECORDS, M.WINDOWS, M.REPLAY)
    + """SELECT symbol, w, count(*) AS state_transitions, count(*) FILTER (NOT valid) AS invalid_state_updates, count(*) FILTER (prev AND NOT valid) AS invalidations,
  count(*) FILTER (NOT prev AND valid) AS recoveries, count(*) FILTER (updates>1) AS ambiguous_groups, min(event_ns) FILTER (valid) AS first_valid_ns FROM (
  SELECT *, lag(valid) OVER (PARTITION BY symbol, w ORDER BY event_ns) AS prev FROM inst2) GROUP BY 1,2""",
)
def replay_transitions(spark, sf):
    return rp.transition_counters(rp.events(_keyed(spark, sf), _BY), _BY)


@query(
    "K3 K4 J13",
    with_views(M.EVENTS, M.QUOTE_RECORDS, M.WINDOWS)
    + """SELECT symbol, w, CAST(sum(n) AS BIGINT) AS received, CAST(sum(CASE WHEN inw THEN n ELSE 0 END) AS BIGINT) AS in_window,
  CAST(sum(CASE WHEN NOT inw AND event_ns IS NOT NULL THEN n ELSE 0 END) AS BIGINT) AS outside, CAST(sum(CASE WHEN inw THEN n-1 ELSE 0 END) AS BIGINT) AS exact_duplicates,
  count(*) FILTER (inw) AS unique_events FROM (SELECT symbol, w, event_ns, bid, ask, bid_size, ask_size, cond_ok, tape, coalesce(event_ns>=start_ns AND event_ns<end_ns,false) AS inw, count(*) AS n
  FROM qrec JOIN windows USING (symbol, w) GROUP BY ALL) GROUP BY 1,2""",
)
def replay_record_counters(spark, sf):
    return rp.record_counters(_keyed(spark, sf), _BY)


_OFFERS = f"offers AS (SELECT src.*, latency_ms, target_ns+latency_ms*1000000 AS arrival_ns FROM src, (SELECT unnest([{','.join(str(x) for x in _LAT)}])::BIGINT AS latency_ms))"
_REPLAY_SCEN = with_views(
    M.EVENTS, M.QUOTE_RECORDS, M.WINDOWS, M.REPLAY, _OFFERS, M.states("offers", "arrival_ns", _AGE_MS * 1_000_000, "arr"),
    """sc AS (SELECT a.*, z.status AS dstatus, z.last_ns AS dlast, z.reasons AS dreasons, CASE WHEN z.status<>'VALID' THEN 'DECISION_BLOCKED' WHEN a.status<>'VALID' THEN 'ARRIVAL_BLOCKED'
   ELSE 'QUOTE_ELIGIBLE_NO_FILL_ASSUMED' END AS scenario_status FROM arr a JOIN arr z ON a.symbol=z.symbol AND a.w=z.w AND z.latency_ms=0)""",
)


def _replay_scenarios(spark, sf):
    windows, events, _ = _replay_inputs(spark, sf)
    return rp.scenarios(windows, events, _BY, _LAT, _AGE_MS, _BIN)


@query(
    "K7 K8",
    _REPLAY_SCEN
    + """SELECT symbol, w, latency_ms, status, dstatus AS decision_status, scenario_status, CASE WHEN scenario_status LIKE 'QUOTE%' THEN ask END AS buy_reference_price,
  CASE WHEN scenario_status LIKE 'QUOTE%' THEN bid END AS sell_reference_price FROM sc""",
)
def replay_scenarios(spark, sf):
    return _replay_scenarios(spark, sf).select(
        "symbol", "w", "latency_ms", "status", F.col("decision.status").alias("decision_status"),
        "scenario_status", "buy_reference_price", "sell_reference_price",
    )


@query(
    "K10",
    _REPLAY_SCEN
    + """, long AS (SELECT symbol, window_name, 'decision_state' AS measure, NULL::BIGINT AS latency_ms, dstatus AS value FROM sc WHERE latency_ms=0
 UNION ALL SELECT symbol, window_name, 'decision_reason', NULL, unnest(dreasons) FROM sc WHERE latency_ms=0
 UNION ALL SELECT symbol, window_name, 'scenario', latency_ms, scenario_status FROM sc UNION ALL SELECT symbol, window_name, 'arrival_state', latency_ms, status FROM sc)
SELECT symbol, window_name, measure, latency_ms, value, count(*) AS rows FROM long GROUP BY ALL
UNION ALL SELECT NULL, NULL, measure, latency_ms, value, count(*) FROM long GROUP BY measure, latency_ms, value""",
)
def replay_summary(spark, sf):
    return rp.aggregate(_replay_scenarios(spark, sf))


@query(
    "K11",
    _REPLAY_SCEN
    + """SELECT symbol, w, latency_ms, CASE WHEN w%29=0 THEN 'status' WHEN latency_ms=0 THEN 'dropped' END AS altered FROM sc WHERE w%29=0 OR (w%31=0 AND latency_ms=0)""",
)
def replay_recheck(spark, sf):
    """An archived replay with altered states and dropped rows against one rebuilt from the pages."""
    columns = [*_BY, "latency_ms", "status", "event_ns", "scenario_status", "buy_reference_price", "sell_reference_price"]
    rebuilt = views.stored(_replay_scenarios(spark, sf).select(*columns))
    forged, dropped = F.col("w") % 29 == 0, (F.col("w") % 31 == 0) & (F.col("latency_ms") == 0)
    saved = rebuilt.filter(~dropped | forged).withColumn("status", F.when(forged, F.concat("status", F.lit("?"))).otherwise(F.col("status")))
    found = rp.mismatches(saved, rebuilt, [*_BY, "latency_ms"])
    return found.select(*_BY, "latency_ms", F.when(forged, "status").when(dropped, "dropped").alias("altered"))


# ---- admission --------------------------------------------------------------


def _policy(spark):
    return spark.createDataFrame(
        [("25", True, False, 1000, "sip", "crypto_us", None)],
        "max_notional_usd string, paper_only boolean, execution_enabled boolean, max_quote_age_ms int, "
        "expected_stock_feed string, expected_crypto_feed string, expected_source_sha256 string",
    )


def _evidence(spark):
    return spark.createDataFrame(
        [(True, False, adm.MODEL_SCOPE, None)],
        "verified boolean, approved_for_paper boolean, scope string, model_sha256 string",
    )


_ADM_LAT = (0, 250, 1000)


def _evaluated(spark, sf):
    windows, events, _ = _replay_inputs(spark, sf)
    scenarios = rp.scenarios(windows, events, _BY, _ADM_LAT, _AGE_MS, _BIN)
    intents = adm.generate_intents(windows, _BY)
    return adm.evaluate(intents, scenarios, _policy(spark), _evidence(spark), _BY, _HALF, _HALF)


_ADM = with_views(
    M.EVENTS, M.QUOTE_RECORDS, M.WINDOWS, M.REPLAY,
    "offers AS (SELECT src.*, latency_ms, target_ns+latency_ms*1000000 AS arrival_ns FROM src, (SELECT unnest([0,250,1000])::BIGINT AS latency_ms))",
    M.states("offers", "arrival_ns", _AGE_MS * 1_000_000, "arr"),
    """intents AS (SELECT a.symbol, a.w, a.latency_ms, side, list_sort(list_distinct(list_filter([
  'MODEL_NOT_APPROVED', CASE WHEN len(a.source_reasons)>0 THEN 'SOURCE_REJECTED' END, CASE WHEN a.declared_symbol<>a.symbol THEN 'SOURCE_SYMBOL_MISMATCH' END,
  CASE WHEN a.symbol<>'BTC/USD' AND a.feed<>'sip' THEN 'SOURCE_FEED_MISMATCH' END, CASE WHEN NOT a.complete THEN 'SOURCE_METADATA_INVALID' END,
  CASE WHEN a.pages>3 THEN 'SOURCE_PAGE_COUNT_INVALID' END, CASE WHEN a.observed_ns<a.end_ns THEN 'SOURCE_OBSERVATION_TIME_INVALID' END,
  CASE WHEN a.unparseable>0 THEN 'SOURCE_EVENT_INTEGRITY_INVALID' END,
  CASE WHEN z.status IN ('INVALID','MISSING','SOURCE_REJECTED') THEN 'QUOTE_DECISION_'||z.status END,
  CASE WHEN a.status IN ('INVALID','MISSING','SOURCE_REJECTED') THEN 'QUOTE_ARRIVAL_'||a.status END,
  CASE WHEN z.status<>'SOURCE_REJECTED' AND a.target_ns-z.last_ns>1000000000 THEN 'QUOTE_DECISION_STALE' END,
  CASE WHEN a.status<>'SOURCE_REJECTED' AND a.arrival_ns-a.last_ns>1000000000 THEN 'QUOTE_ARRIVAL_STALE' END], lambda x: x IS NOT NULL))) AS reasons
  FROM arr a JOIN arr z ON a.symbol=z.symbol AND a.w=z.w AND z.latency_ms=0, (SELECT unnest(['BUY','SELL']) AS side))""",
)


@query(
    "L1 L2 L5 L6 L7 L8 L9",
    _ADM
    + "SELECT symbol, w, latency_ms, side, CASE WHEN len(reasons)=0 THEN 'APPROVED_FOR_SIMULATION_ONLY' ELSE 'REJECTED' END AS state, array_to_string(reasons,',') AS reasons FROM intents",
)
def admission_audit(spark, sf):
    return _evaluated(spark, sf).select(
        "symbol", "w", "latency_ms", "side", "state", F.array_join("reasons", ",").alias("reasons")
    )


@query(
    "L11",
    _ADM
    + """, long AS (SELECT symbol, 'state' AS measure, CASE WHEN len(reasons)=0 THEN 'APPROVED_FOR_SIMULATION_ONLY' ELSE 'REJECTED' END AS value FROM intents
 UNION ALL SELECT symbol, 'reason', unnest(reasons) FROM intents)
SELECT symbol, measure, value, count(*) AS rows FROM long GROUP BY ALL UNION ALL SELECT NULL, measure, value, count(*) FROM long GROUP BY measure, value""",
)
def admission_counts(spark, sf):
    return adm.counts(_evaluated(spark, sf))


@query(
    "L10",
    _ADM
    + """SELECT symbol, sequence, event, count(*) AS events FROM (SELECT symbol, 1 AS sequence, 'INTENT_CREATED' AS event FROM intents UNION ALL SELECT symbol, 2, 'CHECKS_COMPLETED' FROM intents
 UNION ALL SELECT symbol, 3, CASE WHEN len(reasons)=0 THEN 'APPROVED_FOR_SIMULATION_ONLY' ELSE 'REJECTED' END FROM intents) GROUP BY 1,2,3""",
)
def admission_lifecycle(spark, sf):
    evaluated = _evaluated(spark, sf)
    events = adm.lifecycle(evaluated).join(evaluated.select("intent_id", "symbol"), "intent_id")
    return events.groupBy("symbol", F.col("sequence").cast("bigint").alias("sequence"), "event").agg(F.count(F.lit(1)).alias("events"))


_CHAIN_SQL = (
    _ADM
    + """, ids AS (SELECT i.*, 'synthetic-v1-'||sha256(to_json({'schema': 'synthetic-admission-v1', 'decision_ns': w*21600000000000+10800000000000, 'latency_ms': latency_ms,
  'notional_decimal': '5', 'side': side, 'source': sha256(symbol||'|'||w), 'symbol': symbol})) AS id FROM intents i),
heads AS (SELECT id, sha256(sha256(sha256(repeat('0',64)||to_json({'sequence': 1, 'event': 'INTENT_CREATED', 'intent_id': id, 'payload': NULL::VARCHAR}))
  ||to_json({'sequence': 2, 'event': 'CHECKS_COMPLETED', 'intent_id': id, 'payload': array_to_string(reasons,',')}))
  ||to_json({'sequence': 3, 'event': CASE WHEN len(reasons)=0 THEN 'APPROVED_FOR_SIMULATION_ONLY' ELSE 'REJECTED' END, 'intent_id': id, 'payload': NULL::VARCHAR})) AS head FROM ids)
SELECT count(*) AS intents, sha256(concat_ws(':', count(*)::VARCHAR, """
    + ", ".join(f"sum(('0x'||substr(sha256(id||head),{1 + 8 * i},8))::UBIGINT)::VARCHAR" for i in range(8))
    + ")) AS digest FROM heads"
)


@query("L2 L10 L12", _CHAIN_SQL)
def admission_chain(spark, sf):
    return adm.chain_digest(adm.chain_heads(adm.lifecycle(_evaluated(spark, sf))))
