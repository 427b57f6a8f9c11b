"""DuckDB text for market-data windows, quotes and replay states."""

from __future__ import annotations

MIN = 60_000_000_000
BLOCK = 6 * 3600 * 1_000_000_000

EVENTS = f"""ev AS (SELECT *, ns//{BLOCK} AS w FROM (
  SELECT CASE event_type WHEN 'view' THEN 'SPY' WHEN 'click' THEN 'JPM' WHEN 'error' THEN 'XOM' WHEN 'purchase' THEN 'WMT' ELSE 'BTC/USD' END AS symbol,
   event_id, epoch_us(ts)*1000 + event_id%1000 AS ns, value FROM events)),
copies AS (SELECT * FROM ev UNION ALL SELECT * FROM ev WHERE event_id%10=0)"""

# raw quote records: one per copy, minute instants; NULL instant when the zone is missing
QUOTE_RECORDS = f"""qrec AS (SELECT symbol, w, event_id, CASE WHEN event_id%211=0 THEN NULL ELSE ns//{MIN}*{MIN} END AS event_ns, value AS bid,
  CASE WHEN event_id%97=0 THEN value*0.99::DOUBLE WHEN event_id%61=0 THEN value ELSE value*(1+(1+event_id%7)*0.0001::DOUBLE) END AS ask,
  CASE WHEN event_id%89=0 THEN 0 ELSE 1+event_id%9 END::DOUBLE AS bid_size, (1+event_id%5)::DOUBLE AS ask_size,
  event_id%53<>0 AS cond_ok, CASE WHEN event_id%71=0 THEN 'Z' ELSE ['A','B','C'][1+event_id%3] END AS tape FROM copies)"""
IDENT = "(bid, ask, bid_size, ask_size, cond_ok, tape)"

WINDOWS = f"""windows AS (SELECT symbol, w, w*{BLOCK} AS start_ns, w*{BLOCK}+{BLOCK // 2} AS target_ns, (w+1)*{BLOCK} AS end_ns,
  ['night','opening','midday','closing'][1+w%4] AS window_name, make_timestamp(w*{BLOCK}//1000)::DATE AS session_date,
  CASE WHEN w%17=0 THEN 'ZZZ' ELSE symbol END AS declared_symbol,
  CASE WHEN symbol='BTC/USD' THEN 'crypto_us' WHEN w%9=0 THEN 'iex' ELSE 'sip' END AS feed, w%11<>0 AS complete, 1+w%4 AS pages,
  CASE WHEN w%13=0 THEN (w+1)*{BLOCK}-1 ELSE (w+1)*{BLOCK}+1000000000 END AS observed_ns
  FROM (SELECT DISTINCT symbol FROM ev), (SELECT unnest(generate_series((SELECT min(w) FROM ev),(SELECT max(w) FROM ev))) AS w))"""

QUALITY = f"""cls AS (SELECT q.*, n.start_ns, n.end_ns, n.target_ns,
  coalesce(event_ns<n.start_ns OR event_ns>=n.end_ns, false) AS outside,
  CASE WHEN event_ns IS NULL THEN 'invalid_or_naive_timestamp' WHEN bid<=0 OR ask<=0 OR bid_size<=0 OR ask_size<=0 THEN 'nonfinite_or_invalid_value'
   WHEN bid>ask THEN 'crossed_quote' END AS reason FROM qrec q JOIN windows n USING (symbol, w)),
uq AS (SELECT DISTINCT symbol, w, target_ns, event_ns, bid, ask, bid_size, ask_size, cond_ok, tape, bid+(ask-bid)/2 AS mid,
  (ask-bid)/(bid+(ask-bid)/2)*10000 AS spread FROM cls WHERE NOT outside AND reason IS NULL)"""


def first_quote(targets: str, time: str, keys: str, wait: int, out: str) -> str:
    """CTE ``out``: targets with first instant, tie count and the single quote within ``wait``."""
    on = " AND ".join(f"t.{k}=q.{k}" for k in keys.split(","))
    return f"""{out}_a AS (SELECT t.*, (SELECT min(event_ns) FROM uq q WHERE {on} AND q.event_ns>=t.{time} AND q.event_ns<=t.{time}+{wait}) AS first_ns FROM {targets} t),
{out}_b AS (SELECT {keys}, event_ns, count(*) AS cnt, any_value(bid) AS bid, any_value(ask) AS ask, any_value(mid) AS mid, any_value(spread) AS spread FROM uq GROUP BY {keys}, event_ns),
{out} AS (SELECT t.*, coalesce(q.cnt,0) AS first_count, coalesce(q.cnt>1,false) AS ambiguous, CASE WHEN q.cnt=1 THEN q.bid END AS bid,
  CASE WHEN q.cnt=1 THEN q.ask END AS ask, CASE WHEN q.cnt=1 THEN q.mid END AS mid, CASE WHEN q.cnt=1 THEN q.spread END AS spread
  FROM {out}_a t LEFT JOIN {out}_b q ON {on} AND q.event_ns=t.first_ns)"""


STOCK = "symbol IN ('SPY','JPM','XOM','WMT')"
REPLAY = f"""upd AS (SELECT DISTINCT symbol, w, event_ns, bid, ask, bid_size, ask_size, cond_ok, tape FROM qrec JOIN windows USING (symbol, w)
   WHERE event_ns>=start_ns AND event_ns<end_ns),
updr AS (SELECT *, list_filter([CASE WHEN {STOCK} AND NOT cond_ok THEN 'stock_condition_not_exact_single_regular_R' END,
   CASE WHEN {STOCK} AND tape='Z' THEN 'stock_tape_missing_or_unknown' END,
   CASE WHEN least(bid,ask,bid_size,ask_size)<=0 THEN 'quote_price_or_size_nonpositive_nonfinite_or_malformed' END,
   CASE WHEN least(bid,ask,bid_size,ask_size)>0 AND bid>ask THEN 'crossed_quote' END,
   CASE WHEN least(bid,ask,bid_size,ask_size)>0 AND bid=ask THEN 'locked_quote' END], lambda x: x IS NOT NULL) AS rs FROM upd),
inst AS (SELECT symbol, w, event_ns, count(*) AS updates, list_sort(list_distinct(flatten(list(rs)))) AS allr, any_value(bid) AS bid, any_value(ask) AS ask
   FROM updr GROUP BY symbol, w, event_ns),
inst2 AS (SELECT *, updates=1 AND len(allr)=0 AS valid,
   CASE WHEN updates>1 THEN list_append(allr,'distinct_same_timestamp_updates_unsequenced') ELSE allr END AS reasons FROM inst),
bad AS (SELECT symbol, w, count(*) FILTER (event_ns IS NULL) AS unparseable, count(*) FILTER (event_id%307=0) AS wrong, count(*) AS received FROM qrec GROUP BY 1,2),
src AS (SELECT n.*, coalesce(unparseable,0) AS unparseable, list_sort(list_filter([CASE WHEN declared_symbol<>n.symbol THEN 'fetch_symbol_missing_or_wrong' END,
   CASE WHEN NOT complete THEN 'fetch_incomplete_or_truncated' END, CASE WHEN pages>3 THEN 'fetch_page_count_missing_or_invalid' END,
   CASE WHEN observed_ns<end_ns THEN 'observation_time_missing_or_before_window_end' END,
   CASE WHEN coalesce(unparseable,0)>0 THEN 'event_timestamp_missing_or_unparseable_cannot_order' END,
   CASE WHEN coalesce(wrong,0)>0 THEN 'record_declares_wrong_symbol' END], lambda x: x IS NOT NULL)) AS source_reasons
   FROM windows n LEFT JOIN bad b ON b.symbol=n.symbol AND b.w=n.w)"""


def states(source: str, time: str, max_age_ns: int, out: str) -> str:
    return f"""{out}_a AS (SELECT t.*, (SELECT max(event_ns) FROM inst2 i WHERE i.symbol=t.symbol AND i.w=t.w AND i.event_ns<t.{time}) AS last_ns FROM {source} t),
{out} AS (SELECT t.*, i.bid, i.ask, i.valid, i.updates, CASE WHEN len(source_reasons)>0 THEN 'SOURCE_REJECTED' WHEN last_ns IS NULL THEN 'MISSING' WHEN NOT i.valid THEN 'INVALID'
   WHEN {time}-last_ns>{max_age_ns} THEN 'STALE' ELSE 'VALID' END AS status,
   CASE WHEN len(source_reasons)>0 THEN source_reasons WHEN last_ns IS NULL THEN ['no_event_strictly_before_asof'] WHEN NOT i.valid THEN i.reasons
   WHEN {time}-last_ns>{max_age_ns} THEN ['latest_update_older_than_max_age'] ELSE []::VARCHAR[] END AS reasons
   FROM {out}_a t LEFT JOIN inst2 i ON i.symbol=t.symbol AND i.w=t.w AND i.event_ns=t.last_ns)"""
