"""DuckDB text of the derived views, for the side-by-side check."""

from __future__ import annotations

SYMBOL = (
    "CASE l_returnflag||l_linestatus WHEN 'AF' THEN 'SPY' WHEN 'AO' THEN 'QQQ' WHEN 'NF' THEN 'IWM' "
    "WHEN 'NO' THEN '^VIX' WHEN 'RF' THEN '^TNX' WHEN 'RO' THEN 'BTC-USD' END"
)
SERIES = (
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'DFF' WHEN '2-HIGH' THEN 'DGS10' WHEN '3-MEDIUM' THEN 'CPIAUCSL' "
    "WHEN '4-NOT SPECIFIED' THEN 'UNRATE' WHEN '5-LOW' THEN 'GDP' END"
)
NY = "timezone('UTC', timezone('America/New_York', {}))"
CHICAGO = "timezone('UTC', timezone('America/Chicago', {}))"
KEY = "concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)"

BARS = f"""bars AS (
  SELECT {SYMBOL} AS symbol, l_shipdate::DATE AS d,
    first(1000+l_extendedprice/l_quantity/20 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS open,
    max(1000+l_extendedprice/l_quantity/20) AS high, min(1000+l_extendedprice/l_quantity/20) AS low,
    last(1000+l_extendedprice/l_quantity/20 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS close,
    sum(l_quantity) AS volume
  FROM lineitem GROUP BY 1, 2)"""

SESSIONS = f"""sessions AS (
  SELECT 'XNYS' AS calendar, d AS session_date,
    {NY.format("d + INTERVAL 570 MINUTE")} AS open_at,
    {NY.format("d + to_minutes(CASE WHEN month(d)=11 AND day(d)=27 THEN 780 ELSE 960 END)")} AS close_at
  FROM (SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem) WHERE dayofweek(d) BETWEEN 1 AND 5)"""

MARKET_BARS = f"""market_bars AS (
  SELECT *, available_at + to_hours(CAST(pk % 48 AS INTEGER)) AS ingested_at FROM (
  SELECT 'YF:S' || (l_suppkey % 20) AS instrument_id, l_shipdate::DATE::TIMESTAMP AS event_time, '1d' AS interval,
    l_extendedprice/l_quantity AS open, l_extendedprice/l_quantity+1 AS high, l_extendedprice/l_quantity-1 AS low,
    l_extendedprice/l_quantity+0.5::DOUBLE AS close, l_quantity AS volume,
    l_shipdate::DATE::TIMESTAMP + INTERVAL 1 DAY + to_hours(CAST(l_linenumber*24 + l_suppkey%24 AS INTEGER)) AS available_at,
    'yahoo' AS source,
    CASE WHEN l_partkey%11=0 THEN 'adjusted-v1' ELSE 'snapshot-v2:'||{KEY} END AS data_version, l_partkey AS pk
  FROM lineitem))"""

FUNDAMENTALS = f"""fundamentals AS (
  SELECT *, filed_at AS available_at, filed_at + to_hours(CAST(pk % 72 AS INTEGER)) AS ingested_at FROM (
  SELECT 'R'||{KEY} AS record_id, 'US:C'||(l_suppkey % 40) AS instrument_id,
    CASE l_returnflag WHEN 'A' THEN 'Revenues' WHEN 'N' THEN 'NetIncomeLoss' ELSE 'Assets' END AS metric,
    CASE WHEN l_linenumber=7 THEN NULL WHEN l_linenumber%2=0 THEN pe - 90 ELSE pe - 180 END AS period_start,
    pe AS period_end, CASE WHEN l_partkey%50<>0 THEN l_extendedprice END AS value,
    CASE WHEN l_linestatus='O' THEN 'EUR' ELSE 'USD' END AS unit,
    CASE WHEN l_linenumber=3 THEN '10-Q/A' WHEN l_linenumber%2=0 THEN '10-Q' ELSE '10-K' END AS form,
    {KEY} AS accession_number, {NY.format("(l_shipdate::DATE + 1)::TIMESTAMP")} AS filed_at,
    'sec-companyfacts' AS source, year(pe) AS fiscal_year, 'Q'||quarter(pe) AS fiscal_period, l_partkey AS pk
  FROM (SELECT *, date_trunc('quarter', l_shipdate::DATE - 1)::DATE AS pe FROM lineitem)))"""

MACRO = f"""macro AS (
  SELECT series_id, observation_date, value, vintage_date, available_at,
    available_at + to_hours(CAST(day(vintage_date) % 5 AS INTEGER)) AS ingested_at, 'fred-alfred' AS source,
    vintage_date + 60 AS realtime_end, 'vintage_date_end_america_chicago' AS availability_basis
  FROM (SELECT *, {CHICAGO.format("(vintage_date + 1)::TIMESTAMP")} AS available_at FROM (
    SELECT {SERIES} AS series_id, o_orderdate::DATE AS observation_date,
      o_orderdate::DATE + CAST(o_custkey % 40 AS INTEGER) AS vintage_date,
      max(CASE WHEN o_custkey % 29 <> 0 THEN o_totalprice END) AS value
    FROM orders GROUP BY 1,2,3)))"""

NEWS = """news AS (
  SELECT *, first_seen_at AS available_at, first_seen_at + to_hours(CAST(doc_id % 13 AS INTEGER)) AS ingested_at FROM (
  SELECT *, published_at + to_minutes(CAST(doc_id % 4000 AS INTEGER)) AS first_seen_at FROM (
  SELECT 'N'||doc_id AS event_id, TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 20000 AS INTEGER)) AS published_at,
    'wire-'||lang AS source, sha256(text) AS title_hash, upper(lang) AS e1, source AS e2, doc_id
  FROM documents)))"""

IDENTITIES = """identities AS (
  SELECT *, valid_from + INTERVAL 6 HOUR AS available_at,
    valid_from + to_hours(CAST(6 + c_custkey % 30 AS INTEGER)) AS ingested_at,
    CASE WHEN c_custkey%3=0 THEN valid_from + INTERVAL 700 DAY END AS valid_to FROM (
  SELECT 'YF:I'||(c_custkey%400) AS instrument_id, 'I'||(c_custkey%400) AS symbol,
    CASE WHEN c_nationkey%5=0 THEN 'crypto' ELSE 'equity' END AS asset_class,
    CASE WHEN c_nationkey%4<>0 THEN 'XNYS' END AS primary_exchange,
    TIMESTAMP '2000-01-01' + to_days(CAST(c_custkey%900 AS INTEGER)) AS valid_from,
    CASE WHEN c_custkey%7=0 THEN 'sec' ELSE 'yahoo' END AS source, c_custkey
  FROM customer))"""

QUOTES = """quotes AS (
  SELECT event_type AS symbol, event_id, epoch_us(ts)*1000 + event_id%1000 AS event_ns, value AS bid,
    CASE WHEN event_id%97=0 THEN value*0.99::DOUBLE WHEN event_id%61=0 THEN value
      ELSE value*(1 + (1+event_id%7)*0.0001::DOUBLE) END AS ask,
    CASE WHEN event_id%89=0 THEN 0.0 ELSE (1+event_id%9) END::DOUBLE AS bid_size, (1+event_id%5)::DOUBLE AS ask_size,
    (event_id%53<>0) AS cond_ok,
    CASE WHEN event_id%71=0 THEN 'Z' ELSE ['A','B','C'][1+event_id%3] END AS tape
  FROM events)"""

MINUTE_QUOTES = QUOTES + """, minute_quotes AS (
  SELECT * REPLACE (event_ns//60000000000*60000000000 AS event_ns) FROM quotes)"""

FILLS = f"""fills AS (
  SELECT {SYMBOL} AS symbol, CASE WHEN l_linenumber%2=0 THEN 'SELL' ELSE 'BUY' END AS side,
    l_quantity::DECIMAL(18,8) AS quantity, l_extendedprice::DECIMAL(18,8) AS price,
    CASE WHEN l_linestatus='O' THEN 1 ELSE 100 END AS multiplier, l_shipdate::DATE AS day,
    l_orderkey, l_partkey, l_suppkey, l_linenumber
  FROM lineitem)"""

PREDICTIONS = f"""predictions AS (
  SELECT symbol, d, (kp%1000)/1000.0::DOUBLE AS probability, (kr%401-199)/10000.0::DOUBLE AS target_return,
    CASE WHEN (kr%401-199)>0 THEN 1 ELSE 0 END AS target
  FROM (SELECT {SYMBOL} AS symbol, l_shipdate::DATE AS d, sum(l_partkey)::BIGINT AS kp,
    sum(l_suppkey*7+l_orderkey)::BIGINT AS kr FROM lineitem GROUP BY 1,2))"""


def with_views(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
