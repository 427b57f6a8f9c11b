"""Registered queries: warehouse reads, ingest and reports; evidence, identity and context features."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import context as ctx
from ..operators import cutoffs as cut
from ..operators import evidence as ev
from ..operators import identity as idn
from ..operators import warehouse as wh
from ..schemas import contract_checks
from . import oracle_views as V
from . import views
from .registry import query
from .source_queries import scratch

_T = "1998-07-01 00:00:00"
_CATALOG_T = "1998-06-30 00:00:00"
_MACRO_T = "2001-05-15 12:00:00"
_NEWS_T = "2024-02-01 00:00:00"
_ID_T = "2001-06-01 00:00:00"


def at(text):
    return F.lit(text).cast("timestamp")


def us(name, alias=None):
    return F.unix_micros(name).alias(alias or name.replace("_at", "_us"))


def day(name):
    return F.col(name).cast("string").alias(name)


# ---- B: warehouse reads -----------------------------------------------------

_LATEST_BARS = f"""snap AS (SELECT * FROM market_bars WHERE source='yahoo' AND interval='1d' AND data_version LIKE 'snapshot-v2:%'),
known AS (SELECT * FROM snap WHERE available_at <= TIMESTAMP '{_T}'
  QUALIFY row_number() OVER (PARTITION BY instrument_id, event_time ORDER BY available_at DESC, ingested_at DESC, data_version DESC)=1)"""


@query(
    "B13 B21",
    V.with_views(V.MARKET_BARS, _LATEST_BARS)
    + "SELECT instrument_id, epoch_us(event_time) AS event_us, open, high, low, close, volume, epoch_us(available_at) AS available_us, data_version FROM known",
)
def bars_as_of(spark, sf):
    return wh.bars_as_of(views.market_bars(spark, sf), at(_T)).select(
        "instrument_id", F.unix_micros("event_time").alias("event_us"), *wh.OHLCV, us("available_at"), "data_version"
    )


@query(
    "B14 B21",
    V.with_views(V.FUNDAMENTALS)
    + f"""SELECT instrument_id, metric, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end, unit, value, record_id
  FROM fundamentals WHERE available_at <= TIMESTAMP '{_T}'
  QUALIFY row_number() OVER (PARTITION BY instrument_id, metric, period_start, period_end, unit, source ORDER BY filed_at DESC, accession_number DESC)=1""",
)
def fundamentals_as_of(spark, sf):
    return wh.fundamentals_as_of(views.fundamentals(spark, sf), at(_T)).select(
        "instrument_id", "metric", day("period_start"), day("period_end"), "unit", "value", "record_id"
    )


@query(
    "B15 B21",
    V.with_views(V.MACRO)
    + f"""SELECT series_id, CAST(observation_date AS VARCHAR) AS observation_date, CAST(vintage_date AS VARCHAR) AS vintage_date, value FROM macro
  WHERE available_at <= TIMESTAMP '{_T}'
  QUALIFY row_number() OVER (PARTITION BY series_id, observation_date, source ORDER BY vintage_date DESC)=1""",
)
def macro_as_of(spark, sf):
    return wh.macro_as_of(views.macro(spark, sf), at(_T)).select(
        "series_id", day("observation_date"), day("vintage_date"), "value"
    )


def _month_cutoffs(spark, sf):
    """Month starts seen in the orders: the cutoffs of the many-cutoff reads."""
    orders = views.table(spark, sf, "orders")
    return orders.select(F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("cutoff")).distinct()


_CUTOFFS = "cutoffs AS (SELECT DISTINCT date_trunc('month', o_orderdate)::TIMESTAMP AS cutoff FROM orders)"


@query(
    "B21 B15",
    V.with_views(V.MACRO, _CUTOFFS)
    + """SELECT epoch_us(cutoff) AS cutoff_us, series_id, count(*) AS observations, count(value) AS present,
  CAST(max(vintage_date) AS VARCHAR) AS last_vintage, round(sum(value),2) AS total FROM (
  SELECT * FROM cutoffs JOIN macro ON available_at<=cutoff
  QUALIFY row_number() OVER (PARTITION BY cutoff, series_id, observation_date, source ORDER BY vintage_date DESC)=1) GROUP BY 1,2""",
)
def macro_at_month_starts(spark, sf):
    rows = wh.macro_at_cutoffs(views.macro(spark, sf), _month_cutoffs(spark, sf))
    return rows.groupBy(F.unix_micros("cutoff").alias("cutoff_us"), "series_id").agg(
        F.count(F.lit(1)).alias("observations"), F.count("value").alias("present"),
        F.max("vintage_date").cast("string").alias("last_vintage"),
        F.round(F.sum(F.col("value").cast("decimal(20,2)")), 2).cast("double").alias("total"),
    )


@query(
    "B21 B14",
    V.with_views(V.FUNDAMENTALS, "cutoffs AS (SELECT DISTINCT date_trunc('year', o_orderdate)::TIMESTAMP AS cutoff FROM orders)")
    + """SELECT epoch_us(cutoff) AS cutoff_us, metric, unit, count(*) AS facts, count(value) AS present, max(record_id) AS last_record FROM (
  SELECT * FROM cutoffs JOIN fundamentals ON available_at<=cutoff
  QUALIFY row_number() OVER (PARTITION BY cutoff, instrument_id, metric, period_start, period_end, unit, source
    ORDER BY filed_at DESC, accession_number DESC)=1) GROUP BY 1,2,3""",
)
def fundamentals_at_year_starts(spark, sf):
    orders = views.table(spark, sf, "orders")
    cutoffs = orders.select(F.date_trunc("year", F.col("o_orderdate").cast("timestamp")).alias("cutoff")).distinct()
    rows = wh.fundamentals_at_cutoffs(views.fundamentals(spark, sf), cutoffs)
    return rows.groupBy(F.unix_micros("cutoff").alias("cutoff_us"), "metric", "unit").agg(
        F.count(F.lit(1)).alias("facts"), F.count("value").alias("present"), F.max("record_id").alias("last_record")
    )


@query(
    "B21 B13",
    V.with_views(V.MARKET_BARS, "cutoffs AS (SELECT DISTINCT date_trunc('year', o_orderdate)::TIMESTAMP AS cutoff FROM orders)")
    + """SELECT epoch_us(cutoff) AS cutoff_us, instrument_id, count(*) AS bars, epoch_us(max(event_time)) AS last_event_us, epoch_us(max(available_at)) AS last_available_us,
  max(data_version) AS last_version, min(close) AS lowest_close, max(close) AS highest_close FROM (
  SELECT * FROM cutoffs JOIN market_bars ON available_at<=cutoff WHERE source='yahoo' AND interval='1d' AND data_version LIKE 'snapshot-v2:%'
  QUALIFY row_number() OVER (PARTITION BY cutoff, instrument_id, event_time ORDER BY available_at DESC, ingested_at DESC, data_version DESC)=1) GROUP BY 1,2""",
)
def bars_at_year_starts(spark, sf):
    orders = views.table(spark, sf, "orders")
    cutoffs = orders.select(F.date_trunc("year", F.col("o_orderdate").cast("timestamp")).alias("cutoff")).distinct()
    rows = wh.bars_at_cutoffs(views.market_bars(spark, sf), cutoffs)
    return rows.groupBy(F.unix_micros("cutoff").alias("cutoff_us"), "instrument_id").agg(
        F.count(F.lit(1)).alias("bars"), F.unix_micros(F.max("event_time")).alias("last_event_us"),
        F.unix_micros(F.max("available_at")).alias("last_available_us"), F.max("data_version").alias("last_version"),
        F.min("close").alias("lowest_close"), F.max("close").alias("highest_close"),
    )


# ---- B: ingest --------------------------------------------------------------


def _split_bars(spark, sf):
    """Stored versions known at T, and a fresh snapshot of the same days taken later."""
    bars = views.market_bars(spark, sf)
    stored = bars.filter(F.col("available_at") <= at(_T))
    later = wh.bars_as_of(bars, at("2002-06-01 00:00:00")).withColumns(
        {
            "available_at": at("2002-06-01 00:00:00"),
            "data_version": F.concat(F.lit("snapshot-v2:later:"), F.sha2(F.col("data_version"), 256)),
        }
    )
    return stored, later.withColumn("ingested_at", F.col("available_at"))


@query(
    "B5 B3 B6",
    V.with_views(V.MARKET_BARS, _LATEST_BARS)
    + """, latest AS (SELECT * FROM snap WHERE available_at<=TIMESTAMP '1998-07-01' QUALIFY row_number() OVER
  (PARTITION BY instrument_id, event_time, interval, source ORDER BY available_at DESC, ingested_at DESC, data_version DESC)=1),
incoming AS (SELECT * FROM snap WHERE available_at<=TIMESTAMP '2002-06-01' QUALIFY row_number() OVER
  (PARTITION BY instrument_id, event_time ORDER BY available_at DESC, ingested_at DESC, data_version DESC)=1)
SELECT i.instrument_id, epoch_us(i.event_time) AS event_us, i.open, i.close, i.volume, 'snapshot-v2:later:'||sha256(i.data_version) AS data_version
FROM incoming i LEFT JOIN latest b ON i.instrument_id=b.instrument_id AND i.event_time=b.event_time
WHERE b.instrument_id IS NULL OR i.open IS DISTINCT FROM b.open OR i.high IS DISTINCT FROM b.high OR i.low IS DISTINCT FROM b.low
  OR i.close IS DISTINCT FROM b.close OR i.volume IS DISTINCT FROM b.volume""",
)
def append_changed_bars(spark, sf):
    stored, incoming = _split_bars(spark, sf)
    return wh.append_if_changed(stored, incoming).select(
        "instrument_id", F.unix_micros("event_time").alias("event_us"), "open", "close", "volume", "data_version"
    )


@query(
    "B6 B22 B4 A7",
    V.with_views(V.BARS)
    + """SELECT 'YF:'||upper(symbol) AS instrument_id, epoch_us(d::TIMESTAMP) AS event_us, close, epoch_us(TIMESTAMP '1999-01-01 06:00:00') AS available_us,
  'snapshot-v2:1999-01-01T06:00:00.000000+00:00' AS version_head FROM bars WHERE d::TIMESTAMP + INTERVAL 1 DAY <= TIMESTAMP '1999-01-01 06:00:00'""",
)
def stamped_snapshots(spark, sf):
    frame = views.bars(spark, sf).withColumn("event_time", F.col("d").cast("timestamp"))
    stamped = wh.stamp_snapshot(frame, at("1999-01-01 06:00:00"))
    return stamped.select(
        "instrument_id", F.unix_micros("event_time").alias("event_us"), "close", us("available_at"),
        F.regexp_extract("data_version", r"^(.*):[0-9a-f]{64}$", 1).alias("version_head"),
    )


@query(
    "B7 B3",
    V.with_views(V.FUNDAMENTALS)
    + f"""SELECT f.record_id, f.instrument_id, f.value FROM fundamentals f WHERE f.available_at > TIMESTAMP '1998-01-01' - INTERVAL 90 DAY
  AND f.record_id NOT IN (SELECT record_id FROM fundamentals WHERE available_at <= TIMESTAMP '1998-01-01')""",
)
def ingest_fundamentals(spark, sf):
    facts = views.fundamentals(spark, sf)
    stored = facts.filter(F.col("available_at") <= at("1998-01-01"))
    batch = facts.filter(F.col("available_at") > F.timestamp_add("DAY", F.lit(-90), at("1998-01-01")))
    return wh.ingest_fundamentals(stored, batch).select("record_id", "instrument_id", "value")


@query(
    "B8",
    V.with_views(V.MACRO)
    + """SELECT series_id, CAST(observation_date AS VARCHAR) AS observation_date, CAST(vintage_date AS VARCHAR) AS vintage_date, value,
  CAST(CASE WHEN available_at > TIMESTAMP '1998-01-01' - INTERVAL 90 DAY THEN realtime_end + 30 ELSE realtime_end END AS VARCHAR) AS realtime_end FROM macro""",
)
def merge_macro(spark, sf):
    rows = views.macro(spark, sf)
    stored = rows.filter(F.col("available_at") <= at("1998-01-01"))
    batch = rows.filter(F.col("available_at") > F.timestamp_add("DAY", F.lit(-90), at("1998-01-01"))).withColumn(
        "realtime_end", F.date_add("realtime_end", 30)
    )
    return wh.merge_macro(stored, batch).select(
        "series_id", day("observation_date"), day("vintage_date"), "value", day("realtime_end")
    )


@query(
    "B8",
    V.with_views(V.MACRO)
    + """SELECT series_id, CAST(observation_date AS VARCHAR) AS observation_date, CAST(vintage_date AS VARCHAR) AS vintage_date, value,
  CAST(CASE WHEN available_at > TIMESTAMP '1998-01-01' - INTERVAL 90 DAY AND available_at <= TIMESTAMP '1998-07-01' THEN realtime_end + 30 ELSE realtime_end END AS VARCHAR) AS realtime_end
  FROM macro WHERE available_at <= TIMESTAMP '1998-07-01'""",
)
def merge_macro_partitions(spark, sf):
    """The same merge into a stored table, in two batches: only the partitions they touch are replaced."""
    rows, root = views.stored(views.macro(spark, sf)), scratch(spark, "macro-table")
    wh.write_macro(rows.filter(F.col("available_at") <= at("1998-01-01")), root)
    early = F.timestamp_add("DAY", F.lit(-90), at("1998-01-01"))
    for first, last in ((early, at("1998-03-01")), (at("1998-03-01"), at("1998-07-01"))):
        batch = rows.filter((F.col("available_at") > first) & (F.col("available_at") <= last))
        wh.merge_macro_into(root, batch.withColumn("realtime_end", F.date_add("realtime_end", 30)))
    merged = wh.read_macro(spark, root, rows.schema.fields)
    return merged.select("series_id", day("observation_date"), day("vintage_date"), "value", day("realtime_end"))


@query(
    "B9 A14",
    V.with_views(V.NEWS)
    + f"""SELECT event_id, title_hash, epoch_us(available_at) AS available_us FROM news WHERE ingested_at > TIMESTAMP '{_NEWS_T}' - INTERVAL 7 DAY
  AND event_id NOT IN (SELECT event_id FROM news WHERE ingested_at <= TIMESTAMP '{_NEWS_T}')""",
)
def ingest_news(spark, sf):
    rows = views.news(spark, sf)
    stored = rows.filter(F.col("ingested_at") <= at(_NEWS_T))
    batch = rows.filter(F.col("ingested_at") > F.timestamp_add("DAY", F.lit(-7), at(_NEWS_T)))
    return wh.ingest_news(stored, batch).select("event_id", "title_hash", us("available_at"))


@query(
    "B10",
    V.with_views(V.IDENTITIES)
    + """SELECT source, symbol AS source_symbol, instrument_id, epoch_us(available_at) AS available_us FROM identities
  QUALIFY row_number() OVER (PARTITION BY source, symbol ORDER BY (valid_from >= TIMESTAMP '2001-01-01') DESC, available_at DESC, ingested_at DESC, instrument_id DESC)=1""",
)
def upsert_aliases(spark, sf):
    rows = views.identities(spark, sf)
    aliases = rows.select("source", F.col("symbol").alias("source_symbol"), "instrument_id", "available_at", "ingested_at")
    early = rows["valid_from"] < at("2001-01-01")
    return wh.upsert_aliases(aliases.filter(early), aliases.filter(~early)).select(
        "source", "source_symbol", "instrument_id", us("available_at")
    )


@query(
    "A25 A26",
    V.with_views(V.NEWS)
    + "SELECT source, count(*) AS record_count, "
    + ", ".join(
        f"CAST(sum(('0x'||substr(sha256(event_id||title_hash),{1 + 8 * i},8))::UBIGINT) AS VARCHAR) AS w{i}" for i in range(8)
    )
    + " FROM news GROUP BY source",
)
def batch_content_words(spark, sf):
    """The mergeable word sums behind a content digest, per news source."""
    from ..functions.digest import word_sums

    hashed = views.news(spark, sf).withColumn("_h", F.sha2(F.concat("event_id", "title_hash"), 256))
    grouped = hashed.groupBy("source").agg(F.count(F.lit(1)).alias("record_count"), *word_sums(F.col("_h")))
    return grouped.select("source", "record_count", *[F.col(f"w{i}").cast("string").alias(f"w{i}") for i in range(8)])


def _digest_sql(rows: str, by: str, out: str = "digest") -> str:
    """Group digest from a query with columns ``by`` and row hash ``h``."""
    words = ", ".join(f"sum(('0x'||substr(h,{1 + 8 * i},8))::UBIGINT)::VARCHAR" for i in range(8))
    return f"SELECT {by}, count(*) AS rows, sha256(concat_ws(':', count(*)::VARCHAR, {words})) AS {out} FROM ({rows}) GROUP BY {by}"


@query(
    "A25 A26 C12",
    _digest_sql("SELECT c_mktsegment, sha256(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey})) AS h FROM customer", "c_mktsegment"),
)
def dataset_fingerprints(spark, sf):
    from ..functions.digest import content_id, dataset_digest

    customers = views.table(spark, sf, "customer")
    return dataset_digest(customers, content_id(["c_custkey", "c_name", "c_nationkey"]), ["c_mktsegment"])


@query(
    "A25 A26",
    V.with_views(V.BARS)
    + _digest_sql(
        "SELECT symbol, sha256(to_json({'symbol': symbol, 'd': d::VARCHAR, " + ", ".join(f"'{c}': rtrim(rtrim({c}::VARCHAR,'0'),'.')" for c in wh.OHLCV) + "})) AS h FROM bars", "symbol"
    ),
)
def bar_fingerprints(spark, sf):
    """Digest per symbol over every bar field; doubles enter as their shortest decimal text."""
    from ..functions.digest import canonical_number, content_id, dataset_digest

    fields = ["symbol", F.col("d").cast("string").alias("d"), *[canonical_number(F.col(c)).alias(c) for c in wh.OHLCV]]
    return dataset_digest(views.bars(spark, sf), content_id(fields), ["symbol"])


# ---- B: reports -------------------------------------------------------------


@query(
    "B16",
    V.with_views(V.MARKET_BARS, V.FUNDAMENTALS, V.MACRO, V.NEWS)
    + " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, source, count(*) AS rows, epoch_us(min(available_at)) AS first_us, epoch_us(max(available_at)) AS last_us FROM {v} GROUP BY source"
        for t, v in (("fundamentals", "fundamentals"), ("macro_observations", "macro"), ("news_events", "news"), ("market_bars", "market_bars"))
    ),
)
def coverage_report(spark, sf):
    tables = {
        "fundamentals": views.fundamentals(spark, sf), "macro_observations": views.macro(spark, sf),
        "news_events": views.news(spark, sf), "market_bars": views.market_bars(spark, sf),
    }
    return wh.coverage(tables).select(
        "table_name", "source", "rows", us("first_available", "first_us"), us("last_available", "last_us")
    )


@query(
    "B17 B2",
    V.with_views(V.FUNDAMENTALS, V.MACRO, V.NEWS)
    + """SELECT 'fundamental_available_before_filed' AS check_name, count(*) FILTER (available_at<filed_at) AS violations FROM fundamentals
UNION ALL SELECT 'macro_available_before_vintage', count(*) FILTER (available_at::DATE<vintage_date) FROM macro
UNION ALL SELECT 'news_available_before_published', count(*) FILTER (available_at<published_at) FROM news
UNION ALL SELECT 'news_available_before_first_seen', count(*) FILTER (available_at<first_seen_at) FROM news""",
)
def availability_violations(spark, sf):
    return wh.violation_report(views.fundamentals(spark, sf), views.macro(spark, sf), views.news(spark, sf))


@query(
    "B18 B20",
    V.with_views(V.MARKET_BARS, V.FUNDAMENTALS)
    + """SELECT 'market_bars_adjusted_v1' AS kind, count(*) FILTER (data_version='adjusted-v1') AS rows FROM market_bars
UNION ALL SELECT 'fundamentals_legacy', count(*) FILTER (period_start IS NULL OR value IS NULL) FROM fundamentals""",
)
def excluded_rows(spark, sf):
    _, legacy = wh.split_legacy(views.fundamentals(spark, sf), ["period_start", "value"])
    return wh.excluded_report(views.market_bars(spark, sf), {"fundamentals_legacy": legacy})


@query(
    "B19",
    V.with_views(V.MARKET_BARS, V.FUNDAMENTALS, V.MACRO, V.NEWS, V.IDENTITIES)
    + " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows FROM {t}" for t in ("market_bars", "fundamentals", "macro", "news", "identities")),
)
def warehouse_stats(spark, sf):
    return wh.table_stats({t: getattr(views, t)(spark, sf) for t in ("market_bars", "fundamentals", "macro", "news", "identities")})


@query(
    "B2 B3",
    V.with_views(V.FUNDAMENTALS)
    + """SELECT count(*) AS rows, count(*)-count(DISTINCT record_id) AS duplicate_keys,
  count(*) FILTER (period_start>period_end) AS period_start_after_end, count(*) FILTER (available_at<filed_at) AS available_before_filed FROM fundamentals""",
)
def contract_report(spark, sf):
    checks = contract_checks("fundamentals")
    names = ("period_start_after_end", "available_before_filed")
    per_key = views.fundamentals(spark, sf).groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(checks[c]).alias(c) for c in names]
    )
    return per_key.agg(
        F.sum("n").alias("rows"), F.sum(F.col("n") - 1).alias("duplicate_keys"), *[F.sum(c).alias(c) for c in names]
    )


# ---- C: evidence ------------------------------------------------------------

_KNOWN = "available_at < TIMESTAMP '{t}' AND ingested_at < TIMESTAMP '{t}'"


@query(
    "C1 C3",
    V.with_views(V.MARKET_BARS)
    + f"""SELECT instrument_id, epoch_us(event_time) AS event_us, close, data_version FROM market_bars
  WHERE {_KNOWN.format(t=_T)} AND data_version LIKE 'snapshot-v2:%' AND event_time + INTERVAL 1 DAY <= TIMESTAMP '{_T}'
  QUALIFY row_number() OVER (PARTITION BY instrument_id, event_time, interval, source ORDER BY available_at DESC, ingested_at DESC, data_version DESC)=1""",
)
def evidence_market(spark, sf):
    return ev.market_section(views.market_bars(spark, sf), at(_T)).select(
        "instrument_id", F.unix_micros("event_time").alias("event_us"), "close", "data_version"
    )


@query(
    "C1 C3",
    V.with_views(V.MARKET_BARS)
    + f"""SELECT instrument_id, epoch_us(event_time) AS event_us, close, data_version FROM market_bars
  WHERE available_at < TIMESTAMP '{_T}' AND data_version LIKE 'snapshot-v2:%' AND event_time + INTERVAL 1 DAY <= TIMESTAMP '{_T}'
  QUALIFY row_number() OVER (PARTITION BY instrument_id, event_time, interval, source ORDER BY available_at DESC, ingested_at DESC, data_version DESC)=1""",
)
def evidence_market_reconstructed(spark, sf):
    return ev.market_section(views.market_bars(spark, sf), at(_T), "reconstructed").select(
        "instrument_id", F.unix_micros("event_time").alias("event_us"), "close", "data_version"
    )


@query(
    "C4",
    V.with_views(V.FUNDAMENTALS)
    + f"""SELECT record_id, instrument_id, metric, unit, value FROM fundamentals WHERE {_KNOWN.format(t=_T)}
  AND filed_at < TIMESTAMP '{_T}' AND period_end <= DATE '{_T[:10]}'
  QUALIFY row_number() OVER (PARTITION BY instrument_id, metric, period_start, period_end, unit, source
    ORDER BY filed_at DESC, accession_number DESC NULLS LAST, available_at DESC, ingested_at DESC, record_id DESC)=1""",
)
def evidence_fundamentals(spark, sf):
    return ev.fundamentals_section(views.fundamentals(spark, sf), at(_T)).select(
        "record_id", "instrument_id", "metric", "unit", "value"
    )


@query(
    "C5",
    V.with_views(V.MACRO)
    + f"""SELECT series_id, CAST(observation_date AS VARCHAR) AS observation_date, value FROM macro WHERE {_KNOWN.format(t=_T)}
  AND observation_date <= DATE '{_T[:10]}' AND vintage_date <= DATE '{_T[:10]}' AND series_id IN ('DFF','DGS10','CPIAUCSL','UNRATE')
  QUALIFY row_number() OVER (PARTITION BY series_id, observation_date, source ORDER BY vintage_date DESC, available_at DESC, ingested_at DESC)=1""",
)
def evidence_macro(spark, sf):
    return ev.macro_section(views.macro(spark, sf), at(_T), list(ctx.MACRO_POLICY)).select(
        "series_id", day("observation_date"), "value"
    )


_NEWS_ELIGIBLE = f"eligible AS (SELECT * FROM news WHERE {_KNOWN.format(t=_NEWS_T)} AND published_at < TIMESTAMP '{_NEWS_T}' AND first_seen_at < TIMESTAMP '{_NEWS_T}')"
_NEWS_ROWS = "entity_news AS (SELECT e1 AS entity, * EXCLUDE (e1,e2) FROM eligible UNION ALL SELECT e2, * EXCLUDE (e1,e2) FROM eligible)"


@query("C6", V.with_views(V.NEWS, _NEWS_ELIGIBLE, _NEWS_ROWS) + "SELECT entity, event_id, title_hash FROM entity_news")
def evidence_news(spark, sf):
    return ev.news_section(views.news(spark, sf), at(_NEWS_T)).select("entity", "event_id", "title_hash")


@query(
    "C7 C10",
    V.with_views(V.NEWS, _NEWS_ELIGIBLE)
    + "SELECT source, count(*) AS rows, CAST(0 AS BIGINT) AS malformed, count(*) FILTER (length(title_hash)<>64) AS bad_hash FROM eligible GROUP BY source",
)
def news_entity_guard(spark, sf):
    eligible = ev.time_eligible_news(views.news(spark, sf), at(_NEWS_T))
    return eligible.groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ev.entities_malformed()).alias("malformed"),
        F.count_if(~F.col("title_hash").rlike("^[a-f0-9]{64}$")).alias("bad_hash"),
    )


_PROPS = """props_rows AS (SELECT event_type, event_id, props, epoch_us(ts) AS at_us FROM events)"""


@query(
    "C7 C6",
    V.with_views(_PROPS)
    + """, lists AS (SELECT event_type, props, CASE event_id%7 WHEN 0 THEN props WHEN 1 THEN '["a","b"]' WHEN 2 THEN '[]' WHEN 3 THEN '[null]' WHEN 4 THEN '["a",null]' WHEN 5 THEN '["a",1]' ELSE '["a",' END AS entities FROM props_rows)
SELECT event_type, count(*) AS rows, count(*) FILTER (CASE WHEN NOT json_valid(entities) THEN true WHEN json_type(entities)<>'ARRAY' THEN true
  ELSE len(list_filter(json_extract(entities,'$[*]'), lambda e: json_type(e)<>'VARCHAR'))>0 END) AS malformed,
  count(*) FILTER (NOT json_valid(entities) OR json_type(CASE WHEN json_valid(entities) THEN entities END)<>'OBJECT') AS not_objects FROM lists GROUP BY event_type""",
)
def malformed_entity_arrays(spark, sf):
    """Lists with nulls and numbers, objects and broken text where an array of strings is required."""
    texts = ['["a","b"]', "[]", "[null]", '["a",null]', '["a",1]', '["a",']
    entities = F.col("props")
    for number, text in enumerate(texts, 1):
        entities = F.when(F.col("event_id") % 7 == number, F.lit(text)).otherwise(entities)
    rows = views.table(spark, sf, "events").withColumn("entities", entities)
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(ev.entities_malformed("entities")).alias("malformed"),
        F.count_if(ev.flags_malformed("entities")).alias("not_objects"),
    )


_IDENTITY = f"""effective AS (SELECT * FROM identities WHERE {_KNOWN.format(t=_ID_T)} AND valid_from <= TIMESTAMP '{_ID_T}'
  AND (valid_to IS NULL OR valid_to > TIMESTAMP '{_ID_T}'))"""


@query("C2", V.with_views(V.IDENTITIES, _IDENTITY) + "SELECT instrument_id, symbol, asset_class, primary_exchange, source, epoch_us(valid_from) AS from_us FROM effective")
def evidence_identity(spark, sf):
    return ev.identity_section(views.identities(spark, sf), at(_ID_T)).select(
        "instrument_id", "symbol", "asset_class", "primary_exchange", "source", us("valid_from", "from_us")
    )


def _summary_sql(section: str, kind: str, entity: str, order: str, limit: int, cutoff: str, entities: str, news: bool = False, value: bool = False) -> str:
    nulls = f"coalesce(max(CASE WHEN rn<={limit} AND value IS NULL THEN 1 ELSE 0 END),0)" if value else "0"
    identity = "(CASE WHEN max(alln)>1 THEN 1 ELSE 0 END)" if kind == "identity" else "0"
    newsw = "(CASE WHEN count(rn)>0 THEN 1 ELSE 0 END)" if news else "0"
    return f"""ranked_{kind} AS (SELECT *, least({limit}+1, count(*) OVER (PARTITION BY {entity})) AS alln,
   row_number() OVER (PARTITION BY {entity} ORDER BY {order}) AS rn FROM {section} QUALIFY rn<={limit}+1),
stat_{kind} AS (SELECT e.entity, count(rn) FILTER (rn<={limit}) AS cnt, coalesce(max(rn)>{limit}, false) AS truncated,
   max(available_at) FILTER (rn<={limit}) AS latest,
   (CASE WHEN coalesce(max(rn)>{limit}, false) THEN 1 ELSE 0 END) + (CASE WHEN count(rn)=0 THEN 1 ELSE 0 END) + {nulls if not value else f"(CASE WHEN count(rn)=0 THEN 0 ELSE {nulls} END)"} + {identity} + {newsw} AS warnings
   FROM ({entities}) e LEFT JOIN ranked_{kind} r ON r.{entity}=e.entity GROUP BY e.entity),
out_{kind} AS (SELECT '{kind}' AS section, entity, CASE WHEN cnt=0 THEN 'MISSING' WHEN warnings>0 THEN 'PARTIAL' ELSE 'AVAILABLE' END AS status,
   cnt AS count, truncated, epoch_us(latest) AS latest_us, (epoch_us(TIMESTAMP '{cutoff}')-epoch_us(latest))/1e6::DOUBLE AS age_s, CAST(warnings AS BIGINT) AS warnings FROM stat_{kind})"""


@query(
    "C8 C9 C14 C24",
    V.with_views(
        V.MARKET_BARS, V.MACRO, V.NEWS, V.IDENTITIES, _IDENTITY, _NEWS_ELIGIBLE, _NEWS_ROWS,
        f"""mk AS (SELECT * FROM market_bars WHERE {_KNOWN.format(t=_T)} AND data_version LIKE 'snapshot-v2:%' AND event_time + INTERVAL 1 DAY <= TIMESTAMP '{_T}'
  QUALIFY row_number() OVER (PARTITION BY instrument_id, event_time ORDER BY available_at DESC, ingested_at DESC, data_version DESC)=1)""",
        f"""mc AS (SELECT * FROM macro WHERE {_KNOWN.format(t=_T)} AND observation_date <= DATE '{_T[:10]}' AND vintage_date <= DATE '{_T[:10]}'
  QUALIFY row_number() OVER (PARTITION BY series_id, observation_date ORDER BY vintage_date DESC, available_at DESC, ingested_at DESC)=1)""",
        _summary_sql("effective", "identity", "instrument_id", "valid_from DESC, source, available_at DESC, ingested_at DESC", 500, _ID_T, "SELECT DISTINCT instrument_id AS entity FROM identities"),
        _summary_sql("mk", "market", "instrument_id", "event_time DESC, source, data_version DESC", 500, _T, "SELECT DISTINCT instrument_id AS entity FROM market_bars"),
        _summary_sql("mc", "macro", "series_id", "observation_date DESC, source, vintage_date DESC", 500, _T, "SELECT DISTINCT series_id AS entity FROM macro", value=True),
        _summary_sql("entity_news", "news", "entity", "published_at DESC, available_at DESC, ingested_at DESC, event_id", 20, _NEWS_T, "SELECT DISTINCT e1 AS entity FROM news UNION SELECT DISTINCT e2 FROM news", news=True),
    )
    + "SELECT * FROM out_identity UNION ALL SELECT * FROM out_market UNION ALL SELECT * FROM out_macro UNION ALL SELECT * FROM out_news",
)
def section_summaries(spark, sf):
    bars, macro = views.market_bars(spark, sf), views.macro(spark, sf)
    news, ids = views.news(spark, sf), views.identities(spark, sf)
    entities = news.select(F.explode(F.from_json("entity_ids", "array<string>")).alias("entity"))
    parts = [
        (ids, ev.identity_section(ids, at(_ID_T)), "identity", _ID_T, 500),
        (bars, ev.market_section(bars, at(_T)), "market", _T, 500),
        (macro, ev.macro_section(macro, at(_T)), "macro", _T, 500),
        (entities, ev.news_section(news, at(_NEWS_T)), "news", _NEWS_T, 20),
    ]
    result = None
    for asked, section, kind, cutoff, limit in parts:
        rows = ev.section_summary(asked, ev.limited(section, kind, limit), kind, at(cutoff), limit).select(
            "section", "entity", "status", "count", "truncated", us("latest_available_at", "latest_us"),
            F.col("availability_age_seconds").alias("age_s"), "warnings",
        )
        result = rows if result is None else result.unionByName(rows)
    return result


@query(
    "C10 C23 D14",
    V.with_views(V.MACRO)
    + f"""SELECT series_id, count(*) AS rows, count(*) FILTER (NOT ({_KNOWN.format(t=_T)})) AS not_strictly_available,
  count(*) FILTER (greatest(observation_date, vintage_date) > DATE '{_T[:10]}') AS future_observation_or_vintage,
  count(*) FILTER (vintage_date > available_at::DATE) AS available_before_vintage FROM macro GROUP BY series_id""",
)
def macro_row_reasons(spark, sf):
    tagged = ev.validated(views.macro(spark, sf), "macro", at(_T))
    codes = ("not_strictly_available", "future_observation_or_vintage", "available_before_vintage")
    return tagged.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(F.array_contains("reasons", c)).alias(c) for c in codes]
    )


_ISO = "strftime({}, '%Y-%m-%dT%H:%M:%S.%f')||'+00:00'"
_ID_RECORDS = f"""SELECT 'identity' AS section, instrument_id AS entity, sha256('identity:'||instrument_id||':'||sha256('identity:'||to_json({{'instrument_id': instrument_id, 'symbol': symbol,
  'asset_class': asset_class, 'primary_exchange': primary_exchange, 'valid_from': {_ISO.format("valid_from")}, 'valid_to': {_ISO.format("valid_to")},
  'available_at': {_ISO.format("available_at")}, 'ingested_at': {_ISO.format("ingested_at")}, 'source': source}}))) AS h FROM effective"""


@query("C11 C12 A25 A26", V.with_views(V.IDENTITIES, _IDENTITY) + _digest_sql(_ID_RECORDS, "section, entity", "snapshot_hash"))
def identity_snapshot_hashes(spark, sf):
    section = ev.identity_section(views.identities(spark, sf), at(_ID_T))
    return ev.snapshot_hash(ev.packet_records({"identity": section}), ["section", "entity"])


_NUM = "rtrim(rtrim({c}::VARCHAR,'0'),'.')"
_MK_FIELDS = ", ".join(f"'{c}': {_NUM.format(c=c)}" for c in ("open", "high", "low", "close", "volume"))


def _record_id(kind: str, fields: str) -> str:
    return f"sha256('{kind}:'||to_json({{{fields}}}))"


_MARKET_ID = _record_id(
    "market",
    f"'instrument_id': instrument_id, 'event_time': {_ISO.format('event_time')}, 'interval': interval, {_MK_FIELDS}, 'available_at': {_ISO.format('available_at')}, "
    f"'ingested_at': {_ISO.format('ingested_at')}, 'source': source, 'data_version': data_version",
)
_MACRO_ID = _record_id(
    "macro",
    f"'series_id': series_id, 'observation_date': observation_date::VARCHAR, 'value': {_NUM.format(c='value')}, 'vintage_date': vintage_date::VARCHAR, 'available_at': {_ISO.format('available_at')}, "
    f"'ingested_at': {_ISO.format('ingested_at')}, 'source': source, 'availability_basis': availability_basis",
)
_LIMITS = {"market": 500, "macro": 500}
_REQUEST = '{"as_of":"' + _T + '","max_records":500,"mode":"local_observed"}'
_PACKET = V.with_views(
    V.MARKET_BARS, V.MACRO,
    f"""mk AS (SELECT * FROM market_bars WHERE {_KNOWN.format(t=_T)} AND data_version LIKE 'snapshot-v2:%' AND event_time + INTERVAL 1 DAY <= TIMESTAMP '{_T}'
  QUALIFY row_number() OVER (PARTITION BY instrument_id, event_time ORDER BY available_at DESC, ingested_at DESC, data_version DESC)=1)""",
    f"""mc AS (SELECT * FROM macro WHERE {_KNOWN.format(t=_T)} AND observation_date <= DATE '{_T[:10]}' AND vintage_date <= DATE '{_T[:10]}'
  QUALIFY row_number() OVER (PARTITION BY series_id, observation_date ORDER BY vintage_date DESC, available_at DESC, ingested_at DESC)=1)""",
    _summary_sql("mk", "market", "instrument_id", "event_time DESC, source, data_version DESC", 500, _T, "SELECT DISTINCT instrument_id AS entity FROM market_bars"),
    _summary_sql("mc", "macro", "series_id", "observation_date DESC, source, vintage_date DESC", 500, _T, "SELECT DISTINCT series_id AS entity FROM macro", value=True),
    f"""ids AS (SELECT 'market' AS section, instrument_id AS entity, {_MARKET_ID} AS id FROM ranked_market WHERE rn<=500
  UNION ALL SELECT 'macro', series_id, {_MACRO_ID} FROM ranked_macro WHERE rn<=500)""",
    f"hashed AS ({_digest_sql("SELECT section, entity, sha256(section||':'||entity||':'||id) AS h FROM ids", 'section, entity', 'snapshot_hash')})",
    """rows_ AS (SELECT section, entity, status, count, truncated, latest_us, warnings, snapshot_hash FROM (SELECT * FROM out_market UNION ALL SELECT * FROM out_macro)
  LEFT JOIN (SELECT section, entity, snapshot_hash FROM hashed) USING (section, entity))""",
    f"""whole AS (SELECT sha256(sha256('{_REQUEST}')||':'||digest) AS packet_hash FROM ({_digest_sql("SELECT 1 AS g, sha256(to_json({'section': section, 'entity': entity, 'status': status, 'count': count, 'truncated': truncated, 'latest_us': latest_us, 'warnings': warnings, 'snapshot_hash': snapshot_hash})) AS h FROM rows_", 'g')}))""",
)


def _packet(spark, sf) -> ev.Packet:
    bars, macro = views.market_bars(spark, sf), views.macro(spark, sf)
    sections = {"market": ev.market_section(bars, at(_T)), "macro": ev.macro_section(macro, at(_T))}
    return ev.build_packet({"market": bars, "macro": macro}, sections, at(_T), _LIMITS, _REQUEST)


@query("C11 C12 A25 A26", _PACKET + "SELECT section, entity, status, count, truncated, latest_us, warnings, snapshot_hash, packet_hash FROM rows_, whole")
def packet_snapshot_hashes(spark, sf):
    """Section rows with the digest of their records, and the hash over the request and all of them."""
    packet = _packet(spark, sf)
    return packet.sections.crossJoin(packet.hash)  # one row


@query(
    "C13",
    _PACKET
    + """SELECT 'market' AS section, instrument_id AS entity, 'record_hash_mismatch' AS reason, count(*) AS rows FROM ranked_market WHERE rn<=500 AND dayofyear(event_time)%100=0 GROUP BY 2
UNION ALL SELECT 'macro', series_id, unnest(['count_mismatch', 'snapshot_hash_mismatch']), 1 FROM ranked_macro WHERE rn<=500 AND rn>1 AND dayofyear(observation_date)%50=0 GROUP BY series_id
UNION ALL SELECT section, entity, unnest(['warnings_inconsistent', 'status_inconsistent']), 1 FROM rows_ WHERE section='market' AND status='PARTIAL' AND entity LIKE '%7'
UNION ALL SELECT 'packet', NULL, 'packet_hash_mismatch', 1""",
)
def packet_tampering(spark, sf):
    """An archive with altered prices, dropped observations and prettified sections: everything altered is found."""
    packet = _packet(spark, sf)
    market = packet.records["market"].withColumn("close", F.col("close") + F.when(F.dayofyear("event_time") % 100 == 0, 0.25).otherwise(0.0))
    newest = F.max("observation_date").over(W.partitionBy("series_id"))
    macro = packet.records["macro"].withColumn("_newest", newest).filter((F.dayofyear("observation_date") % 50 != 0) | (F.col("observation_date") == F.col("_newest"))).drop("_newest")
    pretty = (F.col("section") == "market") & (F.col("status") == "PARTIAL") & F.col("entity").endswith("7")
    sections = packet.sections.withColumns({"status": F.when(pretty, "AVAILABLE").otherwise(F.col("status")), "warnings": F.when(pretty, 0).otherwise(F.col("warnings"))})
    return ev.packet_violations(ev.Packet({"market": market, "macro": macro}, sections, packet.hash), at(_T), _LIMITS, _REQUEST)


@query("C13", _PACKET + "SELECT section, count(*) AS entities, 0::BIGINT AS violations FROM rows_ GROUP BY section")
def packet_intact(spark, sf):
    """The packet as it was built has nothing to complain about."""
    packet = _packet(spark, sf)
    wrong = ev.packet_violations(packet, at(_T), _LIMITS, _REQUEST).agg(F.sum("rows").alias("n"))
    violations = F.coalesce(F.col("n"), F.lit(0)).cast("bigint").alias("violations")
    return packet.sections.groupBy("section").agg(F.count(F.lit(1)).alias("entities")).crossJoin(wrong).select("section", "entities", violations)  # one row


@query(
    "C13",
    V.with_views(V.MARKET_BARS)
    + f"""SELECT entity, count(*) AS mismatches FROM (
  SELECT instrument_id AS entity, event_time, open, high, low, close, volume, available_at, ingested_at, data_version,
    count(*) FILTER (side='a') AS a, count(*) FILTER (side='b') AS b FROM (
    SELECT 'a' AS side, * FROM (SELECT * FROM market_bars WHERE {_KNOWN.format(t=_T)} AND data_version LIKE 'snapshot-v2:%' AND event_time + INTERVAL 1 DAY <= TIMESTAMP '{_T}'
     QUALIFY row_number() OVER (PARTITION BY instrument_id, event_time ORDER BY available_at DESC, ingested_at DESC, data_version DESC)=1)
    UNION ALL SELECT 'b', * FROM (SELECT * FROM market_bars WHERE available_at < TIMESTAMP '{_T}' AND data_version LIKE 'snapshot-v2:%' AND event_time + INTERVAL 1 DAY <= TIMESTAMP '{_T}'
     QUALIFY row_number() OVER (PARTITION BY instrument_id, event_time ORDER BY available_at DESC, ingested_at DESC, data_version DESC)=1))
  GROUP BY ALL) WHERE a<>b GROUP BY entity""",
)
def packet_verification(spark, sf):
    """Archived (local) records against a rebuild in the other mode: every differing record is found."""
    bars = views.market_bars(spark, sf)
    archived = ev.packet_records({"market": ev.market_section(bars, at(_T))})
    rebuilt = ev.packet_records({"market": ev.market_section(bars, at(_T), "reconstructed")})
    return ev.packet_mismatches(archived, rebuilt).groupBy("entity").agg(F.count(F.lit(1)).alias("mismatches"))


# ---- C: identity ------------------------------------------------------------

_RESOLVE = """resolved AS (SELECT a.instrument_id, coalesce(n,0) AS assertion_count, coalesce(g,0) AS group_count,
  CASE WHEN coalesce(n,0)=0 THEN 'MISSING' WHEN g>1 THEN 'AMBIGUOUS' WHEN n=1 THEN 'SINGLE_ASSERTION' ELSE 'EQUIVALENT_ASSERTIONS' END AS status,
  asset_class, src FROM (SELECT DISTINCT instrument_id FROM identities) a LEFT JOIN (
  SELECT instrument_id, count(*) AS n, count(DISTINCT source||'|'||symbol||'|'||asset_class||'|'||coalesce(primary_exchange,'~')) AS g,
    min(asset_class) AS asset_class, min(source) AS src FROM {src} GROUP BY 1) USING (instrument_id))"""


@query(
    "C15 C16",
    V.with_views(V.IDENTITIES, _IDENTITY, _RESOLVE.format(src="effective"))
    + "SELECT instrument_id, status, CAST(assertion_count AS BIGINT) AS assertion_count, CAST(group_count AS BIGINT) AS group_count FROM resolved",
)
def identity_resolution(spark, sf):
    ids = views.identities(spark, sf)
    rows = idn.require_assertions(ev.identity_section(ids, at(_ID_T)), at(_ID_T), record=("c_custkey",))
    return idn.resolve(rows, ids).drop("resolved")


@query(
    "C20 C17",
    V.with_views(
        V.IDENTITIES, _IDENTITY, _RESOLVE.format(src="effective"),
        "eff0 AS (SELECT * FROM identities WHERE available_at < TIMESTAMP '2000-09-01' AND ingested_at < TIMESTAMP '2000-09-01' "
        "AND valid_from <= TIMESTAMP '2000-09-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2000-09-01'))",
        _RESOLVE.format(src="eff0").replace("resolved AS", "catalogued AS"),
        "one AS (SELECT DISTINCT instrument_id, source, symbol, asset_class, primary_exchange FROM effective)",
        "one0 AS (SELECT DISTINCT instrument_id, source, symbol, asset_class, primary_exchange FROM eff0)",
    )
    + """SELECT r.instrument_id, r.status AS current_status, c.status AS catalog_status,
  CASE WHEN r.status NOT IN ('SINGLE_ASSERTION','EQUIVALENT_ASSERTIONS') THEN 'CURRENT_IDENTITY_UNRESOLVED'
    WHEN c.status NOT IN ('SINGLE_ASSERTION','EQUIVALENT_ASSERTIONS') THEN 'CATALOG_IDENTITY_UNRESOLVED'
    WHEN (SELECT (source,symbol,asset_class,coalesce(primary_exchange,'~')) FROM one WHERE one.instrument_id=r.instrument_id LIMIT 1)
      <> (SELECT (source,symbol,asset_class,coalesce(primary_exchange,'~')) FROM one0 WHERE one0.instrument_id=r.instrument_id LIMIT 1) THEN 'SOURCE_DESCRIPTION_MISMATCH'
    WHEN r.src='yahoo' AND r.asset_class='equity' THEN 'MATCHED_SOURCE_DESCRIPTION' ELSE 'UNSUPPORTED_SOURCE_OR_ASSET' END AS binding_status
FROM resolved r JOIN catalogued c USING (instrument_id)""",
)
def identity_binding(spark, sf):
    ids = views.identities(spark, sf)
    current = idn.resolve(ev.identity_section(ids, at(_ID_T)), ids)
    archived = idn.resolve(ev.identity_section(ids, at("2000-09-01")), ids)
    return idn.binding(current, archived, at("2000-09-01"), at(_ID_T))


@query(
    "C21",
    V.with_views(V.MARKET_BARS, V.MACRO)
    + f"""SELECT 'market' AS section, instrument_id AS entity, count(*) AS count, epoch_us(max(available_at)) AS latest_us, epoch_us(max(event_time)) AS event_us
  FROM (SELECT * FROM market_bars WHERE {_KNOWN.format(t=_T)} AND data_version LIKE 'snapshot-v2:%' AND event_time + INTERVAL 1 DAY <= TIMESTAMP '{_T}'
   QUALIFY row_number() OVER (PARTITION BY instrument_id, event_time ORDER BY available_at DESC, ingested_at DESC, data_version DESC)=1) GROUP BY 2
 UNION ALL SELECT 'macro', series_id, count(*), epoch_us(max(available_at)), epoch_us(max(observation_date)::TIMESTAMP) FROM (SELECT * FROM macro WHERE {_KNOWN.format(t=_T)}
   AND observation_date <= DATE '{_T[:10]}' AND vintage_date <= DATE '{_T[:10]}'
   QUALIFY row_number() OVER (PARTITION BY series_id, observation_date ORDER BY vintage_date DESC, available_at DESC, ingested_at DESC)=1) GROUP BY 2""",
)
def section_coverage(spark, sf):
    market = ev.source_coverage(ev.market_section(views.market_bars(spark, sf), at(_T)), "market")
    macro = ev.source_coverage(ev.macro_section(views.macro(spark, sf), at(_T)), "macro")
    return market.unionByName(macro).select(
        "section", "entity", "count", us("latest_available_at", "latest_us"), us("latest_event", "event_us")
    )


# ---- D: context features ----------------------------------------------------

_MK = f"""mk AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY event_time DESC) AS rn FROM (
  SELECT * FROM market_bars WHERE {_KNOWN.format(t=_T)} AND data_version LIKE 'snapshot-v2:%' AND event_time + INTERVAL 1 DAY <= TIMESTAMP '{_T}'
  QUALIFY row_number() OVER (PARTITION BY instrument_id, event_time ORDER BY available_at DESC, ingested_at DESC, data_version DESC)=1)),
mk2 AS (SELECT *, close/lead(close) OVER w - 1 AS ret, event_time::DATE - lead(event_time) OVER w::DATE AS gap FROM mk WHERE rn<=21
  WINDOW w AS (PARTITION BY instrument_id ORDER BY rn)),
feat AS (SELECT instrument_id, f.feature, f.n, f.unit, count(*) AS bars, max(CASE WHEN rn=1 THEN event_time END) AS latest,
  max(CASE WHEN rn<f.n THEN gap END) AS gap, max(CASE WHEN rn<=f.n THEN available_at END) AS latest_input,
  max(CASE WHEN rn=1 THEN close END) AS c1, max(CASE WHEN rn=f.n THEN close END) AS cn, max(CASE WHEN rn=1 THEN high END) AS h,
  max(CASE WHEN rn=1 THEN low END) AS l, max(CASE WHEN rn=1 THEN open END) AS o, max(CASE WHEN rn=1 THEN volume END) AS v,
  stddev_samp(ret) FILTER (rn<=20) AS vol, avg(volume) FILTER (rn<=20) AS mv
  FROM mk2, (VALUES ('market.return_1_observed_bar',2,'fraction'),('market.return_5_observed_bars',6,'fraction'),('market.return_20_observed_bars',21,'fraction'),
   ('market.volatility_20_observed_intervals',21,'fraction'),('market.range_fraction',1,'fraction'),('market.volume_to_mean_20_observed_bars',20,'ratio')) f(feature,n,unit)
  GROUP BY 1,2,3,4),
mfeat AS (SELECT instrument_id, feature, unit, n, bars, latest_input,
  CASE WHEN bars<n THEN 'INSUFFICIENT_HISTORY' WHEN DATE '{_T[:10]}'-latest::DATE>7 THEN 'STALE_MARKET' WHEN coalesce(gap,0)>7 THEN 'EXCESSIVE_MARKET_GAP'
   WHEN feature LIKE '%volume%' AND mv=0 THEN 'ZERO_DENOMINATOR' ELSE 'AVAILABLE' END AS status,
  CASE WHEN feature LIKE 'market.return%' THEN c1/cn-1 WHEN feature LIKE '%volatility%' THEN vol WHEN feature LIKE '%range%' THEN (h-l)/o ELSE v/nullif(mv,0) END AS val
  FROM feat)"""


@query(
    "D1 D2 D3 D4 D5 D6 D12 D15 D18",
    V.with_views(V.MARKET_BARS, _MK)
    + """SELECT instrument_id, feature, unit, status, CASE WHEN status='AVAILABLE' THEN round(val,6) END AS value, CAST(least(bars,n) AS BIGINT) AS records_used,
  epoch_us(latest_input) AS latest_us FROM mfeat""",
)
def market_context_features(spark, sf):
    bars = views.market_bars(spark, sf)
    out = ctx.market_features(ev.market_section(bars, at(_T)), bars, at(_T))
    return out.select(
        "instrument_id", "feature", "unit", "status", F.round("value", 6).alias("value"), "records_used",
        us("latest_input_available_at", "latest_us"),
    )


def _metadata(spark, sf, cutoff):
    """Series metadata observed with the last vintage known before the cutoff; one series is mislabelled."""
    seen = views.macro(spark, sf).filter(F.col("available_at") < at(cutoff)).groupBy("series_id").agg(
        F.max("available_at").alias("observed_at")
    )
    policy = ctx.macro_policy(spark).select("series_id", "units", "frequency", "seasonal_adjustment")
    record = seen.join(policy, "series_id")
    return record.withColumns(
        {
            "frequency": F.when(F.col("series_id") == "UNRATE", "Weekly").otherwise(F.col("frequency")),
            "available_at": F.col("observed_at"),
            "status": F.lit("AVAILABLE"),
            "generated_at": F.col("observed_at"),
        }
    )


_POLICY = "policy AS (SELECT * FROM (VALUES ('DFF','Percent',7,7),('DGS10','Percent',7,7),('CPIAUCSL','Index 1982-1984=100',62,100),('UNRATE','Percent',62,100)) p(series_id,unit,age,oage))"
_LEVELS = f"""obs AS (SELECT * FROM macro WHERE {_KNOWN.format(t=_MACRO_T)} AND observation_date <= DATE '{_MACRO_T[:10]}' AND vintage_date <= DATE '{_MACRO_T[:10]}'
  QUALIFY row_number() OVER (PARTITION BY series_id, observation_date ORDER BY vintage_date DESC, available_at DESC, ingested_at DESC)=1),
lastobs AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY observation_date DESC)=1),
meta AS (SELECT series_id, max(available_at) AS observed_at FROM macro WHERE available_at < TIMESTAMP '{_MACRO_T}' GROUP BY 1),
levels AS (SELECT p.series_id, 'macro.'||p.series_id||'.level' AS feature, unit,
  CASE WHEN m.series_id IS NULL THEN 'MISSING_METADATA' WHEN p.series_id='UNRATE' THEN 'DEFINITION_MISMATCH' WHEN TIMESTAMP '{_MACRO_T}'-observed_at>INTERVAL 30 DAY THEN 'STALE_METADATA'
   WHEN o.series_id IS NULL THEN 'MISSING_OBSERVATION' WHEN o.value IS NULL THEN 'MISSING_VALUE' WHEN TIMESTAMP '{_MACRO_T}'-o.available_at>to_days(age) THEN 'STALE_OBSERVATION'
   WHEN DATE '{_MACRO_T[:10]}'-observation_date>oage THEN 'STALE_OBSERVATION_DATE' ELSE 'AVAILABLE' END AS status,
  o.value AS v, observation_date, greatest(o.available_at, observed_at) AS latest FROM policy p LEFT JOIN lastobs o USING (series_id) LEFT JOIN meta m USING (series_id))"""


@query(
    "D7 D8 D9 D10 D11 D13 D18 C18",
    V.with_views(V.MACRO, _POLICY, _LEVELS)
    + """SELECT feature, unit, status, CASE WHEN status='AVAILABLE' THEN v END AS value, epoch_us(latest) AS latest_us FROM levels UNION ALL
SELECT 'macro.DGS10_minus_DFF.spread_pp', 'percentage_points', CASE WHEN a.status<>'AVAILABLE' OR b.status<>'AVAILABLE' THEN 'INPUT_BLOCKED'
  WHEN a.observation_date<>b.observation_date THEN 'OBSERVATION_DATE_MISMATCH' ELSE 'AVAILABLE' END,
  CASE WHEN a.status='AVAILABLE' AND b.status='AVAILABLE' AND a.observation_date=b.observation_date THEN round(a.v-b.v,4) END, epoch_us(greatest(a.latest,b.latest))
FROM levels a, levels b WHERE a.series_id='DGS10' AND b.series_id='DFF'""",
)
def macro_context_features(spark, sf):
    metadata = ctx.metadata_as_of(_metadata(spark, sf, _MACRO_T), at(_MACRO_T)).filter("eligibility = 'AVAILABLE'")
    section = ev.macro_section(views.macro(spark, sf), at(_MACRO_T), list(ctx.MACRO_POLICY))
    out = ctx.macro_features(section, metadata, at(_MACRO_T))
    spread = F.col("feature") == ctx.SPREAD
    return out.select(
        "feature", "unit", "status", F.when(spread, F.round("value", 4)).otherwise(F.col("value")).alias("value"),
        us("latest_input_available_at", "latest_us"),
    )


@query(
    "C19 C18",
    V.with_views(V.MACRO)
    + f"""SELECT count(*) AS series, count(*) FILTER (a < TIMESTAMP '{_CATALOG_T}') AS available,
  CASE WHEN bool_and(a < TIMESTAMP '{_CATALOG_T}') THEN 'COMPLETE' ELSE 'PARTIAL' END AS status FROM (
  SELECT series_id, max(available_at) AS a FROM macro WHERE available_at < TIMESTAMP '{_T}' AND series_id IN ('DFF','DGS10','CPIAUCSL','UNRATE') GROUP BY 1)""",
)
def catalog_status(spark, sf):
    eligible = ctx.metadata_as_of(_metadata(spark, sf, _T), at(_CATALOG_T))
    return ctx.catalog_summary(eligible.withColumn("status", F.col("eligibility")))


@query(
    "D16 D17 D14",
    V.with_views(V.MARKET_BARS, _MK, V.MACRO, _POLICY, _LEVELS.replace(_MACRO_T, _T).replace(_MACRO_T[:10], _T[:10]),
        "bound AS (SELECT DISTINCT instrument_id, CAST(replace(instrument_id,'YF:S','') AS INTEGER)%2=0 AS ok FROM market_bars)",
        "lv AS (SELECT status FROM levels UNION ALL SELECT CASE WHEN a.status='AVAILABLE' AND b.status='AVAILABLE' AND a.observation_date=b.observation_date THEN 'AVAILABLE' ELSE 'INPUT_BLOCKED' END FROM levels a, levels b WHERE a.series_id='DGS10' AND b.series_id='DFF')")
    + """SELECT b.instrument_id, CAST(11 AS BIGINT) AS feature_count,
  (SELECT count(*) FROM mfeat m WHERE m.instrument_id=b.instrument_id AND b.ok AND m.status='AVAILABLE') + (SELECT count(*) FROM lv WHERE status='AVAILABLE') AS available_count FROM bound b""",
)
def context_packet_status(spark, sf):
    """Packets with market slots masked where no identity binds the instrument."""
    bars = views.market_bars(spark, sf)
    market = ctx.market_features(ev.market_section(bars, at(_T)), bars, at(_T))
    metadata = _metadata(spark, sf, _T).filter("status = 'AVAILABLE'")
    macro = ctx.macro_features(
        ev.macro_section(views.macro(spark, sf), at(_T), list(ctx.MACRO_POLICY)), metadata, at(_T)
    )
    number = F.regexp_extract("instrument_id", r"(\d+)$", 1).cast("int")
    bindings = bars.select("instrument_id").distinct().withColumn(
        "binding_status",
        F.when(number % 2 == 0, "MATCHED_SOURCE_DESCRIPTION").otherwise("CURRENT_IDENTITY_UNRESOLVED"),
    )
    packet = idn.mask_market(ctx.feature_packet(market, macro), bindings)
    return ctx.packet_status(packet).select("instrument_id", "feature_count", "available_count")


@query(
    "D15 C11",
    V.with_views(V.MARKET_BARS, _MK)
    + "SELECT instrument_id, count(*) AS evidence_ids, true AS sorted, epoch_us(max(available_at)) AS latest_us FROM mk WHERE rn<=21 GROUP BY 1",
)
def context_provenance(spark, sf):
    section = ev.with_evidence_id(ev.market_section(views.market_bars(spark, sf), at(_T)), "market")
    out = ctx.provenance(section, 21)
    ids = F.col("source_evidence_ids")
    return out.select(
        "instrument_id", F.size(ids).cast("bigint").alias("evidence_ids"), (F.array_sort(ids) == ids).alias("sorted"),
        us("latest_input_available_at", "latest_us"),
    )


_DEFINED = "VALUES " + ", ".join(
    f"('{name}','{units}','{'Weekly' if name == 'UNRATE' else frequency}','{adjusted}')" for name, (units, frequency, adjusted, *_) in ctx.MACRO_POLICY.items()
)
_REASON_ROWS = "VALUES " + ", ".join("('{}','{}')".format(k, v.replace("'", "''")) for k, v in ctx.REASONS.items() if v)
_SLOTS = V.with_views(
    V.MARKET_BARS, _MK, V.MACRO, _POLICY, _LEVELS.replace(_MACRO_T, _T).replace(_MACRO_T[:10], _T[:10]),
    f"mid AS (SELECT instrument_id, rn, {_MARKET_ID} AS id FROM mk WHERE rn<=21)",
    """mslots AS (SELECT m.instrument_id, m.feature, m.unit, m.status, m.latest_input AS latest, list_sort(list(id) FILTER (rn<=m.n)) AS ids, []::VARCHAR[] AS hashes
  FROM mfeat m JOIN mid USING (instrument_id) GROUP BY ALL)""",
    f"oid AS (SELECT series_id, {_MACRO_ID} AS id FROM lastobs)",
    f"""mhash AS (SELECT series_id, sha256(to_json({{'series_id': series_id, 'units': units, 'frequency': frequency, 'seasonal_adjustment': adjusted, 'observed_at': {_ISO.format('observed_at')}}})) AS h
  FROM meta JOIN ({_DEFINED}) d(series_id, units, frequency, adjusted) USING (series_id))""",
    "lslots AS (SELECT l.*, list_filter([id], lambda x: x IS NOT NULL) AS ids, list_filter([h], lambda x: x IS NOT NULL) AS hashes FROM levels l LEFT JOIN oid USING (series_id) LEFT JOIN mhash USING (series_id))",
    """shared AS (SELECT feature, unit, status, latest, ids, hashes FROM lslots UNION ALL SELECT 'macro.DGS10_minus_DFF.spread_pp', 'percentage_points',
  CASE WHEN a.status<>'AVAILABLE' OR b.status<>'AVAILABLE' THEN 'INPUT_BLOCKED' WHEN a.observation_date<>b.observation_date THEN 'OBSERVATION_DATE_MISMATCH' ELSE 'AVAILABLE' END,
  greatest(a.latest,b.latest), list_sort(list_distinct(list_concat(a.ids,b.ids))), list_sort(list_distinct(list_concat(a.hashes,b.hashes))) FROM lslots a, lslots b WHERE a.series_id='DGS10' AND b.series_id='DFF')""",
    f"""slots AS (SELECT s.*, reason FROM (SELECT instrument_id, feature, unit, status, latest, ids, hashes FROM mslots UNION ALL SELECT instrument_id, s.* FROM (SELECT DISTINCT instrument_id FROM mslots), shared s) s
  LEFT JOIN ({_REASON_ROWS}) r(status, reason) USING (status))""",
)


def _traced_packet(spark, sf):
    """Eleven slots per instrument with the evidence and metadata each was computed from."""
    bars = views.market_bars(spark, sf)
    market = ctx.market_features(ev.with_evidence_id(ev.market_section(bars, at(_T)), "market"), bars, at(_T))
    section = ev.with_evidence_id(ev.macro_section(views.macro(spark, sf), at(_T), list(ctx.MACRO_POLICY)), "macro")
    return ctx.feature_packet(market, ctx.macro_features(section, _metadata(spark, sf, _T).filter("status = 'AVAILABLE'"), at(_T)))


@query(
    "D15 C11",
    _SLOTS + "SELECT instrument_id, feature, status, len(ids)::INTEGER AS evidence_ids, sha256(array_to_string(ids,',')) AS ids_digest, array_to_string(hashes,',') AS metadata_hashes, epoch_us(latest) AS latest_us FROM slots",
)
def context_slot_lineage(spark, sf):
    """What each of the eleven slots was computed from, macro slots and the spread included."""
    return _traced_packet(spark, sf).select(
        "instrument_id", "feature", "status", F.size("source_evidence_ids").alias("evidence_ids"), F.sha2(F.array_join("source_evidence_ids", ","), 256).alias("ids_digest"),
        F.array_join("metadata_record_hashes", ",").alias("metadata_hashes"), us("latest_input_available_at", "latest_us"),
    )


@query(
    "D17 D15",
    _SLOTS
    + f"""SELECT instrument_id, feature_count, available_count, CASE WHEN feature_count=available_count THEN 'COMPLETE' ELSE 'PARTIAL' END AS status, lineage_hash FROM
  (SELECT instrument_id, count(*) AS feature_count, count(*) FILTER (status='AVAILABLE') AS available_count FROM slots GROUP BY 1) JOIN ("""
    + _digest_sql(
        "SELECT instrument_id, sha256(to_json({'feature': feature, 'status': status, 'unit': unit, 'reason': reason, 'source_evidence_ids': ids, 'metadata_record_hashes': hashes, 'latest_input_available_at': "
        + _ISO.format("latest") + "})) AS h FROM slots",
        "instrument_id", "lineage_hash",
    )
    + ") USING (instrument_id)",
)
def context_packet_hashes(spark, sf):
    """Status of every packet and the digest over its slots' statuses, reasons and inputs."""
    return ctx.packet_status(_traced_packet(spark, sf)).drop("feature_hash")
