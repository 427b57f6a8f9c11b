"""Research tables derived from the driver's parquet tables.

The driver has no bars, filings or quotes, so each view maps a driver table onto
a research table by arithmetic on its own columns. Every view is one projection
or one aggregation over the whole table.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import SECOND_NS, utc_midnight

# The symbols standing in for the six (returnflag, linestatus) pairs.
SYMBOL_OF_FLAGS = {
    "AF": "SPY",
    "AO": "QQQ",
    "NF": "IWM",
    "NO": "^VIX",
    "RF": "^TNX",
    "RO": "BTC-USD",
}
NEWS_HOURS = 20_000  # documents are spread over so many hours, whatever their number
SERIES_OF_PRIORITY = {
    "1-URGENT": "DFF",
    "2-HIGH": "DGS10",
    "3-MEDIUM": "CPIAUCSL",
    "4-NOT SPECIFIED": "UNRATE",
    "5-LOW": "GDP",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Keep a small derived table (one row per key and day) that a plan reads several times.

    Without it every branch would scan the source again, because each prunes other
    columns and no exchange can be shared. Lost blocks are recomputed from lineage.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def _mapped(column, mapping: dict[str, str]):
    result = None
    for key, value in mapping.items():
        result = F.when(column == key, value) if result is None else result.when(column == key, value)
    return result


def symbol_column():
    return _mapped(F.concat("l_returnflag", "l_linestatus"), SYMBOL_OF_FLAGS)


def trade_order():
    """Order of line items within a day; order and line alone are not unique, all four keys are."""
    return F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (symbol, d, open, high, low, close, volume).

    Ordering every line item by four columns would sort the table before its first aggregate. The first and last
    order of a day are plain minima, so only the line items of those two orders are ordered by the full key.
    """
    # around 1,050: daily returns of a few per cent, as a traded instrument has, and none near -100 %
    price = (F.lit(1000) + F.col("l_extendedprice") / F.col("l_quantity") / 20).alias("price")
    items = table(spark, sf_dir, "lineitem").select(
        symbol_column().alias("symbol"), F.to_date("l_shipdate").alias("d"), price, "l_quantity", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"
    )
    days = items.groupBy("symbol", "d").agg(
        F.min("l_orderkey").alias("_first"),
        F.max("l_orderkey").alias("_last"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.sum("l_quantity").alias("volume"),
    )
    edges = items.join(days.select("symbol", "d", "_first", "_last"), ["symbol", "d"])
    edges = edges.filter((F.col("l_orderkey") == F.col("_first")) | (F.col("l_orderkey") == F.col("_last")))
    ends = edges.groupBy("symbol", "d").agg(
        F.min_by("price", trade_order()).alias("open"), F.max_by("price", trade_order()).alias("close")
    )
    return days.join(ends, ["symbol", "d"]).select("symbol", "d", "open", "high", "low", "close", "volume")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange calendar: weekdays seen in the data, New York hours, one early close a year."""
    days = (
        table(spark, sf_dir, "lineitem")
        .select(F.to_date("l_shipdate").alias("session_date"))
        .distinct()
        .filter(F.dayofweek("session_date").between(2, 6))
    )
    early = (F.month("session_date") == 11) & (F.dayofmonth("session_date") == 27)
    local = lambda minutes: F.to_utc_timestamp(
        F.timestamp_add("MINUTE", minutes, F.col("session_date").cast("timestamp")), "America/New_York"
    )
    return days.select(
        F.lit("XNYS").alias("calendar"),
        "session_date",
        local(F.lit(570)).alias("open_at"),
        local(F.when(early, 780).otherwise(960)).alias("close_at"),
    )


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned daily bars: every line item is one observed version of a (supplier group, day) bar."""
    items = table(spark, sf_dir, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    day = F.to_date("l_shipdate")
    available = F.timestamp_add(
        "HOUR", (F.col("l_linenumber") * 24 + F.col("l_suppkey") % 24).cast("int"), utc_midnight(day, 1)
    )
    return items.select(
        F.concat(F.lit("YF:S"), (F.col("l_suppkey") % 20).cast("string")).alias("instrument_id"),
        utc_midnight(day).alias("event_time"),
        F.lit("1d").alias("interval"),
        price.alias("open"),
        (price + 1).alias("high"),
        (price - 1).alias("low"),
        (price + F.lit(0.5)).alias("close"),
        "l_quantity",
        available.alias("available_at"),
        F.timestamp_add("HOUR", (F.col("l_partkey") % 48).cast("int"), available).alias("ingested_at"),
        F.lit("yahoo").alias("source"),
        F.when(F.col("l_partkey") % 11 == 0, F.lit("adjusted-v1"))
        .otherwise(
            F.concat(
                F.lit("snapshot-v2:"),
                F.concat_ws(
                    "-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")]
                ),
            )
        )
        .alias("data_version"),
    ).withColumnRenamed("l_quantity", "volume")


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filing facts: one per line item, several filings per (entity, metric, period)."""
    items = table(spark, sf_dir, "lineitem")
    filed_day = F.to_date("l_shipdate")
    end = F.date_trunc("quarter", F.date_sub(filed_day, 1)).cast("date")
    filed = F.to_utc_timestamp(F.date_add(filed_day, 1).cast("timestamp"), "America/New_York")
    quarterly = F.col("l_linenumber") % 2 == 0
    # a quarter starts 90 days before its end, a year-to-date fact 180 days; some instants have no start
    start = (
        F.when(F.col("l_linenumber") == 7, F.lit(None).cast("date"))
        .when(quarterly, F.date_sub(end, 90))
        .otherwise(F.date_sub(end, 180))
    )
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])
    return items.select(
        F.concat(F.lit("R"), key).alias("record_id"),
        F.concat(F.lit("US:C"), (F.col("l_suppkey") % 40).cast("string")).alias("instrument_id"),
        F.when(F.col("l_returnflag") == "A", "Revenues").when(F.col("l_returnflag") == "N", "NetIncomeLoss")
        .otherwise("Assets").alias("metric"),
        start.alias("period_start"),
        end.alias("period_end"),
        F.when(F.col("l_partkey") % 50 != 0, F.col("l_extendedprice")).alias("value"),
        F.when(F.col("l_linestatus") == "O", "EUR").otherwise("USD").alias("unit"),
        F.when(F.col("l_linenumber") == 3, "10-Q/A").when(quarterly, "10-Q").otherwise("10-K").alias("form"),
        key.alias("accession_number"),
        filed.alias("filed_at"),
        filed.alias("available_at"),
        F.timestamp_add("HOUR", (F.col("l_partkey") % 72).cast("int"), filed).alias("ingested_at"),
        F.lit("sec-companyfacts").alias("source"),
        F.year(end).alias("fiscal_year"),
        F.concat(F.lit("Q"), F.quarter(end).cast("string")).alias("fiscal_period"),
        F.lit(None).cast("string").alias("frame"),
        F.lit("filing_date_end_america_new_york").alias("availability_basis"),
    )


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro vintages from orders; one value per primary key after one aggregation."""
    orders = table(spark, sf_dir, "orders")
    observed = F.to_date("o_orderdate")
    vintage = F.date_add(observed, (F.col("o_custkey") % 40).cast("int"))
    rows = orders.select(
        _mapped(F.col("o_orderpriority"), SERIES_OF_PRIORITY).alias("series_id"),
        observed.alias("observation_date"),
        vintage.alias("vintage_date"),
        F.when(F.col("o_custkey") % 29 != 0, F.col("o_totalprice")).alias("value"),
    )
    merged = rows.groupBy("series_id", "observation_date", "vintage_date").agg(F.max("value").alias("value"))
    available = F.to_utc_timestamp(F.date_add("vintage_date", 1).cast("timestamp"), "America/Chicago")
    return merged.select(
        "series_id",
        "observation_date",
        "value",
        "vintage_date",
        available.alias("available_at"),
        F.timestamp_add("HOUR", F.dayofmonth("vintage_date") % 5, available).alias("ingested_at"),
        F.lit("fred-alfred").alias("source"),
        F.date_add("vintage_date", 60).alias("realtime_end"),
        F.lit("vintage_date_end_america_chicago").alias("availability_basis"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News metadata from documents; the hash covers the whole text."""
    docs = table(spark, sf_dir, "documents")
    published = F.timestamp_add("HOUR", (F.col("doc_id") % NEWS_HOURS).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    first_seen = F.timestamp_add("MINUTE", (F.col("doc_id") % 4000).cast("int"), published)
    return docs.select(
        F.concat(F.lit("N"), F.col("doc_id").cast("string")).alias("event_id"),
        published.alias("published_at"),
        first_seen.alias("first_seen_at"),
        first_seen.alias("available_at"),
        F.timestamp_add("HOUR", (F.col("doc_id") % 13).cast("int"), first_seen).alias("ingested_at"),
        F.concat(F.lit("wire-"), F.col("lang")).alias("source"),
        F.sha2("text", 256).alias("title_hash"),
        F.lit(None).cast("string").alias("raw_uri"),
        F.concat(F.lit('["'), F.upper("lang"), F.lit('","'), F.col("source"), F.lit('"]')).alias("entity_ids"),
        F.concat(F.lit('{"historical_backfill":'), (F.col("doc_id") % 4000 > 1440).cast("string"), F.lit("}")).alias(
            "quality_flags"
        ),
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity assertions from customers, several per instrument, some conflicting."""
    customers = table(spark, sf_dir, "customer")
    start = F.timestamp_add("DAY", (F.col("c_custkey") % 900).cast("int"), F.lit("2000-01-01").cast("timestamp"))
    return customers.select(
        F.concat(F.lit("YF:I"), (F.col("c_custkey") % 400).cast("string")).alias("instrument_id"),
        F.concat(F.lit("I"), (F.col("c_custkey") % 400).cast("string")).alias("symbol"),
        F.when(F.col("c_nationkey") % 5 == 0, "crypto").otherwise("equity").alias("asset_class"),
        F.when(F.col("c_nationkey") % 4 != 0, F.lit("XNYS")).alias("primary_exchange"),
        start.alias("valid_from"),
        F.when(F.col("c_custkey") % 3 == 0, F.timestamp_add("DAY", F.lit(700), start)).alias("valid_to"),
        F.timestamp_add("HOUR", F.lit(6), start).alias("available_at"),
        F.timestamp_add("HOUR", (6 + F.col("c_custkey") % 30).cast("int"), start).alias("ingested_at"),
        F.when(F.col("c_custkey") % 7 == 0, "sec").otherwise("yahoo").alias("source"),
        F.col("c_custkey"),
    )


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from events, nanosecond instants; some crossed, locked, of zero size or badly flagged."""
    events = table(spark, sf_dir, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.col("event_id")
    return events.select(
        F.col("event_type").alias("symbol"),
        k.alias("event_id"),
        (micros * 1000 + k % 1000).alias("event_ns"),
        F.col("value").alias("bid"),
        F.when(k % 97 == 0, F.col("value") * 0.99)
        .when(k % 61 == 0, F.col("value"))
        .otherwise(F.col("value") * (1 + (1 + k % 7) * 0.0001))
        .alias("ask"),
        F.when(k % 89 == 0, 0.0).otherwise((1 + k % 9).cast("double")).alias("bid_size"),
        (1 + k % 5).cast("double").alias("ask_size"),
        F.when(k % 53 == 0, F.array(F.lit("R"), F.lit("X"))).otherwise(F.array(F.lit("R"))).alias("conditions"),
        F.when(k % 71 == 0, "Z").otherwise(F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (1 + k % 3).cast("int"))).alias("tape"),
    )


def minute_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes cut to the minute, so several updates share one instant."""
    return quotes(spark, sf_dir).withColumn("event_ns", F.expr(f"event_ns div {60 * SECOND_NS} * {60 * SECOND_NS}"))


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fills from line items in trade order, decimal money."""
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        symbol_column().alias("symbol"),
        F.when(F.col("l_linenumber") % 2 == 0, "SELL").otherwise("BUY").alias("side"),
        F.col("l_quantity").cast("decimal(18,8)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,8)").alias("price"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(100).cast("decimal(6,0)").alias("multiplier"),
        F.to_date("l_shipdate").alias("day"),
        "l_orderkey",
        "l_partkey",
        "l_suppkey",
        "l_linenumber",
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample style rows: probability and return from integer arithmetic per (symbol, day)."""
    rows = (
        table(spark, sf_dir, "lineitem")
        .groupBy(symbol_column().alias("symbol"), F.to_date("l_shipdate").alias("d"))
        .agg(F.sum("l_partkey").alias("kp"), F.sum(F.col("l_suppkey") * 7 + F.col("l_orderkey")).alias("kr"))
    )
    ret = (F.col("kr") % 401 - 199) / F.lit(10000.0)
    return rows.select(
        "symbol",
        "d",
        ((F.col("kp") % 1000) / F.lit(1000.0)).alias("probability"),
        ret.alias("target_return"),
        (ret > 0).cast("int").alias("target"),
    )


# ---- market data ------------------------------------------------------------

# Symbols standing in for the five event types, and the block of a fetch window.
SYMBOL_OF_EVENT = {"view": "SPY", "click": "JPM", "error": "XOM", "purchase": "WMT", "signup": "BTC/USD"}
BLOCK_NS = 6 * 3600 * SECOND_NS
HALF_BLOCK_NS = BLOCK_NS // 2


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their instant and window block; every tenth one arrives twice."""
    events = table(spark, sf_dir, "events")
    k = F.col("event_id")
    rows = events.select(
        _mapped(F.col("event_type"), SYMBOL_OF_EVENT).alias("symbol"),
        k.alias("event_id"),
        (F.unix_micros(F.col("ts").cast("timestamp")) * 1000 + k % 1000).alias("ns"),
        "value",
    ).withColumn("w", F.expr(f"ns div {BLOCK_NS}"))
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(k % 10 == 0, 2).otherwise(1)))).drop("_copy")


def _iso(ns, naive):
    micros = F.expr(f"{ns} div 1000")
    text = F.concat(
        F.date_format(F.timestamp_micros(micros), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.lpad((F.col(ns) % 1000).cast("string"), 3, "0"),
    )
    return F.when(naive, text).otherwise(F.concat(text, F.lit("Z")))


def _pages(rows: DataFrame, record) -> DataFrame:
    """One landed page per record: symbol, block and JSON payload."""
    return rows.select(
        "symbol", "w",
        F.to_json(F.struct(F.col("symbol"), F.array(record).alias("records"))).alias("payload"),
    )


def _quote_fields(k, v) -> dict:
    """Raw quote fields per event: some crossed, locked, of zero size or badly flagged."""
    tapes = F.array(F.lit("A"), F.lit("B"), F.lit("C"))
    return {
        "bp": v,
        "ap": F.when(k % 97 == 0, v * 0.99).when(k % 61 == 0, v).otherwise(v * (1 + (1 + k % 7) * 0.0001)),
        "bs": F.when(k % 89 == 0, 0).otherwise(1 + k % 9),
        "as": 1 + k % 5,
        "bx": F.lit("V"),
        "ax": F.lit("P"),
        "c": F.when(k % 53 == 0, F.array(F.lit("R"), F.lit("X"))).otherwise(F.array(F.lit("R"))),
        "z": F.when(k % 71 == 0, "Z").otherwise(F.element_at(tapes, (1 + k % 3).cast("int"))),
    }


def _cut_to_minute(rows: DataFrame) -> DataFrame:
    return rows.withColumn("ns", F.expr(f"ns div {60 * SECOND_NS} * {60 * SECOND_NS}"))


def _other_symbol(k):
    """A few records name another symbol in their short field, beside the right one in the long field."""
    return F.when(k % 307 == 0, "OTHER")


def _unzoned(k):
    """Events whose landed time lacks a zone."""
    return k % 211 == 0


def quote_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quote fetches as landed JSON pages."""
    rows, k = _cut_to_minute(_event_rows(spark, sf_dir)), F.col("event_id")
    fields = _quote_fields(k, F.col("value"))
    symbols = [F.col("symbol").alias("symbol"), _other_symbol(k).alias("S")]
    return _pages(rows, F.struct(_iso("ns", _unzoned(k)).alias("t"), *[c.alias(n) for n, c in fields.items()], *symbols))


def quote_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same quotes as a typed table, as stored after parsing."""
    rows, k = _cut_to_minute(_event_rows(spark, sf_dir)), F.col("event_id")
    f = _quote_fields(k, F.col("value"))
    typed = rows.select(
        "symbol", "w", F.when(~_unzoned(k), F.col("ns")).alias("event_ns"), f["bp"].alias("bid"), f["ap"].alias("ask"),
        f["bs"].cast("double").alias("bid_size"), f["as"].cast("double").alias("ask_size"), f["bx"].alias("bid_exchange"),
        f["ax"].alias("ask_exchange"), f["c"].alias("conditions"), f["z"].alias("tape"),
        F.coalesce(_other_symbol(k), F.col("symbol")).alias("record_symbol"),
    )
    fields = ["event_ns", "bid", "ask", "bid_size", "ask_size", "bid_exchange", "ask_exchange", "conditions", "tape"]
    return typed.withColumn("identity", F.sha2(F.to_json(F.struct(*fields)), 256))


def _bar_fields(k, v) -> dict:
    """Raw minute-bar fields per event: some outside their bounds, with zero volume or broken counts."""
    return {
        "o": v,
        "h": F.when(k % 41 == 0, v * 0.5).otherwise(v * 1.01),
        "l": v * 0.99,
        "c": v,
        "v": k % 7,
        "n": F.when(~_broken_count(k), F.when(k % 59 == 0, (k % 5) + 0.5).otherwise((k % 5).cast("double"))),
        "vw": F.when(~_broken_average(k), v),
    }


def _broken_count(k):
    """Records whose trade count is a text."""
    return k % 67 == 0


def _broken_average(k):
    """Records whose average price is a boolean."""
    return k % 73 == 0


def _bar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = _event_rows(spark, sf_dir), F.col("event_id")
    minute = F.expr(f"ns div {60 * SECOND_NS} * {60 * SECOND_NS}")
    return rows.withColumn("ns", F.when(k % 83 == 0, F.col("ns")).otherwise(minute))


def bar_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute-bar fetches as landed JSON pages: one raw bar per event."""
    k = F.col("event_id")
    fields = _bar_fields(k, F.col("value"))
    fields["n"] = F.parse_json(F.when(_broken_count(k), F.lit('"x"')).otherwise(fields["n"].cast("string")))
    fields["vw"] = F.parse_json(F.when(_broken_average(k), F.lit("true")).otherwise(fields["vw"].cast("string")))
    return _pages(
        _bar_rows(spark, sf_dir), F.struct(_iso("ns", _unzoned(k)).alias("t"), *[c.alias(n) for n, c in fields.items()])
    )


def bar_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bars as a typed table, as stored after parsing."""
    k = F.col("event_id")
    fields = _bar_fields(k, F.col("value"))
    return _bar_rows(spark, sf_dir).select(
        "symbol", "w", F.when(~_unzoned(k), F.col("ns")).alias("event_ns"),
        *[c.cast("double").alias(n) for n, c in fields.items()],
        _broken_count(k).alias("n_not_a_number"), _broken_average(k).alias("vw_not_a_number"),
    )


def quote_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned fetch windows: every symbol and six-hour block between the first and last event."""
    rows = _event_rows(spark, sf_dir)
    span = rows.agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    symbols = rows.select("symbol").distinct()
    plan = symbols.crossJoin(F.broadcast(span)).select("symbol", F.explode(F.sequence("lo", "hi")).alias("w"))  # one row
    w = F.col("w")
    stamped = plan.withColumns(
        {
            "start_ns": w * F.lit(BLOCK_NS),
            "target_ns": w * F.lit(BLOCK_NS) + F.lit(HALF_BLOCK_NS),
            "end_ns": (w + 1) * F.lit(BLOCK_NS),
        }
    )
    return stamped.withColumns(
        {
            "window_name": F.element_at(
                F.array(F.lit("night"), F.lit("opening"), F.lit("midday"), F.lit("closing")), (1 + w % 4).cast("int")
            ),
            "session_date": F.to_date(F.timestamp_micros(F.expr("start_ns div 1000"))),
            "kind": F.lit("quotes"),
            "declared_symbol": F.when(w % 17 == 0, "ZZZ").otherwise(F.col("symbol")),
            "feed": F.when(F.col("symbol") == "BTC/USD", "crypto_us").when(w % 9 == 0, "iex").otherwise("sip"),
            "complete": w % 11 != 0,
            "pages": 1 + w % 4,
            "observed_ns": F.when(w % 13 == 0, F.col("end_ns") - 1).otherwise(F.col("end_ns") + SECOND_NS),
            "source_sha256": F.sha2(F.concat_ws("|", "symbol", w.cast("string")), 256),
        }
    )


def bar_envelopes(spans: DataFrame) -> DataFrame:
    """One bar fetch per (symbol, day) session: some for another symbol, observed early, cut off, or on a second feed."""
    day, symbol = F.col("day"), F.col("symbol")
    return spans.select(
        "symbol", "day", "start_ns", "end_ns", F.col("start_ns").alias("session_start_ns"), F.col("end_ns").alias("session_end_ns"),
        F.lit("bars").alias("kind"), F.when(day % 17 == 0, "ZZZ").otherwise(symbol).alias("declared_symbol"),
        F.when(symbol == "BTC/USD", "crypto_us").when((symbol == "XOM") & (day % 2 == 0), "iex").otherwise("sip").alias("feed"),
        F.when(day % 13 == 0, F.col("end_ns") - 1).otherwise(F.col("end_ns") + SECOND_NS).alias("observed_ns"), (day % 11 != 0).alias("complete"),
    )
