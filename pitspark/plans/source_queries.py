"""Registered queries: parsing landed documents, files, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.times import after_local_date, canonical_utc
from ..operators.features import FEATURE_COLUMNS  # noqa: F401
from ..session import checkpoint_root
from ..sources import bars as src_bars
from ..sources import filings, macro, news, sinks
from . import oracle_views as V
from . import views
from .registry import query


def scratch(spark, name: str) -> str:
    """A new folder below the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def day(name):
    return F.col(name).cast("string").alias(name)


# ---- filings ----------------------------------------------------------------


def _fact_documents(spark, sf):
    """Company-facts documents: one per line item with an original, a copy with a frame and an unsupported form."""
    items = views.table(spark, sf, "lineitem")
    filed = F.to_date("l_shipdate")
    end = F.date_sub(filed, (F.col("l_linenumber") * 10).cast("int"))
    key = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")])

    def observation(form, frame):
        return F.struct(
            F.when(F.col("l_linenumber") != 7, F.date_sub(end, 90)).cast("string").alias("start"), end.cast("string").alias("end"),
            F.col("l_extendedprice").alias("val"), key.alias("accn"), F.year(end).alias("fy"), F.lit("Q1").alias("fp"),
            form.alias("form"), filed.cast("string").alias("filed"), frame.alias("frame"),
        )

    form = F.when(F.col("l_linenumber") == 3, "10-Q/A").otherwise("10-Q")
    none = F.lit(None).cast("string")
    listed = F.array(observation(form, none), observation(form, F.lit("CY")), observation(F.lit("8-K"), none))
    unit = F.when(F.col("l_linestatus") == "O", "EUR").otherwise("USD")
    concept = F.when(F.col("l_returnflag") == "A", "Revenues").otherwise("Assets")
    facts = F.struct(F.create_map(concept, F.struct(F.create_map(unit, listed).alias("units"))).alias("us-gaap"))
    return items.select(
        F.concat(F.lit("c"), (F.col("l_suppkey") % 40).cast("string")).alias("ticker"),
        F.to_json(F.struct(facts.alias("facts"))).alias("payload"),
    )


_FACT_SQL = f"""facts AS (SELECT 'US:C'||(l_suppkey%40) AS instrument_id, CASE WHEN l_returnflag='A' THEN 'Revenues' ELSE 'Assets' END AS metric,
  CASE WHEN l_linestatus='O' THEN 'EUR' ELSE 'USD' END AS unit, CASE WHEN l_linenumber=3 THEN '10-Q/A' ELSE '10-Q' END AS form,
  l_shipdate::DATE - CAST(l_linenumber*10 AS INTEGER) AS period_end, CASE WHEN l_linenumber<>7 THEN l_shipdate::DATE - CAST(l_linenumber*10 AS INTEGER) - 90 END AS period_start,
  l_extendedprice AS value, {V.KEY} AS accession_number, {V.NY.format("(l_shipdate::DATE + 1)::TIMESTAMP")} AS available_at FROM lineitem)"""


@query(
    "A8 A15",
    V.with_views(_FACT_SQL)
    + """SELECT instrument_id, metric, unit, form, CAST(period_start AS VARCHAR) AS period_start, CAST(period_end AS VARCHAR) AS period_end, value, accession_number,
  epoch_us(available_at) AS available_us FROM facts, (SELECT unnest([1,2]))""",
)
def company_facts(spark, sf):
    out = filings.parse_company_facts(_fact_documents(spark, sf))
    return out.select(
        "instrument_id", "metric", "unit", "form", day("period_start"), day("period_end"), "value", "accession_number",
        F.unix_micros("available_at").alias("available_us"),
    )


@query(
    "A9 A10",
    V.with_views(_FACT_SQL)
    + """SELECT metric, unit, count(*) AS facts, CAST(0 AS BIGINT) AS conflicts, CAST(0 AS BIGINT) AS invalid FROM facts GROUP BY 1,2""",
)
def unique_company_facts(spark, sf):
    merged = filings.with_reasons(filings.unique_facts(filings.parse_company_facts(_fact_documents(spark, sf))))
    return merged.groupBy("metric", "unit").agg(
        F.count(F.lit(1)).alias("facts"), F.count_if("conflict").alias("conflicts"),
        F.count_if(F.size("reasons") > 0).alias("invalid"),
    )


@query(
    "A9 A10",
    V.with_views(_FACT_SQL, "keyed AS (SELECT *, split_part(accession_number,'-',1)::BIGINT AS o FROM facts)")
    + """SELECT metric, unit, count(*) AS facts, count(*) FILTER (o%23=0 AND o%19<>0) AS conflicts, count(*) FILTER (o%19=0) AS nonfinite,
  count(*) FILTER (o%13=0) AS starts_after_end, count(*) FILTER (o%17=0) AS filed_before_end, count(*) FILTER (o%13<>0 AND o%17<>0 AND o%19<>0) AS accepted FROM keyed GROUP BY 1,2""",
)
def fact_violations(spark, sf):
    """Facts with periods the wrong way round, filed early, not finite, or with two values in one accession."""
    facts = filings.parse_company_facts(_fact_documents(spark, sf))
    order = F.split_part("accession_number", F.lit("-"), F.lit(1)).cast("bigint")
    shifted = F.when((order % 23 == 0) & F.col("frame").isNotNull(), F.col("value") + 1).otherwise(F.col("value"))
    broken = facts.withColumns(
        {
            "value": F.when(order % 19 == 0, F.lit(float("nan"))).otherwise(shifted),
            "period_start": F.when(order % 13 == 0, F.date_add("period_end", 1)).otherwise(F.col("period_start")),
            "filed_date": F.when(order % 17 == 0, F.date_sub("period_end", 1)).otherwise(F.col("filed_date")),
        }
    )
    merged = filings.with_reasons(filings.unique_facts(broken))
    has = lambda reason: F.count_if(F.array_contains("reasons", reason))
    return merged.groupBy("metric", "unit").agg(
        F.count(F.lit(1)).alias("facts"), F.count_if("conflict").alias("conflicts"), has("value_nonfinite").alias("nonfinite"),
        has("period_starts_after_it_ends").alias("starts_after_end"), has("filed_before_period_end").alias("filed_before_end"),
        F.count_if(F.size("reasons") == 0).alias("accepted"),
    )


# ---- macro ------------------------------------------------------------------


def _macro_pages(spark, sf):
    """Observation pages, one per order; some values are a dot, some ends precede their vintage."""
    orders = views.table(spark, sf, "orders")
    observed = F.to_date("o_orderdate")
    vintage = F.date_add(observed, (F.col("o_custkey") % 40).cast("int"))
    record = F.struct(
        observed.cast("string").alias("date"), vintage.cast("string").alias("realtime_start"),
        F.date_add(vintage, F.when(F.col("o_orderkey") % 101 == 0, -1).otherwise(30)).cast("string").alias("realtime_end"),
        F.when(F.col("o_custkey") % 29 == 0, ".").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("value"),
    )
    return orders.select(
        F.lower(views._mapped(F.col("o_orderpriority"), views.SERIES_OF_PRIORITY)).alias("series_id"),
        F.to_json(F.struct(F.array(record).alias("observations"))).alias("payload"),
    )


_PAGES_SQL = f"""obs AS (SELECT {V.SERIES} AS series_id, o_orderdate::DATE AS observation_date, o_orderdate::DATE + CAST(o_custkey%40 AS INTEGER) AS vintage_date,
  CASE WHEN o_custkey%29<>0 THEN o_totalprice END AS value, o_orderdate::DATE + CAST(o_custkey%40 AS INTEGER) + CASE WHEN o_orderkey%101=0 THEN -1 ELSE 30 END AS realtime_end FROM orders),
stamped AS (SELECT *, {V.CHICAGO.format("(vintage_date+1)::TIMESTAMP")} AS available_at FROM obs)"""


@query(
    "A11 A15",
    V.with_views(_PAGES_SQL)
    + """SELECT series_id, CAST(observation_date AS VARCHAR) AS observation_date, CAST(vintage_date AS VARCHAR) AS vintage_date, value, CAST(realtime_end AS VARCHAR) AS realtime_end,
  epoch_us(available_at) AS available_us FROM stamped""",
)
def macro_documents(spark, sf):
    return macro.parse_observations(_macro_pages(spark, sf)).select(
        "series_id", day("observation_date"), day("vintage_date"), "value", day("realtime_end"),
        F.unix_micros("available_at").alias("available_us"),
    )


@query(
    "A11 A12",
    V.with_views(_PAGES_SQL)
    + """SELECT series_id, count(*) AS vintages, count(*) FILTER (c) AS conflicts FROM (SELECT series_id, observation_date, vintage_date,
  (coalesce(min(value)<>max(value),false) OR (count(value)>0 AND count(value)<count(*)) OR min(realtime_end)<>max(realtime_end)) AS c FROM obs GROUP BY 1,2,3) GROUP BY 1""",
)
def macro_vintage_conflicts(spark, sf):
    merged = macro.unique_observations(macro.parse_observations(_macro_pages(spark, sf)))
    return merged.groupBy("series_id").agg(F.count(F.lit(1)).alias("vintages"), F.count_if("conflict").alias("conflicts"))


@query(
    "A12",
    V.with_views(_PAGES_SQL)
    + """SELECT series_id, count(*) AS parsed, count(*) FILTER (observation_date<DATE '1997-01-01') AS excluded_before_start,
  count(*) FILTER (greatest(observation_date,vintage_date)>DATE '2000-12-31') AS after_requested_end, count(*) FILTER (realtime_end<vintage_date) AS realtime_end_before_vintage FROM obs GROUP BY 1""",
)
def macro_window_audit(spark, sf):
    rows = macro.parse_observations(_macro_pages(spark, sf))
    _, audit = macro.observation_window(rows, F.lit("1997-01-01").cast("date"), F.lit("2000-12-31").cast("date"))
    bad = rows.groupBy("series_id").agg(F.count_if(dict(macro.observation_checks())["realtime_end_before_vintage"]).alias("realtime_end_before_vintage"))
    return audit.join(bad, "series_id")


@query(
    "A13",
    """SELECT p_brand AS brand, count(*) AS records, count(*) FILTER (length(trim(p_name))=0) AS text_invalid,
  count(*) FILTER (p_size>25) AS observation_range_reversed, count(*) FILTER (p_size%7=0) AS updated_after_observation FROM part GROUP BY 1""",
)
def metadata_checks(spark, sf):
    """Series metadata derived from parts: reversed ranges and provider updates after observation are found."""
    part = views.table(spark, sf, "part")
    observed = F.lit("2024-01-10").cast("timestamp")
    base = F.lit("2024-01-01").cast("date")
    raw = part.select(
        F.col("p_brand").alias("brand"), F.concat(F.lit("s"), F.col("p_partkey").cast("string")).alias("series_id"), F.col("p_name").alias("title"),
        F.col("p_type").alias("frequency"), F.lit("D").alias("frequency_short"), F.lit("Percent").alias("units"), F.lit("%").alias("units_short"),
        F.lit("Seasonally Adjusted").alias("seasonal_adjustment"), F.lit("SA").alias("seasonal_adjustment_short"),
        F.date_add(base, F.when(F.col("p_size") > 25, -10).otherwise(-40)).alias("observation_start"), F.date_add(base, -20).alias("observation_end"),
        base.alias("realtime_start"), base.alias("realtime_end"),
        F.timestamp_add("DAY", F.when(F.col("p_size") % 7 == 0, 1).otherwise(-1), observed).alias("last_updated"),
    )
    tagged = macro.metadata_reasons(macro.normalise_metadata(raw, observed))
    codes = ("text_invalid", "observation_range_reversed", "updated_after_observation")
    return tagged.groupBy("brand").agg(
        F.count(F.lit(1)).alias("records"), *[F.count_if(F.array_contains("reasons", c)).alias(c) for c in codes]
    )


# ---- news and times ---------------------------------------------------------


@query(
    "A14",
    """SELECT 'alpaca:'||doc_id AS event_id, 'alpaca-news:'||source AS source, sha256(text) AS title_hash, CASE WHEN lang<source THEN '["'||lang||'","'||source||'"]' ELSE '["'||source||'","'||lang||'"]' END AS entity_ids,
  epoch_us(greatest(TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 20000 AS INTEGER)), TIMESTAMP '2024-01-20')) AS available_us,
  (TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 20000 AS INTEGER)) < TIMESTAMP '2024-01-19') AS backfill FROM documents""",
)
def news_metadata(spark, sf):
    docs = views.table(spark, sf, "documents")
    created = F.timestamp_add("HOUR", (F.col("doc_id") % views.NEWS_HOURS).cast("int"), F.lit("2024-01-01").cast("timestamp"))
    articles = docs.select(
        F.col("doc_id").alias("id"), F.col("text").alias("headline"), created.alias("created_at"), created.alias("updated_at"),
        F.lit("desk").alias("author"), "source", F.lit(None).cast("string").alias("url"), F.array("source", "lang").alias("symbols"),
    )
    out = news.normalise(articles, F.lit("2024-01-20").cast("timestamp"))
    return out.select(
        "event_id", "source", "title_hash", "entity_ids", F.unix_micros("available_at").alias("available_us"),
        F.get_json_object("quality_flags", "$.historical_backfill").cast("boolean").alias("backfill"),
    )


@query(
    "A15",
    f"""SELECT CAST(d AS VARCHAR) AS d, epoch_us({V.NY.format("(d+1)::TIMESTAMP")}) AS new_york_us, epoch_us({V.CHICAGO.format("(d+1)::TIMESTAMP")}) AS chicago_us
  FROM (SELECT DISTINCT l_shipdate::DATE AS d FROM lineitem)""",
)
def delayed_availability(spark, sf):
    days = views.table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("d")).distinct()
    return days.select(
        day("d"), F.unix_micros(after_local_date(F.col("d"), filings.ZONE)).alias("new_york_us"),
        F.unix_micros(after_local_date(F.col("d"), macro.ZONE)).alias("chicago_us"),
    )


@query(
    "A18 A19 C23",
    """SELECT event_id, CASE WHEN event_id%5=0 THEN NULL ELSE strftime(ts - CASE WHEN event_id%3=0 THEN INTERVAL 2 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m-%dT%H:%M:%S.%f')||'+00:00' END AS utc FROM events""",
)
def canonical_instants(spark, sf):
    """Zoned text in mixed spellings to one UTC spelling; text without a zone is refused."""
    events = views.table(spark, sf, "events")
    k = F.col("event_id")
    text = F.concat(
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
        F.when(k % 5 == 0, "").when(k % 3 == 0, "+02:00").otherwise("Z"),
    )
    return events.select("event_id", canonical_utc(text).alias("utc"))


# ---- bars, files, manifests -------------------------------------------------


def _stamped_bars(spark, sf):
    return views.bars(spark, sf).select("symbol", F.col("d").cast("timestamp").alias("timestamp"), *src_bars.REQUIRED)


@query(
    "A6 A7",
    V.with_views(V.BARS)
    + """SELECT symbol, count(*) AS rows, count(*) FILTER (d::TIMESTAMP <= TIMESTAMP '2000-01-01 12:00:00' - INTERVAL 1 DAY) AS complete,
  count(*) FILTER (high<greatest(open,close,low) OR low>least(open,close,high)) AS ohlc_bounds, CAST(min(d) AS VARCHAR) AS first_date, CAST(max(d) AS VARCHAR) AS last_date FROM bars GROUP BY 1""",
)
def snapshot_validation(spark, sf):
    tagged = src_bars.completeness(src_bars.snapshot_reasons(_stamped_bars(spark, sf)), F.lit("2000-01-01 12:00:00").cast("timestamp"))
    return tagged.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("complete").alias("complete"),
        F.count_if(F.array_contains("reasons", "ohlc_bounds")).alias("ohlc_bounds"),
        F.to_date(F.min("timestamp")).cast("string").alias("first_date"), F.to_date(F.max("timestamp")).cast("string").alias("last_date"),
    )


@query(
    "A4 A5 A20",
    f"""WITH trades AS (SELECT {V.SYMBOL} AS symbol, l_shipdate::DATE AS d, l_extendedprice/l_quantity AS p, l_quantity AS v, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
  last AS (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY symbol, d ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC)=1)
  SELECT symbol, count(*) AS rows, CAST(min(d) AS VARCHAR) AS first_date, CAST(max(d) AS VARCHAR) AS last_date, CAST(sum(v) AS DOUBLE) AS volume FROM last WHERE d < DATE '2000-06-15' GROUP BY 1""",
)
def keep_last_rows(spark, sf):
    items = views.table(spark, sf, "lineitem")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = items.select(
        views.symbol_column().alias("symbol"), F.to_date("l_shipdate").cast("timestamp").alias("timestamp"),
        *[price.alias(c) for c in ("open", "high", "low", "close")], F.col("l_quantity").alias("volume"), views.trade_order().alias("_seq"),
    )
    kept = src_bars.completed_rows(src_bars.keep_last(rows), F.lit("2000-06-15 10:00:00").cast("timestamp"))
    described = src_bars.describe(kept).select("symbol", "rows", day("first_date"), day("last_date"))
    return described.join(kept.groupBy("symbol").agg(F.sum("volume").alias("volume")), "symbol")


@query(
    "A24",
    V.with_views(V.BARS)
    + "SELECT symbol, count(*) AS rows, CAST(min(d) AS VARCHAR) AS first_date, CAST(max(d) AS VARCHAR) AS last_date FROM bars WHERE d<=DATE '1999-12-31' GROUP BY 1",
)
def historical_coverage(spark, sf):
    _, coverage = src_bars.historical_cut(views.bars(spark, sf), F.lit("1999-12-31").cast("date"))
    return coverage.select("symbol", "rows", day("first_date"), day("last_date"))


@query("A1 A2 A3 A21", V.with_views(V.BARS) + "SELECT symbol, CASE WHEN symbol LIKE '%-USD' THEN 'crypto' ELSE 'equity' END AS asset_class, CAST(d AS VARCHAR) AS d, close, volume FROM bars")
def csv_round_trip(spark, sf):
    """Bars written as CSV folders per symbol and scanned back in one read."""
    path = scratch(spark, "bars-csv")
    frame = _stamped_bars(spark, sf).withColumn("symbol", F.regexp_replace("symbol", r"\^", "INDEX_"))
    sinks.write_new(frame, path, "csv", partition_by=["symbol"], header=True)
    back = src_bars.read_daily_csv(spark, f"{path}/*")
    return src_bars.normalise_columns(back).select(
        "symbol", "asset_class", F.to_date("timestamp").cast("string").alias("d"), "close", "volume"
    )


@query(
    "A21 A22 A25",
    V.with_views(V.BARS, V.MACRO) + "SELECT 'bars' AS part, count(*) AS rows, true AS matches FROM bars UNION ALL SELECT 'macro', count(*), true FROM macro",
)
def manifest_round_trip(spark, sf):
    root = scratch(spark, "publication")
    sinks.publish({"bars": views.bars(spark, sf), "macro": views.macro(spark, sf)}, root)
    return sinks.verify(spark, root).select("part", "rows", "matches")


@query(
    "B12 B11",
    V.with_views(V.BARS, V.IDENTITIES)
    + """SELECT version, part, rows, request FROM (SELECT 1::INTEGER AS version, 'bars' AS part, count(*) AS rows, 'first' AS request FROM bars WHERE year(d)<1998
  UNION ALL SELECT 1, 'aliases', count(*), 'first' FROM identities UNION ALL SELECT 2, 'bars', count(*), 'second' FROM bars UNION ALL SELECT 2, 'aliases', count(*), 'second' FROM identities)""",
)
def atomic_batches(spark, sf):
    """Two batches of bars and aliases, each published at once; the counts are those of the rows read back."""
    root, bars, aliases = scratch(spark, "batches"), views.stored(views.bars(spark, sf)), views.identities(spark, sf)
    for request, rows in (("first", bars.filter(F.year("d") < 1998)), ("second", bars)):
        sinks.publish_batch({"bars": rows, "aliases": aliases}, root, request)
    audits = sinks.pointers(spark, root)
    read = None
    for version in (1, 2):
        for part, schema in (("bars", bars.schema), ("aliases", aliases.schema)):
            found = sinks.read_batch(spark, root, part, schema, version).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(version).alias("version"), F.lit(part).alias("part"), "rows")
            read = found if read is None else read.unionByName(found)
    return audits.select("version", "part", "request").join(read, ["version", "part"]).select("version", "part", "rows", "request")


@query(
    "A23",
    V.with_views(V.PREDICTIONS) + "SELECT symbol, CAST(d AS VARCHAR) AS d, probability, target_return, CAST(target AS BIGINT) AS target FROM predictions",
)
def prediction_sink(spark, sf):
    path = scratch(spark, "oos")
    sinks.write_predictions(views.predictions(spark, sf), path)
    back = spark.read.schema("symbol string, d date, probability double, target_return double, target int").option("header", True).csv(path)
    return back.select("symbol", day("d"), "probability", "target_return", F.col("target").cast("bigint").alias("target"))


@query(
    "C22",
    V.with_views(V.FUNDAMENTALS, V.MACRO, V.NEWS)
    + """SELECT source, fetched, inserted, CASE WHEN fetched=0 THEN 'EMPTY' WHEN inserted>0 THEN 'UPDATED' ELSE 'NO_NEW_ROWS' END AS status FROM (
  SELECT 'fundamentals' AS source, count(*) AS fetched, count(*) FILTER (available_at>TIMESTAMP '1998-01-01') AS inserted FROM fundamentals
  UNION ALL SELECT 'macro_observations', count(*), count(*) FILTER (available_at>TIMESTAMP '1998-01-01') FROM macro
  UNION ALL SELECT 'news_events', count(*), CAST(0 AS BIGINT) FROM news)""",
)
def refresh_outcomes(spark, sf):
    """Each source's batch against what is stored: fetched, inserted, status."""
    from ..operators import warehouse as wh

    facts, rows, events = views.fundamentals(spark, sf), views.macro(spark, sf), views.news(spark, sf)
    cut = F.col("available_at") <= F.lit("1998-01-01").cast("timestamp")
    batches = {
        "fundamentals": (facts, wh.insert_or_ignore(facts.filter(cut), facts, "fundamentals")),
        "macro_observations": (rows, wh.insert_or_ignore(rows.filter(cut), rows, "macro_observations")),
        "news_events": (events, wh.insert_or_ignore(events, events, "news_events")),
    }
    return wh.refresh_outcomes(batches)
