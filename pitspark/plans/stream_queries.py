"""Registered queries: file-source streams over the driver tables, run to the end and read back."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import MINUTE_NS
from ..operators import warehouse as wh
from ..streaming import jobs
from ..streaming import quotes as sq
from . import oracle_market as M
from . import oracle_views as V
from . import views
from .ledger_queries import _FEES, _JOURNAL, _KEY_RANGE, _STATES, _money, _signals
from .oracle_views import with_views
from .registry import query
from .source_queries import scratch


def _staged(spark, df: DataFrame, name: str) -> DataFrame:
    """Write the derived rows once, as partitioned as they are, and read the folder back as a stream."""
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 64).parquet(path)


@contextmanager
def _settings(spark, **values):
    """Session settings (dots written as underscores below ``spark.sql``) for the time of a block."""
    names = {f"spark.sql.{name.replace('_', '.')}": value for name, value in values.items()}
    before = {name: spark.conf.get(name) for name in names}
    try:
        for name, value in names.items():
            spark.conf.set(name, str(value).lower())
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _state_tasks(spark) -> int:
    """Shuffle partitions of a stream whose state the calendar bounds: every one commits its stores in every micro-batch."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _by_period(spark, inputs: dict[str, DataFrame], run, bounded_state: bool = False) -> None:
    """Feed one ``period`` of all inputs after the other: each run of the job takes what has arrived as a micro-batch.

    Every input is written once, partitioned by its period, and a period is appended from its own partition. With
    ``bounded_state`` (aggregates and joins without timers) the streams have no more state partitions than there are
    cores, and what the watermark closes is written with the next period: only the last has a batch without rows.
    """
    folders, periods = {}, set()
    for name, df in inputs.items():
        source, target = scratch(spark, name + "-periods"), scratch(spark, name)
        df.write.partitionBy("period").parquet(source)
        rows = spark.read.schema(df.schema).parquet(source)
        folders[name] = (rows, target)
        periods |= {r.period for r in rows.select("period").distinct().collect()}  # partition values
    for period in sorted(periods):
        streams = []
        for rows, target in folders.values():
            rows.where(F.col("period") == period).drop("period").write.mode("append").parquet(target)
            streams.append(spark.readStream.schema(rows.drop("period").schema).parquet(target))
        few = {"shuffle_partitions": _state_tasks(spark), "streaming_noDataMicroBatches_enabled": period == max(periods)}
        with _settings(spark, **few if bounded_state else {}):
            run(*streams)


def _ordered(rows: DataFrame, time: str, periods: int = 4) -> DataFrame:
    """Rows with the ``period`` of their time, in as many equal spans; rows without a time come first."""
    span = rows.agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    share = F.expr(f"({time} - lo) div ((hi - lo) div {periods} + 1)")
    return rows.join(F.broadcast(span)).withColumn("period", F.coalesce(share, F.lit(0)).cast("bigint")).drop("lo", "hi")  # one row


_FAR_NS = 400 * 24 * 60 * MINUTE_NS


def _closing(rows: DataFrame) -> DataFrame:
    """One far-future row of another symbol in a period of its own: it moves the watermark past all others."""
    last = rows.agg(F.max("event_ns").alias("event_ns"), (F.max("period") + 1).alias("period"))
    fixed = {"symbol": F.lit("~"), "event_ns": F.col("event_ns") + F.lit(_FAR_NS), "period": F.col("period")}
    return rows.unionByName(last.select(*[fixed.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema]))


def _quote_job(spark, sf, name: str, job, bounded_state: bool = False) -> tuple[DataFrame, DataFrame]:
    """(output of a quote job fed in order, the quotes without an instant that it rejects)."""
    rows = _closing(_ordered(views.quote_records(spark, sf), "event_ns"))
    paths = [scratch(spark, f"{name}-{part}") for part in ("out", "checkpoint", "rejected", "rejected-checkpoint")]
    schemas = {}

    def run(stream: DataFrame) -> None:
        readable, rejected = sq.split_readable(stream)
        result = job(sq.with_event_time(readable))
        schemas.update(out=result.schema, rejected=rejected.schema)
        jobs.run_to_table(rejected, paths[2], paths[3])
        jobs.run_to_table(result, paths[0], paths[1])

    _by_period(spark, {name: rows}, run, bounded_state)
    out = spark.read.schema(schemas["out"]).parquet(paths[0])
    return out.filter(F.col("symbol") != "~"), spark.read.schema(schemas["rejected"]).parquet(paths[2])


def _collected(spark, stream: DataFrame, name: str) -> DataFrame:
    path = scratch(spark, name)
    jobs.run_to_table(stream, path, scratch(spark, name + "-checkpoint"))
    return spark.read.schema(stream.schema).parquet(path)


def _split(spark, stream: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The stream's quotes with an instant, and the table of those without one, which the job rejects."""
    readable, rejected = sq.split_readable(stream)
    return readable, _collected(spark, rejected, name + "-rejected")


@query(
    "O1",
    with_views(M.EVENTS, M.QUOTE_RECORDS)
    + "SELECT symbol, count(*) AS quotes, min(event_ns) AS first_ns, max(event_ns) AS last_ns FROM (SELECT DISTINCT symbol, event_ns, bid, ask, bid_size, ask_size, cond_ok, tape FROM qrec WHERE event_ns IS NOT NULL) GROUP BY 1",
)
def stream_deduplicated_quotes(spark, sf):
    return _deduplicated(spark, sf)[0]


def _deduplicated(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Quotes fed in four spans of time; the state holds two days of them."""
    rows, rejected = _quote_job(
        spark, sf, "dedup", lambda quotes: sq.deduplicate(quotes, ["symbol", "event_ns", "identity"], "2 days").select("symbol", "event_ns")
    )
    return rows.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("quotes"), F.min("event_ns").alias("first_ns"), F.max("event_ns").alias("last_ns")
    ), rejected


@query(
    "O2",
    with_views(M.EVENTS, M.QUOTE_RECORDS)
    + """SELECT symbol, h AS window_us, count(*) AS quotes, count(*) FILTER (NOT ok) AS invalid, round(min(CASE WHEN ok THEN sp END),6) AS min_spread_bps, round(max(CASE WHEN ok THEN sp END),6) AS max_spread_bps,
  round(avg(CASE WHEN ok THEN sp END),6) AS mean_spread_bps, count(DISTINCT CASE WHEN ok THEN m END)::INTEGER AS covered_minutes, round(count(DISTINCT CASE WHEN ok THEN m END)/60.0::DOUBLE,6) AS coverage,
  array_to_string(list_filter(range(60), lambda x: NOT coalesce(list_contains(list(CASE WHEN ok THEN m END), x), false)), ',') AS missing_minutes FROM (
  SELECT symbol, event_ns//3600000000000*3600000000 AS h, event_ns//60000000000%60 AS m, least(bid,ask,bid_size,ask_size)>0 AND bid<=ask AS ok, (ask-bid)/(bid+(ask-bid)/2)*10000 AS sp FROM qrec WHERE event_ns IS NOT NULL)
 GROUP BY 1,2""",
)
def stream_hourly_spreads(spark, sf):
    """Tumbling hours in append mode with their spreads, minute coverage and gaps."""
    return _hourly(spark, sf)[0]


def _hourly(spark, sf) -> tuple[DataFrame, DataFrame]:
    out, rejected = _quote_job(spark, sf, "hourly", lambda quotes: sq.minute_windows(quotes, "2 days", 60), bounded_state=True)
    rounded = [F.round(c, 6).alias(c) for c in ("min_spread_bps", "max_spread_bps", "mean_spread_bps")]
    return out.select(
        "symbol", F.unix_micros("window_start").alias("window_us"), "quotes", "invalid", *rounded, "covered_minutes",
        F.round("coverage", 6).alias("coverage"), F.array_join("missing_minutes", ",").alias("missing_minutes"),
    ), rejected


_AGE_MS, _IDLE_MS = 3_600_000, 24 * 3_600_000


@query(
    "O3 K5",
    with_views(M.EVENTS, M.QUOTE_RECORDS, M.WINDOWS, M.REPLAY)
    + f""", steps AS (SELECT *, lag(valid) OVER o AS before, lead(event_ns) OVER o AS following FROM inst2 WINDOW o AS (PARTITION BY symbol, w ORDER BY event_ns))
SELECT symbol, w, event_ns, CASE WHEN valid THEN 'VALID' ELSE 'INVALID' END AS status, CASE WHEN before AND NOT valid THEN 'INVALIDATED' WHEN NOT before AND valid THEN 'RECOVERED' END AS change,
  updates>1 AS ambiguous, CASE WHEN valid THEN bid END AS bid, CASE WHEN valid THEN ask END AS ask FROM steps
UNION ALL SELECT symbol, w, event_ns+{_AGE_MS}*1000000::BIGINT+1, 'STALE', 'STALE', false, NULL, NULL FROM steps WHERE valid AND coalesce(following>event_ns+{_AGE_MS}*1000000::BIGINT, true)""",
)
def stream_state_changes(spark, sf):
    """Every change of every window's quote state, as the batch replay sees them, and the moments it goes stale."""
    previous = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return _quote_job(spark, sf, "changes", lambda quotes: sq.state_changes(quotes, ["symbol", "w"], _AGE_MS, _IDLE_MS, "2 days"))[0]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", previous)


@query(
    "O3",
    with_views(M.EVENTS, M.QUOTE_RECORDS, M.WINDOWS, M.REPLAY)
    + "SELECT symbol, w, event_ns, updates>1 AS ambiguous, valid, CASE WHEN valid THEN bid END AS bid, CASE WHEN valid THEN ask END AS ask FROM inst2 QUALIFY row_number() OVER (PARTITION BY symbol, w ORDER BY event_ns DESC)=1",
)
def stream_last_states(spark, sf):
    return _last_states(spark, sf)[0]


def _last_states(spark, sf) -> tuple[DataFrame, DataFrame]:
    readable, rejected = _split(spark, _staged(spark, views.quote_records(spark, sf), "states"), "last-states")
    path = scratch(spark, "last-states")
    jobs.run_complete(
        sq.last_states(readable, ["symbol", "w"]), lambda df: df.write.mode("overwrite").parquet(path), scratch(spark, "last-states-checkpoint")
    )
    return spark.read.parquet(path), rejected


@query(
    "O1 O2 O3",
    with_views(M.EVENTS, M.QUOTE_RECORDS)
    + "SELECT job, symbol, w, 'invalid_or_naive_timestamp' AS reason, count(*) AS quotes FROM qrec, (VALUES ('O1'),('O2'),('O3')) AS jobs(job) WHERE event_ns IS NULL GROUP BY 1,2,3",
)
def stream_rejected_quotes(spark, sf):
    """Quotes without a readable instant that the three quote jobs rejected, copies included, per job and window."""
    rejects = [run(spark, sf)[1].select(F.lit(job).alias("job"), "symbol", "w", "reason") for job, run in (("O1", _deduplicated), ("O2", _hourly), ("O3", _last_states))]
    every = rejects[0].unionByName(rejects[1]).unionByName(rejects[2])
    return every.groupBy("job", "symbol", "w", "reason").agg(F.count(F.lit(1)).alias("quotes"))


@query(
    "O5",
    """SELECT epoch_us(s) AS window_us, count(*) AS orders FROM (SELECT ts, unnest(generate_series(time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 5 HOUR, time_bucket(INTERVAL 1 HOUR, ts), INTERVAL 1 HOUR)) AS s FROM events) GROUP BY 1""",
)
def stream_order_rate(spark, sf):
    """Orders per sliding six-hour window advanced hourly."""
    events = views.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("event_time"))
    stream = _staged(spark, events, "orders")
    path = scratch(spark, "rates")
    jobs.run_complete(
        sq.sliding_rate(stream, "6 hours", "1 hour", "60 days"), lambda df: df.write.mode("overwrite").parquet(path), scratch(spark, "rates-checkpoint")
    )
    return spark.read.parquet(path).select(F.unix_micros("window_start").alias("window_us"), "orders")


_LATE = "l_orderkey%101=0"
_PLACE = "{t}.day, {t}.l_orderkey, {t}.l_partkey, {t}.l_suppkey, {t}.l_linenumber"


@query(
    "O4 N4",
    V.with_views(
        V.FILLS, _FEES.replace("feed AS", "whole AS"),
        f"arrivals AS (SELECT *, year(day)+CASE WHEN {_LATE} THEN 1 ELSE 0 END AS period FROM whole)",
        "counted AS (SELECT symbol, period, max((day, l_orderkey, l_partkey, l_suppkey, l_linenumber)) AS place FROM arrivals GROUP BY 1, 2)",
        "behind AS (SELECT symbol, period, max(place) OVER (PARTITION BY symbol ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS place FROM counted)",
        f"judged AS (SELECT a.*, coalesce(({_PLACE.format(t='a')})<=b.place, false) AS late FROM arrivals a JOIN behind b USING (symbol, period))",
        "feed AS (SELECT * FROM judged WHERE NOT late)", _STATES,
    )
    + f"""SELECT symbol, CAST(q AS VARCHAR) AS quantity, {_money('p')} AS average_price, {_money('r')} AS realized_pnl, late_fills
  FROM states JOIN (SELECT symbol, count(*) FILTER (late) AS late_fills FROM judged GROUP BY 1) USING (symbol) WHERE d IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC)=1""",
)
def stream_positions(spark, sf):
    """Average-cost positions advanced by yearly micro-batches; some fills arrive a year late and are set aside."""
    late = F.col("l_orderkey") % 101 == 0
    fills = views.fills(spark, sf).withColumns(
        {"bin": F.expr(f"l_orderkey div {_KEY_RANGE}"), "period": F.year("day") + F.when(late, 1).otherwise(0)}
    )
    order = ["day", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    positions, set_aside, checkpoint = (scratch(spark, name) for name in ("positions", "late-fills", "positions-checkpoint"))
    _by_period(spark, {"fills": fills}, lambda stream: jobs.ledger_job(stream, positions, set_aside, checkpoint, "day", "bin", order).awaitTermination())
    rows = fills.drop("period")
    state = jobs.newest(jobs.table(spark, positions, jobs.position_schema(rows, order)))
    counts = spark.read.parquet(set_aside).groupBy("symbol").agg(F.count(F.lit(1)).alias("late_fills"))
    money = [F.col(c).cast("decimal(28,8)").cast("string").alias(c) for c in ("average_price", "realized_pnl")]
    return state.join(counts, "symbol", "left").select(
        "symbol", F.col("quantity").cast("decimal(28,0)").cast("string").alias("quantity"), *money, F.coalesce("late_fills", F.lit(0)).alias("late_fills")
    )


@query(
    "O6 B5",
    V.with_views(V.MARKET_BARS)
    + """SELECT instrument_id, count(*) AS rows, count(DISTINCT event_time) AS days FROM (
  SELECT *, lag((open,high,low,close,volume)) OVER w AS prev FROM (SELECT * FROM market_bars WHERE data_version LIKE 'snapshot-v2:%'
    QUALIFY row_number() OVER (PARTITION BY instrument_id, event_time, year(available_at) ORDER BY available_at DESC, ingested_at DESC, data_version DESC)=1)
  WINDOW w AS (PARTITION BY instrument_id, event_time ORDER BY available_at)) WHERE prev IS NULL OR prev<>(open,high,low,close,volume) GROUP BY 1""",
)
def stream_ingest(spark, sf):
    """Yearly snapshots ingested as micro-batches: only new or changed bars are appended."""
    from ..operators.cutoffs import latest_version

    bars = wh.observed_daily(views.market_bars(spark, sf)).withColumn("period", F.year("available_at"))
    yearly = latest_version(
        bars, ["instrument_id", "event_time", "period"], [F.desc("available_at"), F.desc("ingested_at"), F.desc("data_version")]
    )
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in yearly.drop("period").schema)
    root, checkpoint = scratch(spark, "warehouse"), scratch(spark, "warehouse-checkpoint")
    _by_period(spark, {"snapshots": yearly}, lambda stream: jobs.ingest_job(stream, root, ddl, checkpoint).awaitTermination())
    stored = jobs.table(spark, root, f"{ddl}, period date, batch_id bigint", jobs.SNAPSHOT_PARTS)
    return stored.groupBy("instrument_id").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("event_time").alias("days"))


@query(
    "O7 M4",
    _JOURNAL
    + """, b AS (SELECT symbol, d, close, CASE WHEN dayofyear(d)%50=0 THEN -open ELSE open END AS open FROM bars WHERE dayofyear(d)%37<>0),
judged AS (SELECT s.*, CASE WHEN b.symbol IS NULL THEN 'EXPIRED' WHEN b.open>0 AND b.close>0 THEN 'EVALUATED' ELSE 'INVALID_BAR' END AS outcome, b.close/b.open-1 AS r
  FROM signals s LEFT JOIN b ON b.symbol=s.symbol AND b.d=s.target_session)
SELECT symbol, CAST(target_session AS VARCHAR) AS target_session, outcome, round(CASE WHEN outcome='EVALUATED' THEN r END,6) AS realized_return,
  round(CASE WHEN outcome='EVALUATED' THEN direction*r - CASE WHEN direction<>0 THEN cost_bps/10000 ELSE 0 END END,6) AS strategy_return FROM judged""",
)
def stream_settlement(spark, sf):
    """Signals and bars of one year after the other; some bars are missing, some invalid, and every signal has an outcome."""
    signals = _signals(spark, sf).select("signal_id", "symbol", "target_session", "target_close", "probability_up", "cost_bps")
    cal = views.sessions(spark, sf).select(F.col("session_date"), "close_at")
    bars = views.bars(spark, sf).filter(F.dayofyear("d") % 37 != 0).join(cal, F.col("d") == F.col("session_date")).select(
        "symbol", "session_date", F.timestamp_add("MINUTE", F.lit(30), F.col("close_at")).alias("closed_at"),
        F.when(F.dayofyear("d") % 50 == 0, -F.col("open")).otherwise(F.col("open")).alias("open"), "close",
    )
    inputs = {}
    for name, rows, time in (("signals", signals, "target_close"), ("closed-bars", bars, "closed_at")):
        last = rows.agg((F.max(time) + F.expr("INTERVAL 400 DAYS")).alias(time))
        fixed = {time: F.col(time), "symbol": F.lit("~"), "target_session": F.to_date(time), "session_date": F.to_date(time)}  # no null key
        end = last.select(*[fixed.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in rows.schema])
        inputs[name] = rows.withColumn("period", F.year(time)).unionByName(end.withColumn("period", F.lit(9999)))
    path, checkpoint = scratch(spark, "settled"), scratch(spark, "settled-checkpoint")
    schema = []

    def run(signal_stream: DataFrame, bar_stream: DataFrame) -> None:
        joined = jobs.settlement_stream(signal_stream, bar_stream, lateness="7 days", wait="3 days")
        schema[:] = [joined.schema]
        jobs.run_to_table(joined, path, checkpoint)

    _by_period(spark, inputs, run, bounded_state=True)
    rows = spark.read.schema(schema[0]).parquet(path).filter(F.col("symbol") != "~")
    return rows.select(
        "symbol", F.col("target_session").cast("string").alias("target_session"), "outcome",
        F.round("realized_return", 6).alias("realized_return"), F.round("strategy_return", 6).alias("strategy_return"),
    )
