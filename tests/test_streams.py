"""Streams over several micro-batches: state changes, bounded state, coverage, late fills, outcomes, replayed batches."""

import os
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pitspark.operators import ledger as lg
from pitspark.operators import replay
from pitspark.streaming import jobs
from pitspark.streaming import quotes as sq

QUOTE = "symbol string, event_ns bigint, bid double, ask double, bid_size double, ask_size double, conditions array<string>, tape string, identity string"
BASE = 1788528600 * 10**9
SECOND = 10**9


@pytest.fixture()
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def quote(symbol, at, bid=99.0, ask=100.0, tape="A"):
    return (symbol, at, bid, ask, 1.0, 1.0, ["R"], tape, f"{bid}|{ask}|{tape}")


def fed(spark, tmp_path, batches, schema, job):
    """Run ``job(stream, out)`` after each batch has arrived; the last query's progress."""
    path, query = str(tmp_path / "in"), None
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        query = job(spark.readStream.schema(schema).parquet(path))
        query.awaitTermination()
    return query


def appended(tmp_path, make):
    def job(stream):
        return make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()

    return job


def test_state_changes_equal_the_batch_replay(spark, tmp_path, rocks):
    rng = random.Random(4)
    rows = []
    for _ in range(150):
        at = BASE + rng.randint(0, 120) * SECOND // 2 + rng.choice([0, 0, 1])
        bid = rng.choice([99.0, 99.0, 99.5, 100.0, 101.0, -1.0])
        rows.append(quote(rng.choice(["SPY", "SPY", "JPM"]), at, bid, 100.0, rng.choice(["A", "A", "A", "Z"])))
    rows += rows[:20]
    rows.sort(key=lambda r: r[1])
    batches = [rows[:60], rows[60:120], rows[120:]]
    for b in batches:
        rng.shuffle(b)
    batches[1].append(batches[0].pop())  # a little late, within the bound
    end = [quote("~", BASE + 10**6 * SECOND)]
    age = 2_000
    fed(spark, tmp_path, [*batches, end], QUOTE, appended(tmp_path, lambda s: sq.state_changes(sq.with_event_time(s), ["symbol"], age, 10**8, "100 seconds")))
    got = {(r.symbol, r.event_ns, r.status): (r.change, r.ambiguous, r.bid, r.ask) for r in spark.read.parquet(str(tmp_path / "out")).filter("symbol <> '~'").collect()}
    records = spark.createDataFrame(rows, QUOTE).withColumns({"start_ns": F.lit(0).cast("bigint"), "end_ns": F.lit(2**62).cast("bigint")})
    want, before = {}, {}
    for r in replay.events(records, ["symbol"]).orderBy("symbol", "event_ns").collect():
        last = before.get(r.symbol)
        if last and last.valid and r.event_ns > last.event_ns + age * 10**6:
            want[r.symbol, last.event_ns + age * 10**6 + 1, "STALE"] = ("STALE", False, None, None)
        change = None if last is None or last.valid == r.valid else "RECOVERED" if r.valid else "INVALIDATED"
        want[r.symbol, r.event_ns, "VALID" if r.valid else "INVALID"] = (change, r.updates > 1, r.quote.bid if r.valid else None, r.quote.ask if r.valid else None)
        before[r.symbol] = r
    for last in before.values():
        if last.valid:
            want[last.symbol, last.event_ns + age * 10**6 + 1, "STALE"] = ("STALE", False, None, None)
    assert got == want and {v[0] for v in want.values()} == {None, "STALE", "RECOVERED", "INVALIDATED"}


def test_an_idle_key_is_forgotten(spark, tmp_path, rocks):
    batches = [[quote("SPY", BASE, 101.0)], [quote("JPM", BASE + 100 * SECOND)], [quote("SPY", BASE + 200 * SECOND)], [quote("~", BASE + 10**5 * SECOND)]]
    query = fed(spark, tmp_path, batches, QUOTE, appended(tmp_path, lambda s: sq.state_changes(sq.with_event_time(s), ["symbol"], 1000, 5000, "1 second")))
    rows = sorted((r.symbol, r.status, r.change) for r in spark.read.parquet(str(tmp_path / "out")).filter("symbol <> '~'").collect())
    assert [r for r in rows if r[1] != "STALE"] == [("JPM", "VALID", None), ("SPY", "INVALID", None), ("SPY", "VALID", None)]
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # the closing row alone
    with pytest.raises(ValueError):
        sq.state_changes(spark.createDataFrame([], QUOTE).withColumn("event_time", F.lit(None).cast("timestamp")), ["symbol"], 1000, 1000)


def test_deduplication_state_is_bounded_by_the_lateness(spark, tmp_path):
    rng = random.Random(2)
    batches = []
    for part in range(5):
        rows = [quote("SPY", BASE + (part * 1000 + i) * SECOND, 50.0 + i % 7) for i in range(400)]
        rows += rng.sample(rows, 100) + (batches[-1][395:400] if batches else [])
        batches.append(rows)
    job = appended(tmp_path, lambda s: sq.deduplicate(sq.with_event_time(s), ["symbol", "event_ns", "identity"], "700 seconds").select("symbol", "event_ns"))
    query = fed(spark, tmp_path, batches, QUOTE, job)
    rows = spark.read.parquet(str(tmp_path / "out"))
    assert rows.count() == rows.distinct().count() == 2000
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 800  # of 2000 seen


def test_minute_coverage_and_gaps(spark, tmp_path):
    at = lambda m, s=0: BASE // (3600 * SECOND) * 3600 * SECOND + (m * 60 + s) * SECOND
    batches = [[quote("A", at(0)), quote("A", at(0, 30)), quote("A", at(59)), quote("B", at(5), 101.0)], [quote("A", at(7)), quote("A", at(61))], [quote("~", at(100_000))]]
    fed(spark, tmp_path, batches, QUOTE, appended(tmp_path, lambda s: sq.minute_windows(sq.with_event_time(s), "2 hours", 60)))
    rows = {(r.symbol, r.window_start): r for r in spark.read.parquet(str(tmp_path / "out")).filter("symbol <> '~'").collect()}
    first, second = sorted(k for k in rows if k[0] == "A")
    assert (rows[first].quotes, rows[first].covered_minutes) == (4, 3) and rows[first].coverage == pytest.approx(0.05)
    assert rows[first].missing_minutes == [m for m in range(60) if m not in (0, 7, 59)]
    assert rows[second].missing_minutes == [m for m in range(60) if m != 1]
    (b,) = [r for k, r in rows.items() if k[0] == "B"]
    assert (b.invalid, b.covered_minutes, len(b.missing_minutes), b.mean_spread_bps) == (1, 0, 60, None)
    with pytest.raises(ValueError):
        sq.minute_windows(spark.createDataFrame([], QUOTE), "1 hour", 7)


FILL = "symbol string, side string, quantity decimal(18,8), price decimal(18,8), multiplier decimal(6,0), day date, seq bigint, bin bigint"


def test_late_fills_are_set_aside(spark, tmp_path):
    fill = lambda i, s="A", side="BUY": (s, side, Decimal(1 + i % 3), Decimal(90 + i), Decimal(1), date(2024, 1, 1) + timedelta(days=i), i, i // 2)
    batches = [[fill(0), fill(2), fill(4, "B")], [fill(1), fill(3, side="SELL"), fill(5, "B")], [], [fill(2), fill(6, "C")]]
    positions, late = str(tmp_path / "pos"), str(tmp_path / "late")
    fed(spark, tmp_path, batches, FILL, lambda s: jobs.ledger_job(s, positions, late, str(tmp_path / "ck"), "day", "bin", ["day", "seq"]))
    counted = [fill(0), fill(2), fill(4, "B"), fill(3, side="SELL"), fill(5, "B"), fill(6, "C")]
    want = lg.closing_positions(lg.average_cost(spark.createDataFrame(counted, FILL), "day", "bin", ["day", "seq"]), "day")
    state = jobs.newest(jobs.table(spark, positions, jobs.position_schema(spark.createDataFrame([], FILL), ["day", "seq"])))
    assert sorted(r[:4] for r in state.collect()) == sorted(tuple(r) for r in want.collect())
    assert sorted((r.symbol, r.seq, r.batch_id) for r in spark.read.parquet(late).collect()) == [("A", 1, 1), ("A", 2, 3)]


def test_a_replayed_batch_rewrites_its_own_partition(spark, tmp_path):
    root = str(tmp_path / "t")
    rows = lambda n: spark.range(n).select(F.col("id").alias("v"))
    assert jobs.newest(jobs.table(spark, root, "v bigint, batch_id bigint")).count() == 0
    jobs.overwrite_batch(rows(3), root, 0)
    first = sorted(os.listdir(f"{root}/batch_id=0"))
    jobs.overwrite_batch(rows(5), root, 1)
    jobs.overwrite_batch(rows(4), root, 1)
    stored = jobs.table(spark, root, "v bigint, batch_id bigint")
    assert {r.batch_id: r["count"] for r in stored.groupBy("batch_id").count().collect()} == {0: 3, 1: 4}
    assert sorted(os.listdir(f"{root}/batch_id=0")) == first
    assert jobs.newest(stored).count() == 4 and jobs.newest(stored, 1).count() == 3


def test_every_signal_has_one_outcome(spark, tmp_path):
    close = lambda d: datetime(2026, 1, d, 21)
    signals = "signal_id string, symbol string, target_session date, target_close timestamp, probability_up double, cost_bps double, status string"
    bars = "symbol string, session_date date, closed_at timestamp, open double, close double"
    s = lambda n, d, p=0.6, status="PENDING": (n, "SPY", date(2026, 1, d), close(d), p, 5.0, status)
    b = lambda d, o=100.0, minutes=30: ("SPY", date(2026, 1, d), close(d) + timedelta(minutes=minutes), o, 101.0)
    far = datetime(2027, 1, 1)
    steps = [
        ([s("hit", 5), s("none", 6), s("bad", 7), s("done", 5, status="EVALUATED")], [b(5)]),
        ([s("short", 8, 0.4), s("slow", 9)], [b(7, -1.0), b(8), b(9, minutes=4 * 24 * 60)]),
        ([("end", "~", far.date(), far, 0.5, 0.0, "PENDING")], [("~", far.date(), far, 1.0, 1.0)]),
    ]
    for left, right in steps:
        for rows, schema, name in ((left, signals, "s"), (right, bars, "b")):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams = [spark.readStream.schema(schema).parquet(str(tmp_path / name)) for schema, name in ((signals, "s"), (bars, "b"))]
        jobs.run_to_table(jobs.settlement_stream(*streams, lateness="2 days", wait="3 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.signal_id: (r.outcome, r.strategy_return) for r in spark.read.parquet(str(tmp_path / "out")).filter("symbol <> '~'").collect()}
    assert {k: v[0] for k, v in got.items()} == {"hit": "EVALUATED", "none": "EXPIRED", "bad": "INVALID_BAR", "short": "EVALUATED", "slow": "EXPIRED"}
    assert got["hit"][1] == pytest.approx(0.01 - 0.0005) and got["short"][1] == pytest.approx(-0.01 - 0.0005) and got["none"][1] is None


def test_a_stream_of_bounded_state_commits_few_stores_and_one_batch_without_rows(spark):
    from pitspark.plans import stream_queries

    names = ("spark.sql.shuffle.partitions", "spark.sql.streaming.noDataMicroBatches.enabled")
    settings = lambda: tuple(spark.conf.get(n) for n in names)
    rows, before = spark.createDataFrame([(v, v) for v in (1, 2, 3)], "v int, period int"), settings()
    spark.conf.set(names[0], "64")
    try:
        few, many = [], []
        stream_queries._by_period(spark, {"few": rows}, lambda stream: few.append(settings()), bounded_state=True)
        stream_queries._by_period(spark, {"many": rows}, lambda stream: many.append(settings()))
        cores = str(spark.sparkContext.defaultParallelism)
        assert few == [(cores, "false"), (cores, "false"), (cores, "true")]
        assert many == [("64", "true")] * 3 and settings() == ("64", "true")
    finally:
        spark.conf.set(names[0], before[0])
