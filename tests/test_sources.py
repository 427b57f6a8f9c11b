"""Landed documents, files, manifests and streaming jobs."""

import json
import os
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pitspark.functions.reasons import ValidationError
from pitspark.operators import ledger as lg
from pitspark.session import checkpoint_root
from pitspark.sources import bars as src
from pitspark.sources import filings, macro, news, sinks
from pitspark.streaming import jobs
from pitspark.streaming import quotes as sq

T = datetime.fromisoformat


def facts(spark, *observations, unit="USD", concept="Assets"):
    payload = json.dumps({"cik": 1, "facts": {"us-gaap": {concept: {"units": {unit: list(observations)}}}}})
    return filings.parse_company_facts(spark.createDataFrame([("spy", payload)], "ticker string, payload string"))


def obs(**c):
    base = {"start": "2024-04-01", "end": "2024-06-30", "val": 10, "accn": "a1", "fy": 2024, "fp": "Q2", "form": "10-Q", "filed": "2024-08-01"}
    return {k: v for k, v in {**base, **c}.items() if v is not ...}


def test_filing_available_next_local_midnight(spark):
    rows = facts(spark, obs(), obs(form="8-K"), obs(form="10-K/A", accn="a2", filed="2024-12-02"), obs(filed=""), obs(accn=...), obs(end=...)).orderBy("accession_number").collect()
    assert [(r.form, r.available_at) for r in rows] == [("10-Q", T("2024-08-02T04:00:00")), ("10-K/A", T("2024-12-03T05:00:00"))]
    assert rows[0].instrument_id == "US:SPY"


def test_filing_conflicts_and_validation(spark):
    merged = filings.require_facts(facts(spark, obs(), obs(frame="CY2024Q2")))
    assert merged.count() == 1
    with pytest.raises(ValidationError, match="conflicting"):
        filings.require_facts(facts(spark, obs(), obs(val=11)))
    for bad in (obs(start="2024-07-01"), obs(filed="2024-06-29"), obs(end="2024-13-01"), obs(start="x")):
        with pytest.raises(ValidationError):
            filings.require_facts(facts(spark, bad))
    assert filings.require_facts(facts(spark, obs(val=None))).first().value is None


def test_payloads_are_built_before_they_are_parsed(spark):
    """from_json is not compiled and would evaluate, row by row, whatever builds its argument."""
    documents = spark.range(4).select(F.lit("spy").alias("ticker"), F.to_json(F.struct(F.col("id"))).alias("payload"))
    plan = filings.parse_company_facts(documents)._jdf.queryExecution().executedPlan().toString()
    parsing = [line for line in plan.splitlines() if "from_json" in line]
    assert parsing and not any("StructsToJson" in line for line in parsing)


def test_documents_without_facts_and_amended_forms(spark):
    documents = spark.createDataFrame([("a", None), ("a", ""), ("a", " "), ("a", "{"), ("a", "{}")], "ticker string, payload string")
    assert filings.parse_company_facts(documents).isEmpty()
    rows = facts(spark, obs(form="20-F/A"), obs(form="20-F/A/A"), obs(form="/A"), obs(form=None), obs(form="40-F")).collect()
    assert sorted(r.form for r in rows) == ["20-F/A", "40-F"]


def page(spark, *observations):
    return macro.parse_observations(spark.createDataFrame([("dff", json.dumps({"observations": list(observations)}))], "series_id string, payload string"))


def vint(**c):
    return {"date": "2024-01-01", "realtime_start": "2024-02-01", "realtime_end": "2024-03-01", "value": "3.5", **c}


def test_macro_missing_values_and_conflicts(spark):
    rows = macro.require_observations(page(spark, vint(), vint(), vint(date="2024-01-02", value="."), vint(date="2024-01-03", value=None)))
    got = {r.observation_date.day: r.value for r in rows.collect()}
    assert got == {1: 3.5, 2: None, 3: None} and rows.first().available_at == T("2024-02-02T06:00:00")
    for bad in ([vint(), vint(value="4")], [vint(value="abc")], [vint(realtime_end="2024-01-31")], [vint(date="nope")], [vint(value="NaN")]):
        with pytest.raises(ValidationError):
            macro.require_observations(page(spark, *bad))
    kept, audit = macro.observation_window(page(spark, vint(), vint(date="2023-01-01")), F.lit("2024-01-01").cast("date"), F.lit("2024-01-15").cast("date"))
    assert kept.count() == 1 and (audit.first().excluded_before_start, audit.first().after_requested_end) == (1, 2)


def test_news_normalisation(spark):
    rows = [(1, "Head", T("2024-01-01"), T("2024-01-01"), "x", "wire", "u", ["SPY", "AAPL"]), (2, "Head", T("2024-01-03"), T("2024-01-03"), "x", "wire", "u", [])]
    df = spark.createDataFrame(rows, "id int, headline string, created_at timestamp, updated_at timestamp, author string, source string, url string, symbols array<string>")
    out = {r.event_id: r for r in news.normalise(df, F.lit("2024-01-02 12:00:00").cast("timestamp")).collect()}
    assert out["alpaca:1"].entity_ids == '["AAPL","SPY"]' and out["alpaca:1"].available_at == T("2024-01-02T12:00:00")
    assert json.loads(out["alpaca:1"].quality_flags)["historical_backfill"] is True
    assert out["alpaca:2"].available_at == T("2024-01-03") and len(out["alpaca:2"].title_hash) == 64


def write_csv(path, rows):
    with open(path, "w") as f:
        f.write("timestamp,open,high,low,close,volume\n" + "".join(",".join(map(str, r)) + "\n" for r in rows))


def test_csv_scan_keep_last_and_gates(spark, tmp_path):
    day = lambda i: f"2024-01-{i:02d}T00:00:00Z"
    write_csv(tmp_path / "INDEX_VIX.csv", [(day(1), 1, 2, 1, 1.5, 10), (day(1), 1, 2, 1, 1.7, 10), (day(2), 1, 2, 1, "", 10)])
    write_csv(tmp_path / "BTC-USD.csv", [(day(1), 1, 2, 1, 1.5, 10), (day(3), 1, 2, 1, 1.5, 10)])
    scanned = src.normalise_columns(src.read_daily_csv(spark, str(tmp_path)))
    kept = src.keep_last(scanned)
    assert {(r.symbol, r.asset_class, r.close) for r in kept.collect()} == {("^VIX", "equity", 1.7), ("BTC-USD", "crypto", 1.5)}
    done = src.completed_rows(kept, F.lit("2024-01-03 23:00:00").cast("timestamp"))
    assert {r.symbol: r.rows for r in src.describe(done).collect()} == {"^VIX": 1, "BTC-USD": 1}
    with pytest.raises(ValidationError, match="too few"):
        src.require_enough(src.describe(done))
    with pytest.raises(ValidationError):
        src.normalise_columns(scanned.withColumn("Open ", F.lit(1)))
    with pytest.raises(ValidationError, match="duplicate daily bar"):
        src.require_snapshot(scanned)
    src.require_snapshot(kept)
    with pytest.raises(ValidationError, match="row limit"):
        src.require_snapshot(kept, max_rows=1)
    flags = src.completeness(kept, F.lit("2024-01-02 00:00:00").cast("timestamp"))
    assert flags.filter("complete").count() == 2


def test_manifest_detects_tampering(spark, tmp_path):
    root = str(tmp_path / "pub")
    df = spark.range(100).withColumn("v", F.col("id") * 1.5)
    sinks.publish({"a": df, "b": df.limit(5)}, root)
    assert sinks.read_verified(spark, root, "a").count() == 100
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_new(df, f"{root}/a")
    spark.range(1).withColumn("v", F.lit(0.0)).write.mode("append").parquet(f"{root}/b")
    with pytest.raises(ValidationError, match="'b'"):
        sinks.read_verified(spark, root, "a")


def test_checkpoint_root_prefers_the_session_setting(spark):
    root = checkpoint_root(spark)
    assert checkpoint_root(spark) == root == spark.conf.get("spark.checkpoint.dir")
    assert os.path.isdir(root.removeprefix("file://"))


QUOTE = "symbol string, event_ns bigint, bid double, ask double, bid_size double, ask_size double, conditions array<string>, tape string, identity string"


def test_stream_last_state_poison_and_ambiguity(spark, tmp_path):
    base = 1788528600 * 10**9
    q = lambda s, t, bid, i: (s, base + t, bid, 101.0, 1.0, 1.0, ["R"], "A", i)
    batches = [
        [q("SPY", 1, 99.0, "a"), q("JPM", 1, 99.0, "a"), q("XOM", 5, 99.0, "a")],
        [q("SPY", 2, 105.0, "b"), q("JPM", 1, 98.0, "b"), q("XOM", 5, 99.0, "a"), q("XOM", 2, 50.0, "z")],
    ]
    path = str(tmp_path / "q")
    for rows in batches:
        spark.createDataFrame(rows, QUOTE).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(QUOTE).option("maxFilesPerTrigger", 1).parquet(path)
    out = str(tmp_path / "out")
    jobs.run_complete(sq.last_states(stream, ["symbol"]), lambda df: df.write.mode("overwrite").parquet(out), str(tmp_path / "c"))
    states = sq.state_status(spark.read.parquet(out), F.lit(base + 5 + 10**9), 1000)
    got = {r.symbol: (r.status, r.ambiguous) for r in states.collect()}
    assert got == {"SPY": ("INVALID", False), "JPM": ("INVALID", True), "XOM": ("VALID", False)}
    late = sq.state_status(spark.read.parquet(out), F.lit(base + 6 + 10**9), 1000)
    assert {r.symbol: r.status for r in late.collect()}["XOM"] == "STALE"


def test_stream_ledger_equals_batch(spark, tmp_path):
    fill = "symbol string, side string, quantity decimal(18,8), price decimal(18,8), multiplier decimal(6,0), day date, seq bigint, bin bigint"
    rows = [("A" if i % 3 else "B", "BUY" if (i * 7) % 5 < 3 else "SELL", Decimal(1 + i % 4), Decimal(90 + i % 13), Decimal(1), date(2024, 1, 1) + timedelta(days=i // 10), i, i // 4) for i in range(60)]
    path = str(tmp_path / "fills")
    for part in (rows[:20], rows[20:40], rows[40:]):
        spark.createDataFrame(part, fill).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(fill).option("maxFilesPerTrigger", 1).parquet(path)
    positions, late = str(tmp_path / "pos"), str(tmp_path / "late")
    jobs.ledger_job(stream, positions, late, str(tmp_path / "ck"), "day", "bin", ["day", "seq"]).awaitTermination()
    batch = lg.closing_positions(lg.average_cost(spark.createDataFrame(rows, fill), "day", "bin", ["day", "seq"]), "day")
    want = {r.symbol: r for r in batch.collect()}
    got = {r.symbol: r for r in jobs.newest(jobs.table(spark, positions, jobs.position_schema(stream, ["day", "seq"]))).collect()}
    assert set(got) == set(want)
    for s in want:
        assert want[s].quantity == got[s].quantity
        assert abs(want[s].realized_pnl - got[s].realized_pnl) < Decimal("1e-12") and abs(want[s].average_price - got[s].average_price) < Decimal("1e-16")
