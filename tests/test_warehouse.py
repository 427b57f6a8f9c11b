"""Point-in-time reads and ingest: boundaries, corrections, whole-batch rejection."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pitspark.functions.reasons import ValidationError
from pitspark.operators import warehouse as wh
from pitspark.operators.cutoffs import first_cutoff, versions_at_cutoffs
from pitspark.schemas import NULLABLE, PRIMARY_KEYS, TABLES, column_names

T = datetime.fromisoformat
BAR = TABLES["market_bars"]


def at(text):
    return F.lit(text).cast("timestamp")


def bar(day, close, available, version="snapshot-v2:a", ingested=None, instrument="YF:SPY"):
    return (
        instrument, T(day), "1d", close, close, close, close, 100.0, T(available), T(ingested or available), "yahoo", version,
    )


def fact(record, value, end, start, unit, available, accession="a1", metric="Revenues"):
    return (
        record, "US:SPY", metric, start, end, value, unit, "10-Q", accession, T(available), T(available), T(available),
        "sec-companyfacts", 2024, "Q2", None, "filing_date_end_america_new_york",
    )


def macro(value, vintage, available, observation=date(2024, 1, 1), end=date(2024, 12, 31)):
    return ("CPIAUCSL", observation, value, vintage, T(available), T(available), "fred-alfred", end, "vintage_date_end_america_chicago")


def test_contracts_name_their_keys():
    for table, keys in PRIMARY_KEYS.items():
        assert set(keys) <= set(column_names(table))
        assert NULLABLE.get(table, set()) <= set(column_names(table))


def test_bars_as_of_is_inclusive_and_breaks_ties(spark):
    rows = [
        bar("2024-01-02", 10.0, "2024-01-03"),
        bar("2024-01-02", 11.0, "2024-01-05", "snapshot-v2:b"),
        bar("2024-01-02", 12.0, "2024-01-05", "snapshot-v2:c", "2024-01-06"),
        bar("2024-01-02", 99.0, "2024-01-04", "adjusted-v1"),
    ]
    df = spark.createDataFrame(rows, BAR)
    read = lambda t: [r.close for r in wh.bars_as_of(df, at(t)).collect()]
    assert read("2024-01-02 23:59:59") == []
    assert read("2024-01-03 00:00:00") == [10.0]
    assert read("2024-01-04 23:59:59") == [10.0]
    assert read("2024-01-05 00:00:00") == [12.0]


def test_reverted_correction_appends_again(spark):
    empty = spark.createDataFrame([], BAR)
    stored = empty
    for n, close in enumerate([11.0, 11.0, 5.5, 11.0]):
        batch = spark.createDataFrame([bar("2024-01-02", close, f"2024-01-0{n + 3}", f"snapshot-v2:{n}")], BAR)
        stored = stored.unionByName(wh.append_if_changed(stored, batch))
    assert sorted(r.data_version for r in stored.collect()) == ["snapshot-v2:0", "snapshot-v2:2", "snapshot-v2:3"]


def test_amendment_keeps_quarter_and_ytd_apart(spark):
    end = date(2024, 6, 30)
    rows = [
        fact("q", 10.0, end, date(2024, 4, 1), "USD", "2024-08-02T04:00:00"),
        fact("y", 20.0, end, date(2024, 1, 1), "USD", "2024-08-02T04:00:00"),
        fact("e", 9.0, end, date(2024, 4, 1), "EUR", "2024-08-02T04:00:00"),
        fact("a", 11.0, end, date(2024, 4, 1), "USD", "2024-08-11T04:00:00", "a2"),
        fact("n1", 1.0, end, None, "USD", "2024-08-02T04:00:00"),
        fact("n2", 2.0, end, None, "USD", "2024-08-03T04:00:00", "a2"),
    ]
    df = spark.createDataFrame(rows, TABLES["fundamentals"])
    read = lambda t: sorted(r.value for r in wh.fundamentals_as_of(df, at(t)).collect())
    assert read("2024-08-02 03:59:59") == []
    assert read("2024-08-03 00:00:00") == [1.0, 9.0, 10.0, 20.0]
    assert read("2024-08-12 00:00:00") == [2.0, 9.0, 11.0, 20.0]


def test_macro_revision_boundary_and_null(spark):
    rows = [
        macro(3.0, date(2024, 2, 1), "2024-02-02T06:00:00"),
        macro(3.1, date(2024, 3, 1), "2024-03-02T06:00:00"),
        macro(1.0, date(2024, 2, 1), "2024-02-02T06:00:00", date(2023, 12, 1)),
        macro(None, date(2024, 3, 1), "2024-03-02T06:00:00", date(2023, 12, 1)),
    ]
    df = spark.createDataFrame(rows, TABLES["macro_observations"])
    read = lambda t: {r.observation_date: r.value for r in wh.macro_as_of(df, at(t), "cpiaucsl").collect()}
    assert read("2024-03-02 05:59:59") == {date(2024, 1, 1): 3.0, date(2023, 12, 1): 1.0}
    assert read("2024-03-02 06:00:00") == {date(2024, 1, 1): 3.1, date(2023, 12, 1): None}


@pytest.mark.parametrize("strict", [False, True])
def test_many_cutoffs_equal_one_cutoff_at_a_time(spark, strict):
    rows = [(f"k{i % 3}", T(f"2024-01-{1 + (i * 7) % 28:02d}T{i % 24:02d}:00:00"), (i * 5) % 11, i) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, available_at timestamp, rank int, payload int")
    cuts = [T("2024-01-01T00:00:00"), T("2024-01-08T07:00:00"), T("2024-01-08T09:00:00"), T("2024-01-20T00:00:00"), T("2024-02-01T00:00:00")]
    cutoffs = spark.createDataFrame([(c,) for c in cuts], "cutoff timestamp")
    got = {
        (r.cutoff, r.k): r.payload
        for r in versions_at_cutoffs(df, cutoffs, ["k"], [F.col("rank"), F.col("payload")], strict=strict).collect()
    }
    want = {}
    for cut in cuts:
        for key in ("k0", "k1", "k2"):
            known = [(rank, p) for k, t, rank, p in rows if k == key and (t < cut if strict else t <= cut)]
            if known:
                want[(cut, key)] = max(known)[1]
    assert got == want


def test_changed_value_rejects_the_whole_batch(spark):
    end = date(2024, 6, 30)
    stored = spark.createDataFrame([fact("q", 10.0, end, None, "USD", "2024-08-02T04:00:00")], TABLES["fundamentals"])
    batch = spark.createDataFrame(
        [fact("q", 12.0, end, None, "USD", "2024-08-02T04:00:00"), fact("new", 1.0, end, None, "USD", "2024-08-02T04:00:00")],
        TABLES["fundamentals"],
    )
    with pytest.raises(ValidationError, match="changed under one record id"):
        wh.ingest_fundamentals(stored, batch)
    again = wh.ingest_fundamentals(stored, stored)
    assert again.count() == 0


def test_contract_violation_rejects(spark):
    bad = spark.createDataFrame(
        [fact("q", 1.0, date(2024, 1, 1), date(2024, 2, 1), "USD", "2024-08-02T04:00:00")], TABLES["fundamentals"]
    )
    with pytest.raises(ValidationError, match="period_start_after_end"):
        wh.ingest_fundamentals(bad.limit(0), bad)


def test_macro_merge_updates_end_only(spark):
    stored = spark.createDataFrame([macro(3.0, date(2024, 2, 1), "2024-02-02T06:00:00")], TABLES["macro_observations"])
    later = spark.createDataFrame([macro(3.0, date(2024, 2, 1), "2024-02-02T06:00:00", end=date(2025, 1, 1))], TABLES["macro_observations"])
    assert [(r.value, r.realtime_end) for r in wh.merge_macro(stored, later).collect()] == [(3.0, date(2025, 1, 1))]
    changed = spark.createDataFrame([macro(4.0, date(2024, 2, 1), "2024-02-02T06:00:00")], TABLES["macro_observations"])
    with pytest.raises(ValidationError, match="vintage value changed"):
        wh.merge_macro(stored, changed)


def test_stamp_drops_incomplete_bars(spark):
    frame = spark.createDataFrame(
        [("spy", T("2024-01-01"), 1.0, 1.0, 1.0, 1.0, 5.0), ("spy", T("2024-01-02"), 1.0, 1.0, 1.0, 1.0, 5.0)],
        "symbol string, event_time timestamp, open double, high double, low double, close double, volume double",
    )
    rows = wh.stamp_snapshot(frame, at("2024-01-02 12:00:00")).collect()
    assert len(rows) == 1 and rows[0].instrument_id == "YF:SPY"
    assert rows[0].data_version.startswith("snapshot-v2:2024-01-02T12:00:00.000000+00:00:")
    bad = frame.withColumn("high", F.lit(0.5))
    with pytest.raises(ValidationError, match="ohlc_bounds"):
        wh.require_valid_snapshot(bad)


def test_refresh_status(spark):
    one = spark.range(3)
    outcomes = wh.refresh_outcomes({"a": (one, one), "b": (one, one.limit(0))})
    assert {r.source: r.status for r in outcomes.collect()} == {"a": "UPDATED", "b": "NO_NEW_ROWS"}
    assert wh.refresh_status(outcomes).first().status == "COMPLETE"
    empty = wh.refresh_outcomes({"c": (one.limit(0), one.limit(0))})
    assert wh.refresh_status(empty).first().status == "PARTIAL"


def test_cutoffs_are_placed_without_a_shuffle_of_the_versions(spark):
    """The hours between cutoffs are bounded by the calendar; versions must not be shuffled to meet them."""
    df = spark.createDataFrame([(1, T("2024-01-05T00:30:00")), (2, T("2023-12-01")), (3, T("2024-03-01"))], "k int, available_at timestamp")
    cutoffs = spark.createDataFrame([(T("2024-01-01"),), (T("2024-02-01"),)], "cutoff timestamp")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that Spark takes for large ones
    try:
        placed = first_cutoff(df, cutoffs, "available_at")
        plan = placed._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted((r.k, r.cutoff_index) for r in placed.collect()) == [(1, 2), (2, 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
