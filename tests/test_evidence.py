"""Evidence sections, identity resolution and context features."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pitspark.functions.reasons import ValidationError
from pitspark.operators import context as ctx
from pitspark.operators import evidence as ev
from pitspark.operators import identity as idn
from pitspark.schemas import TABLES

T = datetime.fromisoformat
NEWS = TABLES["news_events"]
IDENTITY = TABLES["instruments"]
BAR = TABLES["market_bars"]
CUT = "2024-03-01 00:00:00"


def at(text=CUT):
    return F.lit(text).cast("timestamp")


def article(event, entities, available="2024-02-01", ingested=None):
    return (event, T(available), T(available), T(available), T(ingested or available), "wire", "a" * 64, None, entities, "{}")


def test_strict_cutoff_and_modes(spark):
    rows = [article("early", '["SPY"]'), article("equal", '["SPY"]', "2024-03-01"), article("late_ingest", '["SPY"]', "2024-02-01", "2024-03-01")]
    df = spark.createDataFrame(rows, NEWS)
    names = lambda mode: {r.event_id for r in ev.news_section(df, at(), "SPY", mode).collect()}
    assert names("local_observed") == {"early"}
    assert names("reconstructed") == {"early", "late_ingest"}


def test_exact_membership_and_malformed_entities(spark):
    df = spark.createDataFrame([article("a", '["SPY"]'), article("b", '["SPYX","spy"]'), article("c", "[]")], NEWS)
    assert {r.event_id for r in ev.news_section(df, at(), "SPY").collect()} == {"a"}
    ev.require_wellformed_entities(ev.time_eligible_news(df, at()))
    for bad in ('{"a":1}', "not json", None, '["SPY",1]', '"SPY"'):
        rows = df.unionByName(spark.createDataFrame([article("bad", bad)], NEWS))
        with pytest.raises(ValidationError):
            ev.require_wellformed_entities(ev.time_eligible_news(rows, at()))
        future = df.unionByName(spark.createDataFrame([article("bad", bad, "2024-04-01")], NEWS))
        ev.require_wellformed_entities(ev.time_eligible_news(future, at()))


def bars(n, start=date(2024, 1, 1), **changes):
    rows = []
    for i in range(n):
        day = datetime.combine(start + timedelta(days=i), datetime.min.time())
        close = changes.get("close", lambda i: 100.0 + i)(i)
        volume = changes.get("volume", lambda i: 10.0 + i)(i)
        rows.append(("YF:SPY", day, "1d", close, close + 1, close - 1, close, volume, day + timedelta(days=1, hours=1), day + timedelta(days=1, hours=2), "yahoo", f"snapshot-v2:{i}"))
    return rows


def market(spark, rows, cutoff):
    df = spark.createDataFrame(rows, BAR)
    out = ctx.market_features(ev.market_section(df, at(cutoff)), df.select("instrument_id"), at(cutoff))
    return {r.feature.split(".")[1]: r for r in out.collect()}


def test_limit_sentinel_and_summary(spark):
    df = spark.createDataFrame(bars(5), BAR)
    entities = spark.createDataFrame([("YF:SPY",), ("YF:NONE",)], "instrument_id string")
    section = ev.limited(ev.market_section(df, at()), "market", 4)
    rows = {r.entity: r for r in ev.section_summary(entities, section, "market", at(), 4).collect()}
    assert (rows["YF:SPY"].status, rows["YF:SPY"].count_ if hasattr(rows["YF:SPY"], "count_") else rows["YF:SPY"]["count"], rows["YF:SPY"].truncated) == ("PARTIAL", 4, True)
    assert rows["YF:NONE"].status == "MISSING" and rows["YF:NONE"]["count"] == 0
    full = ev.section_summary(entities, ev.limited(ev.market_section(df, at()), "market", 5), "market", at(), 5)
    assert {r.entity: r.status for r in full.collect()}["YF:SPY"] == "AVAILABLE"
    off = ev.section_summary(entities, section, "market", at(), 4, requested=False)
    assert {r.status for r in off.collect()} == {"NOT_REQUESTED"}


def test_market_features_values(spark):
    rows = market(spark, bars(25), "2024-01-27 00:00:00")
    assert rows["return_1_observed_bar"].value == pytest.approx(124 / 123 - 1)
    assert rows["return_5_observed_bars"].value == pytest.approx(124 / 119 - 1)
    assert rows["return_20_observed_bars"].value == pytest.approx(124 / 104 - 1)
    assert rows["range_fraction"].value == pytest.approx(2 / 124)
    assert rows["volume_to_mean_20_observed_bars"].value == pytest.approx(34 / (sum(range(15, 35)) / 20))
    assert {r.status for r in rows.values()} == {"AVAILABLE"}


def test_market_gates_in_order(spark):
    short = market(spark, bars(20), "2024-01-22 00:00:00")
    assert short["return_20_observed_bars"].status == "INSUFFICIENT_HISTORY"
    assert short["volume_to_mean_20_observed_bars"].status == "AVAILABLE"
    # the latest bar is 2024-01-25; seven days later is still fresh
    assert market(spark, bars(25), "2024-02-01 12:00:00")["range_fraction"].status == "AVAILABLE"
    assert market(spark, bars(25), "2024-02-02 00:00:00")["range_fraction"].status == "STALE_MARKET"
    gap = bars(10) + bars(15, date(2024, 1, 19))
    gapped = market(spark, gap, "2024-02-04 00:00:00")
    assert gapped["return_20_observed_bars"].status == "EXCESSIVE_MARKET_GAP"
    assert gapped["return_5_observed_bars"].status == "AVAILABLE"
    zero = market(spark, bars(25, volume=lambda i: 0.0), "2024-01-27 00:00:00")
    assert zero["volume_to_mean_20_observed_bars"].status == "ZERO_DENOMINATOR"
    assert market(spark, bars(25), "2023-01-01 00:00:00")["range_fraction"].status == "INSUFFICIENT_HISTORY"


def macro_rows(spark, rows):
    return spark.createDataFrame(
        [(s, d, v, d, T(a), T(a), "fred-alfred", date(2025, 1, 1), "vintage_date_end_america_chicago") for s, d, v, a in rows],
        TABLES["macro_observations"],
    )


def levels(spark, rows, metadata, cutoff="2024-03-01 00:00:00"):
    meta = spark.createDataFrame(
        [(s, T(o), *ctx.MACRO_POLICY[s][:3]) if u is None else (s, T(o), u, *ctx.MACRO_POLICY[s][1:3]) for s, o, u in metadata],
        "series_id string, observed_at timestamp, units string, frequency string, seasonal_adjustment string",
    )
    section = ev.macro_section(macro_rows(spark, rows), at(cutoff), list(ctx.MACRO_POLICY))
    return {r.feature: r for r in ctx.macro_features(section, meta, at(cutoff)).collect()}


def test_macro_levels_and_spread(spark):
    rows = [("DFF", date(2024, 2, 27), 3.75, "2024-02-28"), ("DGS10", date(2024, 2, 27), 4.15, "2024-02-28"),
            ("CPIAUCSL", date(2024, 1, 1), 326.5, "2024-02-20"), ("UNRATE", date(2024, 1, 1), 4.0, "2024-02-01"), ("UNRATE", date(2024, 2, 1), None, "2024-02-20")]
    meta = [(s, "2024-02-20", None) for s in ("DFF", "DGS10", "CPIAUCSL")] + [("UNRATE", "2024-02-20", None)]
    out = levels(spark, rows, meta)
    assert out["macro.DFF.level"].value == 3.75 and out["macro.CPIAUCSL.level"].value == 326.5
    assert out["macro.UNRATE.level"].status == "MISSING_VALUE"
    assert out[ctx.SPREAD].value == pytest.approx(0.4)


def test_macro_gates_in_order(spark):
    fresh = [("DFF", date(2024, 2, 27), 3.75, "2024-02-28"), ("DGS10", date(2024, 2, 26), 4.15, "2024-02-28"), ("CPIAUCSL", date(2023, 11, 1), 1.0, "2024-02-01")]
    meta = [("DFF", "2024-01-31", None), ("DGS10", "2024-02-20", None), ("CPIAUCSL", "2024-02-20", "Percent")]
    out = levels(spark, fresh, meta)
    assert out["macro.DFF.level"].status == "AVAILABLE"  # metadata exactly thirty days old
    assert out[ctx.SPREAD].status == "OBSERVATION_DATE_MISMATCH"
    assert out["macro.CPIAUCSL.level"].status == "DEFINITION_MISMATCH"
    assert out["macro.UNRATE.level"].status == "MISSING_METADATA"
    old = levels(spark, [("DFF", date(2024, 2, 20), 1.0, "2024-02-22 23:59:59")], [("DFF", "2024-02-28", None), ("DGS10", "2024-01-30", None), ("UNRATE", "2024-02-28", None)])
    assert old["macro.DFF.level"].status == "STALE_OBSERVATION"
    assert old["macro.DGS10.level"].status == "STALE_METADATA"
    assert old["macro.UNRATE.level"].status == "MISSING_OBSERVATION"
    assert old[ctx.SPREAD].status == "INPUT_BLOCKED"
    aged = levels(spark, [("DFF", date(2024, 2, 20), 1.0, "2024-02-23")], [("DFF", "2024-02-28", None)])
    assert aged["macro.DFF.level"].status == "STALE_OBSERVATION_DATE"


def assertion(instrument, symbol, exchange="XNYS", start="2024-01-01", end=None, source="yahoo", asset="equity"):
    return (instrument, symbol, asset, exchange, T(start), T(end) if end else None, T("2024-01-02"), T("2024-01-02"), source)


def test_identity_statuses(spark):
    rows = [
        assertion("YF:A", "A"), assertion("YF:B", "B"), assertion("YF:B", "B", start="2024-01-05"),
        assertion("YF:C", "C"), assertion("YF:C", "C", None), assertion("YF:D", "D", end="2024-03-01"), assertion("YF:E", "E"),
    ]
    df = spark.createDataFrame(rows, IDENTITY)
    section = ev.identity_section(df, at())
    cut = spark.createDataFrame([("YF:E",)], "instrument_id string")
    out = {r.instrument_id: r for r in idn.resolve(idn.require_assertions(section, at()), df, cut).collect()}
    assert {k: v.status for k, v in out.items()} == {
        "YF:A": "SINGLE_ASSERTION", "YF:B": "EQUIVALENT_ASSERTIONS", "YF:C": "AMBIGUOUS", "YF:D": "MISSING", "YF:E": "TRUNCATED",
    }
    assert out["YF:C"].resolved is None and out["YF:A"].resolved.symbol == "A"
    doubled = section.unionByName(section)
    with pytest.raises(ValidationError, match="duplicate identity assertion"):
        idn.require_assertions(doubled, at())
    with pytest.raises(ValidationError, match="not_strictly_known"):
        idn.require_assertions(section, at("2024-01-02 00:00:00"))


def test_records_that_assert_the_same_are_told_apart_by_their_key(spark):
    rows = [(*assertion("YF:A", "A"), 1), (*assertion("YF:A", "A"), 2), (*assertion("YF:B", "B"), 3)]
    df = spark.createDataFrame(rows, IDENTITY + ", record long")
    kept = idn.require_assertions(ev.identity_section(df, at()), at(), record=("record",))
    out = {r.instrument_id: (r.status, r.assertion_count) for r in idn.resolve(kept, df).collect()}
    assert out == {"YF:A": ("EQUIVALENT_ASSERTIONS", 2), "YF:B": ("SINGLE_ASSERTION", 1)}
    with pytest.raises(ValidationError, match="duplicate identity assertion"):
        idn.require_assertions(kept.unionByName(kept), at(), record=("record",))


def test_binding_and_mask(spark):
    df = spark.createDataFrame([assertion("YF:A", "A"), assertion("YF:B", "X"), assertion("YF:C", "C", asset="crypto")], IDENTITY)
    resolved = idn.resolve(ev.identity_section(df, at()), df)
    out = {r.instrument_id: r.binding_status for r in idn.binding(resolved, resolved, at("2024-02-01 00:00:00"), at()).collect()}
    assert out == {"YF:A": "MATCHED_SOURCE_DESCRIPTION", "YF:B": "UNSUPPORTED_SOURCE_OR_ASSET", "YF:C": "UNSUPPORTED_SOURCE_OR_ASSET"}
    late = idn.binding(resolved, resolved, at(), at())
    assert {r.binding_status for r in late.collect()} == {"CATALOG_UNAVAILABLE_AT_CUTOFF"}
    features = spark.createDataFrame([("YF:B", "market.x", "AVAILABLE", 1.0), ("YF:B", "macro.y", "AVAILABLE", 2.0)], "instrument_id string, feature string, status string, value double")
    masked = {r.feature: r for r in idn.mask_market(features, idn.binding(resolved, resolved, at("2024-02-01 00:00:00"), at())).collect()}
    assert (masked["market.x"].status, masked["market.x"].value, masked["market.x"].unmasked_status) == ("IDENTITY_BLOCKED", None, "AVAILABLE")
    assert masked["macro.y"].value == 2.0
    assert idn.resolution_mismatches(resolved, resolved).count() == 0


def test_packet_hash_ignores_order_and_sees_tampering(spark):
    df = spark.createDataFrame(bars(6), BAR)
    section = ev.market_section(df, at())
    records = ev.packet_records({"market": section})
    shuffled = ev.packet_records({"market": section.repartition(3).orderBy(F.desc("close"))})
    digest = lambda d: ev.snapshot_hash(d).first().snapshot_hash
    assert digest(records) == digest(shuffled)
    changed = ev.packet_records({"market": section.withColumn("close", F.col("close") + 1e-9)})
    assert digest(records) != digest(changed)
    assert ev.packet_mismatches(records, shuffled).count() == 0
    assert ev.packet_mismatches(records, changed).count() == 12
