"""Evidence packets: canonical numbers, hashes that ignore the order of rows, and every kind of tampering."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pitspark.functions.digest import canonical_number
from pitspark.functions.reasons import ValidationError
from pitspark.operators import context as ctx
from pitspark.operators import evidence as ev

T = datetime.fromisoformat
MACRO = "series_id string, observation_date date, value double, vintage_date date, available_at timestamp, ingested_at timestamp, source string, availability_basis string"
IDENTITY = "instrument_id string, symbol string, asset_class string, primary_exchange string, valid_from timestamp, valid_to timestamp, available_at timestamp, ingested_at timestamp, source string"
CUTOFF, REQUEST, LIMITS = "2024-06-01 00:00:00", '{"max_records":3}', {"macro": 3, "identity": 3}


def cutoff():
    return F.lit(CUTOFF).cast("timestamp")


@pytest.fixture()
def packet(spark):
    seen = (T("2024-03-01T00:00:00"), T("2024-03-01T01:00:00"))
    macro = [(s, date(2024, 1, d), v, date(2024, 2, 1), *seen, "fred", "b") for s, d, v in [("A", 1, 1.5), ("A", 2, None), ("B", 1, 3.0), ("B", 2, 4.0), ("B", 3, 5.0), ("B", 4, 6.0), ("C", 1, 1e-3)]]
    ids = [(i, "SPY", "us_equity", x, T("2020-01-01T00:00:00"), None, *seen, "alpaca") for i, x in [("I1", "ARCA"), ("I1", "BATS"), ("I2", None)]]
    sections = {"macro": spark.createDataFrame(macro, MACRO), "identity": spark.createDataFrame(ids, IDENTITY)}
    asked = {"macro": spark.createDataFrame([(s,) for s in "ABCD"], "series_id string"), "identity": spark.createDataFrame([("I1",), ("I2",)], "instrument_id string")}
    built = ev.build_packet(asked, sections, cutoff(), LIMITS, REQUEST)
    # an archive: rows as they were written, in another order
    keep = lambda df: spark.createDataFrame(sorted(df.collect(), key=str, reverse=True), df.schema)
    return ev.Packet({k: keep(v) for k, v in built.records.items()}, keep(built.sections), keep(built.hash))


def wrong(packet, request=REQUEST, **changes):
    changed = ev.Packet(packet.records | changes.get("records", {}), changes.get("sections", packet.sections), changes.get("hash", packet.hash))
    return {(r.section, r.entity, r.reason): r.rows for r in ev.packet_violations(changed, cutoff(), LIMITS, request).collect()}


def test_sections_and_an_intact_packet(packet):
    rows = {(r.section, r.entity): (r.status, r["count"], r.truncated, r.warnings) for r in packet.sections.collect()}
    assert rows == {
        ("macro", "A"): ("PARTIAL", 2, False, 1), ("macro", "B"): ("PARTIAL", 3, True, 1), ("macro", "C"): ("AVAILABLE", 1, False, 0), ("macro", "D"): ("MISSING", 0, False, 1),
        ("identity", "I1"): ("PARTIAL", 2, False, 1), ("identity", "I2"): ("AVAILABLE", 1, False, 0),
    }
    assert wrong(packet) == {}
    assert ev.require_intact(packet, cutoff(), LIMITS, REQUEST) is packet
    assert ev.packet_hash(packet.sections.repartition(3), REQUEST).first() == packet.hash.first()


def test_every_tampering_is_found(packet):
    macro, sections = packet.records["macro"], packet.sections
    at = (F.col("section") == "macro") & (F.col("entity") == "C")
    edit = lambda name, value: sections.withColumn(name, F.when(at, value).otherwise(F.col(name)))
    seal = ("packet", None, "packet_hash_mismatch")
    altered = macro.withColumn("value", F.when(F.col("series_id") == "C", 2.0).otherwise(F.col("value")))
    assert wrong(packet, records={"macro": altered}) == {("macro", "C", "record_hash_mismatch"): 1}
    dropped = macro.filter("NOT (series_id = 'A' AND value IS NULL)")
    assert wrong(packet, records={"macro": dropped}) == {("macro", "A", r): 1 for r in ("count_mismatch", "status_inconsistent", "warnings_inconsistent", "snapshot_hash_mismatch")}
    doubled = macro.unionByName(macro.filter("series_id = 'C'"))
    assert wrong(packet, records={"macro": doubled}) == {("macro", "C", "duplicate_record"): 2, ("macro", "C", "count_mismatch"): 1, ("macro", "C", "snapshot_hash_mismatch"): 1}
    moved = ev.with_evidence_id(macro.drop("evidence_id").withColumn("available_at", F.when(F.col("series_id") == "C", cutoff()).otherwise(F.col("available_at"))), "macro")
    assert ("macro", "C", "not_strictly_available") in wrong(packet, records={"macro": moved})
    assert wrong(packet, sections=edit("status", F.lit("MISSING"))) == {("macro", "C", "status_inconsistent"): 1, seal: 1}
    assert wrong(packet, sections=edit("warnings", F.lit(7).cast("bigint"))) == {("macro", "C", "warnings_inconsistent"): 1, seal: 1}
    assert wrong(packet, sections=edit("latest_us", F.lit(7).cast("bigint"))) == {("macro", "C", "latest_mismatch"): 1, seal: 1}
    assert ("macro", "C", "truncation_inconsistent") in wrong(packet, sections=edit("truncated", F.lit(True)))
    assert wrong(packet, sections=sections.filter(~at)) == {("macro", "C", r): 1 for r in ("section_missing", "latest_mismatch", "snapshot_hash_mismatch")} | {seal: 1}
    assert wrong(packet, request="{}") == {seal: 1}
    assert wrong(packet, hash=packet.hash.withColumn("packet_hash", F.lit("0" * 64))) == {seal: 1}
    with pytest.raises(ValidationError, match="packet_hash_mismatch"):
        ev.require_intact(packet, cutoff(), LIMITS, "{}")


def test_canonical_numbers(spark):
    cases = {1.0: "1", 100.0: "100", 0.1: "0.1", 51234.56: "51234.56", 12345678.25: "12345678.25", 0.001: "0.001", -2.5: "-2.5", 0.0: "0", 1e25: "1.0E25"}
    rows = spark.createDataFrame([(k,) for k in cases], "x double").select("x", canonical_number(F.col("x")).alias("t")).collect()
    assert {r.x: r.t for r in rows} == cases
    assert spark.createDataFrame([(None,)], "x double").select(canonical_number(F.col("x"))).first()[0] is None


BAR = "instrument_id string, event_time timestamp, interval string, open double, high double, low double, close double, volume double, available_at timestamp, ingested_at timestamp, source string, data_version string"


def test_slots_name_their_inputs(spark):
    rows = []
    for i in range(25):
        day = datetime(2024, 5, 1 + i)
        rows.append(("YF:A", day, "1d", 100.0 + i, 102.0 + i, 99.0 + i, 101.0 + i, 10.0, day.replace(hour=23), day.replace(hour=23), "yahoo", f"snapshot-v2:{i}"))
    bars = spark.createDataFrame(rows, BAR)
    section = ev.with_evidence_id(bars, "market")
    ids = [r.evidence_id for r in section.orderBy(F.desc("event_time")).collect()]
    cut = F.lit("2024-05-27 00:00:00").cast("timestamp")
    market = ctx.market_features(section, bars, cut)
    slots = {r.feature: r for r in market.collect()}
    for name, (count, _) in ctx.MARKET_FEATURES.items():
        assert slots[name].source_evidence_ids == sorted(ids[:count]) and slots[name].metadata_record_hashes == []
    assert "source_evidence_ids" not in ctx.market_features(bars, bars, cut).columns
    seen = T("2024-05-20T00:00:00")
    macro = spark.createDataFrame([(s, date(2024, 5, 20), v, date(2024, 5, 20), seen, seen, "fred", "b") for s, v in (("DFF", 5.0), ("DGS10", 4.0), ("UNRATE", None))], MACRO)
    policy = ctx.macro_policy(spark)
    metadata = policy.filter("series_id <> 'CPIAUCSL'").select("series_id", F.lit(seen).alias("observed_at"), "units", "frequency", "seasonal_adjustment")
    traced = ev.with_evidence_id(macro, "macro")
    of = {r.series_id: r.evidence_id for r in traced.collect()}
    packet = ctx.feature_packet(market, ctx.macro_features(traced, metadata, cut))
    found = {r.feature: r for r in packet.collect()}
    assert len(found) == 11 and found[ctx.SPREAD].source_evidence_ids == sorted([of["DFF"], of["DGS10"]]) and len(found[ctx.SPREAD].metadata_record_hashes) == 2
    assert found["macro.UNRATE.level"].source_evidence_ids == [of["UNRATE"]] and found["macro.UNRATE.level"].status == "MISSING_VALUE"
    assert (found["macro.CPIAUCSL.level"].source_evidence_ids, found["macro.CPIAUCSL.level"].metadata_record_hashes) == ([], [])
    base = ctx.packet_status(packet).first()
    assert base == ctx.packet_status(packet.repartition(3)).first() and base.status == "PARTIAL"
    moved = ctx.packet_status(packet.withColumn("value", F.col("value") + 1e-9)).first()
    assert moved.feature_hash != base.feature_hash and moved.lineage_hash == base.lineage_hash
    other = ctx.packet_status(packet.withColumn("source_evidence_ids", F.slice("source_evidence_ids", 1, 1))).first()
    assert other.feature_hash != base.feature_hash and other.lineage_hash != base.lineage_hash
