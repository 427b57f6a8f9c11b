"""Partition merges that leave other files alone, and batches that appear at once or not at all."""

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from pitspark.functions.reasons import ValidationError
from pitspark.operators import warehouse as wh
from pitspark.schemas import TABLES
from pitspark.sources import sinks

T = datetime.fromisoformat


def macro(spark, rows):
    fields = [f.strip().split(" ")[0] for f in TABLES["macro_observations"].split(",")]
    seen = T("2024-06-01T00:00:00")
    made = []
    for series, day, value, end in rows:
        known = {"series_id": series, "observation_date": day, "value": value, "vintage_date": date(2024, 5, 1), "available_at": seen, "ingested_at": seen, "source": "fred", "realtime_end": end, "availability_basis": "b"}
        made.append(tuple(known[f] for f in fields))
    return spark.createDataFrame(made, TABLES["macro_observations"])


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_merge_replaces_touched_partitions_only(spark, tmp_path):
    root, end = str(tmp_path / "macro"), date(2024, 12, 31)
    rows = [(s, date(y, 1, 1), 1.0 * y, end) for s in ("A", "B") for y in (2022, 2023, 2024)]
    start = macro(spark, rows)
    wh.write_macro(start, root)
    before = files(root)
    later = date(2025, 1, 31)
    wh.merge_macro_into(root, macro(spark, [("A", date(2023, 1, 1), 2023.0, later), ("A", date(2023, 2, 1), 5.0, end), ("C", date(2023, 1, 1), 7.0, end)]))
    after = files(root)
    assert {f for f in before if "series_id=A/period=2023" not in f} <= after
    assert not {f for f in before if "series_id=A/period=2023" in f} & after
    got = {(r.series_id, r.observation_date): (r.value, r.realtime_end) for r in wh.read_macro(spark, root, start.schema.fields).collect()}
    want = {(s, d): (v, e) for s, d, v, e in rows} | {("A", date(2023, 1, 1)): (2023.0, later), ("A", date(2023, 2, 1)): (5.0, end), ("C", date(2023, 1, 1)): (7.0, end)}
    assert got == want
    with pytest.raises(ValidationError):
        wh.merge_macro_into(root, macro(spark, [("B", date(2022, 1, 1), 9.0, end)]))
    assert files(root) == after


def test_a_batch_appears_at_once(spark, tmp_path):
    root = str(tmp_path / "batches")
    data = spark.range(6).withColumn("v", F.col("id") * 0.5)
    names = spark.createDataFrame([("a", 1), ("b", 2)], "alias string, id int")
    assert sinks.publish_batch({"data": data, "aliases": names}, root, "r1") == 1
    assert sorted(map(tuple, sinks.read_batch(spark, root, "aliases", names.schema).collect())) == [("a", 1), ("b", 2)]

    def broken(batches):
        for batch in batches:
            raise RuntimeError("killed")
            yield batch

    with pytest.raises(Exception, match="killed"):
        sinks.publish_batch({"data": data.mapInArrow(broken, data.schema), "aliases": names.limit(0)}, root, "r2")
    assert {r.version for r in sinks.pointers(spark, root).collect()} == {1}
    assert sinks.read_batch(spark, root, "aliases", names.schema).count() == 2 and sinks.read_batch(spark, root, "data", data.schema).count() == 6
    # the root is usable, and an empty part is a part
    assert sinks.publish_batch({"data": data.limit(2), "aliases": names.limit(0)}, root, "r3") == 2
    assert sinks.read_batch(spark, root, "data", data.schema).count() == 2 and sinks.read_batch(spark, root, "aliases", names.schema).count() == 0
    assert sinks.read_batch(spark, root, "data", data.schema, version=1).count() == 6
    audit = {(r.version, r.part): (r.request, r.rows) for r in sinks.pointers(spark, root).collect()}
    assert audit == {(1, "data"): ("r1", 6), (1, "aliases"): ("r1", 2), (2, "data"): ("r3", 2), (2, "aliases"): ("r3", 0)}
    with pytest.raises(ValidationError, match="no published"):
        sinks.read_batch(spark, root, "other", names.schema)


def test_a_second_writer_is_noticed(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "batches")
    rows = spark.range(3)
    monkeypatch.setattr(sinks, "_newest", lambda spark, root: 0)  # both saw the same state
    assert sinks.publish_batch({"d": rows}, root, "one") == 1
    with pytest.raises(ValidationError, match="another writer"):
        sinks.publish_batch({"d": rows}, root, "two")
