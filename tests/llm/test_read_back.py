"""Written shards and archives are read back by as many tasks as their bytes ask for."""

from pyspark.sql import functions as F

from pitspark.llm import storage, training_order, warc


def test_shards_are_read_by_ranges(spark, monkeypatch):
    monkeypatch.setattr(storage, "READ_BYTES", 1 << 16)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), F.col("id").cast("string"), F.lit(" ")), 100).alias("text"))
    manifest = training_order.write_shards(docs, storage.new_folder(spark, "shards"))
    read = training_order.read_slots(spark, manifest)
    assert read.rdd.getNumPartitions() >= 5
    rows = read.select("slot", "doc_id", "piece").collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and {r.doc_id for r in rows} == set(range(400))
    part = training_order.read_slots(spark, manifest, start=7, stop=91).select("slot", "doc_id", "piece").collect()
    assert sorted(map(tuple, part)) == sorted(tuple(r) for r in rows if 7 <= r.slot < 91)
    assert training_order.read_slots(spark, manifest.limit(0)).count() == 0


def test_archives_are_read_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(storage, "READ_BYTES", 1 << 14)
    pages = spark.range(300).select(F.col("id").alias("page_id"), F.lit("http://a/").alias("url"), F.concat(*[F.sha2(F.concat(F.lit(str(k)), F.col("id").cast("string")), 256) for k in range(20)]).alias("html"))
    packages = warc.write_packages(pages.repartition(4), storage.new_folder(spark, "packages"), package_bytes=1 << 14)
    located = warc.locate(packages, block_bytes=1 << 13)
    assert 2 <= located.rdd.getNumPartitions() <= packages.count()  # no more tasks than packages
    records = warc.read_records(located)
    assert records.rdd.getNumPartitions() >= 5
    assert {r.page_id: r.n for r in records.select("page_id", F.length("payload").alias("n")).collect()} == dict.fromkeys(range(300), 1280)
    assert warc.read_records(warc.locate(packages.limit(0))).count() == 0
