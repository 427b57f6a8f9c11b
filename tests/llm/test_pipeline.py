"""The pipeline against the brute-force versions of its stages, one after another."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pitspark.llm import ngram_join
from pitspark.llm.bpe import default_path

from . import test_ngram_join, test_repeats, test_texts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("etaoinshrdlucmé", k=rng.randint(1, 9))) for _ in range(2500)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    passage = prose(130)
    out = [None, "", "too short", "spam " * 300, "x" * 3000]
    for _ in range(45):
        text = prose(rng.choice([25, 60, 150, 400]))
        if rng.random() < 0.3:
            text += " " + passage
        out.append(text)
        for _ in range(rng.choice([0, 0, 0, 1, 3])):
            words = text.split(" ")
            words[rng.randrange(len(words))] = "changed"
            out.append(" ".join(words))
        if rng.random() < 0.1:
            out.append(text)
    return [(i, t, "xx", "src", len(t or "")) for i, t in enumerate(out)]


def test_stages_equal_brute_force(spark, tmp_path):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, str(tmp_path))
        made.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "quality rules":
            want = {i: t for i, t in want.items() if test_texts.brute_quality(t)[-1]}
        elif name == "n-gram Jaccard join":
            ids = sorted(want)
            groups = test_ngram_join.brute([want[i] for i in ids], 5, 80)
            want = {i: want[i] for i, (k, _, first) in zip(ids, groups, strict=True) if k == first}
        elif name == "suffix-array dedup":
            assert {r.doc_id: len(r.text) for r in docs.collect()} == {r.doc_id: r.n_chars for r in docs.collect()}
            got = {r.doc_id: r.text for r in docs.collect()}
            ids = sorted(want)
            for i, (_, n, removed, _, _) in zip(ids, test_repeats.brute([want[i] for i in ids]), strict=True):
                left = len(got[i].encode())
                assert left == n - removed if not removed else n - removed - 12 <= left <= n - removed
            assert sum(len(t) for t in want.values()) > sum(map(len, got.values()))
            want = got
        if name != "best-fit packing":
            assert docs.columns == df.columns and {r.doc_id: r.text for r in docs.collect()} == want and docs.count() == len(want)
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(default_path())
    pieces, places = defaultdict(int), defaultdict(list)
    for r in docs.collect():
        pieces[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert pieces == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in want.items()}
    for spans in places.values():
        assert np.cumsum([0, *[n for _, n in sorted(spans)]])[:-1].tolist() == [at for at, _ in sorted(spans)]
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect()) == sorted(docs.select("doc_id", "piece", "ids_crc32").collect())


def test_representatives_of_repeated_rows(spark):
    same = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(7, same), (7, same), (9, same), (None, same), (None, "only null has this text"), (None, "only null has this text"), (3, None), (3, ""), (7, "another text under the id"), (12, "lonely words")]
    df = spark.createDataFrame([(i, t, "a", "b", 0) for i, t in rows], SCHEMA)
    kept = sorted(((r.doc_id is None, r.doc_id or 0, r.text or "") for r in ngram_join.representatives(df).collect()))
    assert kept == sorted([(False, 3, ""), (False, 3, ""), (False, 7, same), (False, 7, "another text under the id"), (False, 12, "lonely words"), (True, 0, "only null has this text")])


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_empty_table(spark, stage):
    assert stage[1](spark, spark.createDataFrame([], SCHEMA), "").count() == 0


def test_extra_columns_stay(spark):
    df = spark.createDataFrame(documents()[:30], SCHEMA).withColumns({"key": F.lit("k"), "label": F.lit(1), "_row": F.lit("r"), "component_id": F.lit(0), "_spans": F.lit(2)})
    for _, stage in corpus_pipeline.STAGES[:3]:
        assert stage(spark, df, "").columns == df.columns and stage(spark, df, "").count() <= 30
