"""Operators 4, 7 and 8 against the tokenizers library and brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pitspark.llm import packing, storage, tokens, training_order
from pitspark.llm import textarrays as ta
from pitspark.llm.bpe import Bpe, default_path

SCHEMA = "doc_id long, text string, ids string, `length` string"
HARD = [
    None, "", " ", "  a", "a  ", "\n\n\nfoo", "it's 'll'llama 'S 'st", "a<|endoftext|>b <|endoftext|>", "日本語 é ß ½ Ⅷ ́",
    "x  y", "a\r\n b", "1a2 b3", "\x00\x1c\x85", "😀😀", "a" * 3000, " " * 2000, "!?" * 700, "the cat sat. " * 900,
]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def ints(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_encode_equals_library(spark, library):
    rng = random.Random(3)
    parts = ["a", "s", "t", "re", "ve", "ll", "'", " ", "  ", "\n", "\t", "　", "1", "é", "日", "!", "...", "<|endoftext|>", "😀", "aaa"]
    texts = HARD + ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)]
    df = frame(spark, texts + texts[:3])
    coded = tokens.encode(df)
    rows = sorted(coded.collect())
    for row, text in zip(rows, texts + texts[:3], strict=True):
        assert ints(row.ids) == ids_of(library, text) and row.n_tokens * 4 == len(row.ids), text
    back = {r.doc_id: r.text for r in tokens.decode(coded).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts + texts[:3])}


def test_every_code_point_class(library):
    for low in range(0, 0x110000, 0x8000):
        texts = [f"a{c}1 {c}{c}b{c}" for c in map(chr, range(low, min(low + 0x8000, 0x110000), 7)) if not 0xD800 <= ord(c) < 0xE000]
        bpe = Bpe.load(default_path())
        got = []
        for _, data, offsets in ta.blocks(pa.table({"text": pa.array(texts, pa.string())}).to_batches()):
            ids, at = bpe.encode(data, offsets)
            got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_small_memory_of_words(monkeypatch, library):
    monkeypatch.setattr("pitspark.llm.bpe._SLOTS", 1 << 3)
    monkeypatch.setattr("pitspark.llm.bpe._POOL", 64)
    bpe = Bpe(default_path())
    rng = random.Random(1)
    for _ in range(30):
        text = " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(40))
        data = np.frombuffer(text.encode(), np.uint8)
        assert bpe.encode(data, np.array([0, len(data)]))[0].tolist() == ids_of(library, text)


def test_decode_bad_ids(spark):
    df = spark.createDataFrame([(1, np.array([50256, 999999, 0], "<u4").tobytes()), (2, None)], "k long, ids binary")
    assert {r.k: r.text for r in tokens.decode(df).collect()} == {1: "<|endoftext|>!", 2: ""}


def test_empty_table(spark):
    df = frame(spark, [])
    assert tokens.digests(df).count() == 0
    assert packing.packed_documents(df).count() == 0
    assert training_order.ordered_sequences(df).count() == 0


def test_null_doc_id(spark):
    df = spark.createDataFrame([(None, "a b"), (None, None), (5, "c")], "doc_id long, text string")
    assert tokens.digests(df).count() == 3
    assert packing.packed_documents(df).count() == 3
    rows = training_order.ordered_sequences(df).collect()
    assert sorted(r.slot for r in rows) == [0, 1, 2] and Counter(r.doc_id for r in rows) == {None: 2, 5: 1}


def test_pieces(spark, library):
    texts = [*HARD, "word " * 1022, "word " * 1023, "word " * 1024, "word " * 5000]
    rows = sorted(packing.pieces(frame(spark, texts), 1024).collect())
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, text in enumerate(texts):
        want = [*ids_of(library, text), 2]
        assert sum((ints(r.ids) for r in by[i]), []) == want
        assert [r.piece for r in by[i]] == list(range(-(-len(want) // 1024)))
        assert [r.start for r in by[i]] == np.cumsum([0, *[r.length for r in by[i]]])[:-1].tolist()
        assert all(r.length == 1024 for r in by[i][1:]) and by[i][0].length <= 1024


@pytest.mark.parametrize("seed", range(30))
def test_plan_places_every_count(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 64, 1024])
    histogram = {rng.randint(1, capacity): rng.randint(0, 400) for _ in range(rng.randint(0, 90))}
    used, ranks = defaultdict(list), defaultdict(set)
    for length, rank, count, sequence, offset in packing.plan(histogram, capacity):
        for k in range(count):
            used[sequence + k].append((offset, length))
            assert rank + k not in ranks[length]
            ranks[length].add(rank + k)
    assert {n: len(r) for n, r in ranks.items()} == {n: c for n, c in histogram.items() if c}
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    # as few as plain best fit over single pieces
    free = []
    for length in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fit = min((r for r in free if r >= length), default=None)
        if fit is not None:
            free.remove(fit)
        free.append((capacity if fit is None else fit) - length)
    assert len(used) <= len(free)


def test_plan_refuses_lengths():
    with pytest.raises(ValueError):
        packing.plan({5: 1}, 4)


def test_pack_takes_each_slot_once(spark):
    rng = random.Random(5)
    sizes = [7] * 300 + [rng.randint(1, 10) for _ in range(300)]
    df = storage.stored(spark.createDataFrame([(i % 500, n, "x") for i, n in enumerate(sizes)], "doc_id long, length long, rank string"), "t")
    rows = packing.pack(df, ["doc_id"], 10).collect()
    assert Counter(r.length for r in rows) == Counter(sizes) and {r["rank"] for r in rows} == {"x"}
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 10


@pytest.mark.parametrize("size", [1, 2, 3, 17, 1000, 65537])
def test_permutation(size):
    index = np.arange(size)
    a, b = training_order.permute(index, size, 1), training_order.permute(index, size, 2)
    assert sorted(a.tolist()) == index.tolist() == sorted(b.tolist())
    assert size < 100 or (a != b).mean() > 0.9


def test_training_order(spark, library):
    texts = [*HARD, *[f"doc {i} " * (i % 400) for i in range(300)]]
    df = frame(spark, [*texts, texts[0]])
    folder = storage.new_folder(spark, "t")
    manifest = training_order.write_shards(df, folder, shard_bytes=60_000)
    assert manifest.count() > 3
    rows = sorted(training_order.read_slots(spark, manifest).collect())
    assert [r.slot for r in rows] == list(range(len(rows)))
    parts = defaultdict(list)
    for r in rows:
        parts[r.doc_id].append((r.piece, ints(r.ids)))
        assert r.n_tokens * 4 == len(r.ids)
    for i, text in enumerate([*texts, texts[0]]):
        assert sum((p for _, p in sorted(parts[i])), []) == [*ids_of(library, text), 2]
    again = sorted(training_order.read_slots(spark, training_order.write_shards(df.repartition(7), folder, shard_bytes=60_000)).collect())
    assert again == rows
    later = sorted(training_order.read_slots(spark, manifest, start=100, stop=140).collect())
    assert later == rows[100:140]
    ids = [r.doc_id for r in rows]
    assert sum(a > b for a, b in zip(ids[:-1], ids[1:], strict=True)) > len(ids) / 4


def test_training_order_far_ids(spark):
    df = spark.createDataFrame([(-(1 << 62), "a"), (1 << 62, "b " * 2000), (None, "c"), (3, None)], "doc_id long, text string")
    rows = training_order.ordered_sequences(df).collect()
    assert {r.doc_id for r in rows} == {-(1 << 62), 1 << 62, None, 3} and sorted(r.slot for r in rows) == list(range(len(rows)))
    assert {r.ids_crc32 for r in rows if r.doc_id == 3} == {zlib.crc32(np.array([2], "<u4").tobytes())}
