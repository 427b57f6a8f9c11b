"""Operator 9 against brute force over all strings of 400 bytes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.llm import bloom, repeats

SCHEMA = "doc_id long, text string, lang string, spans string, _ref0 string"
N = repeats.LENGTH


def brute(texts):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + N] for r in raw for i in range(len(r) - N + 1))
    out = []
    for k, r in enumerate(raw):
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - N + 1):
            if seen[r[i : i + N]] > 1:
                gone[i + 1 : i + N + 1] = True
        left = bytes(b for b, g in zip(r, gone[1:], strict=False) if not g)
        runs = int((gone[1:] & ~gone[:-1]).sum())
        out.append((k, len(r), len(r) - len(left), runs, hashlib.sha256(left).hexdigest()))
    return out


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "xx", "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefg éß日\n"
    text = lambda n: "".join(rng.choices(letters, k=n))
    passage, other = text(900), text(450)
    out = [None, "", "short", text(399), text(400)]
    for _ in range(14):
        a, b = rng.randint(0, 500), rng.randint(350, 900)
        out.append(text(rng.randint(0, 300)) + passage[a : a + b] + text(rng.randint(0, 300)))
    out += [text(50) + other + text(700) + other, other + text(9), text(9) + other]  # in one text; at either end
    same = text(1000)
    out += [same, same, same[:700], same[200:], same[:500] + "X" + same[501:]]
    out += ["a" * 1500, "b" * 399, "b" * 400, "c" * 401, "ab" * 700, ("xyz" + "a" * 300) * 4, text(100) + "a" * 600]
    edge = "".join(rng.choices("pq", k=N))
    out += [edge, edge[1:] + "p", "q" + edge, edge[:200] + "!" + edge[200:]]
    for _ in range(10):  # equal left and right surroundings in different combinations
        left, right, seed_bytes = ["L" * 150 + "l" * rng.randint(0, 60), text(200)][rng.random() < 0.3], ["R" * rng.randint(100, 250), text(250)][rng.random() < 0.3], passage[100:330]
        out.append(text(5) + left + seed_bytes + right)
    return out


@pytest.mark.parametrize("largest", [repeats.LARGEST, 3])
def test_equals_brute_force(spark, monkeypatch, largest):
    monkeypatch.setattr(repeats, "LARGEST", largest)
    monkeypatch.setattr(repeats, "TOGETHER", 16)
    texts = corpus(largest)
    rows = sorted(tuple(r)[:5] for r in repeats.removed_digests(frame(spark, texts)).collect())
    assert rows == brute(texts)


def test_spans_of_one_group():
    """All combinations of left and right extensions, against a count of every string."""
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 12)
        pool = ["".join(rng.choices("ab", k=repeats.SIDE)).encode() for _ in range(3)]
        side = lambda: (p := bytearray(rng.choice(pool)), [p.__setitem__(rng.randrange(len(p)), 99) for _ in range(rng.randint(0, 2))], bytes(p)[: rng.choice([0, 60, 150, 199, 199, 199])])[2]
        left, right = [side() for _ in range(n)], [side() for _ in range(n)]
        group = np.sort(np.array(rng.choices([0, 1], k=n)))
        strings = {i: {j: (int(group[i]), j, left[i][:j], right[i][: repeats.SIDE - j]) for j in range(N - repeats.SEED + 1) if len(left[i]) >= j and len(right[i]) >= repeats.SIDE - j} for i in range(n)}
        seen = Counter(s for by in strings.values() for s in by.values())
        want = {i: {b for j, s in by.items() if seen[s] > 1 for b in range(-j, N - j)} for i, by in strings.items()}
        got = {i: set() for i in range(n)}
        for i, start, end in repeats.repeated_spans(left, right, group):
            got[i] |= set(range(start, end))
        assert got == want


def test_merge_sort():
    rng = random.Random(6)
    values = ["".join(rng.choices("ab", k=rng.choice([0, 1, 5, 199]))).encode() for _ in range(500)]
    size = np.array([1, 0, 7, 128, 300, 64])
    order = repeats.merge_sort(repeats.Strings(values), np.cumsum(size) - size, size)
    at = 0
    for n in size:
        assert [values[i] for i in order[at : at + n]] == sorted(values[at : at + n])
        at += n


def test_remove_keeps_columns(spark):
    texts = corpus(77)
    df = frame(spark, texts)
    rows = sorted(repeats.remove(df).collect())
    assert df.columns == list(rows[0].asDict())
    for r, text, (_, n, removed, _, sha) in zip(rows, texts, brute(texts), strict=True):
        if not removed:
            assert r.text == text
        elif (text or "").isascii():
            assert hashlib.sha256(r.text.encode()).hexdigest() == sha
        else:
            assert n - removed - 6 <= len(r.text.encode()) <= n - removed


def test_odd_tables(spark):
    assert repeats.removed_digests(frame(spark, [])).count() == 0 and repeats.remove(frame(spark, [])).count() == 0
    long = "".join(random.Random(1).choices("abcd", k=900))
    df = spark.createDataFrame([(None, long), (None, long), (4, "z" + long[:500]), (4, None)], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in repeats.removed_digests(df).collect()))
    assert rows == [(0, 900, 900, 1), (0, 900, 900, 1), (4, 0, 0, 0), (4, 501, 500, 1)]


def test_bloom(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 - 20000).alias("k"))
    bits = bloom.build(df, "k")
    assert bloom.may_have(bits, np.arange(5000) * 7919 - 20000).all()
    assert bloom.may_have(bits, np.arange(10**9, 10**9 + 10000)).mean() < 0.01
    values = np.array([0, -5, 123456789])
    spark_hash = [r[0] for r in spark.createDataFrame([(int(v),) for v in values], "v long").select(F.xxhash64("v", "v")).collect()]
    assert bloom.xxhash64(values, bloom.xxhash64(values)).tolist() == spark_hash


def test_digests_come_with_the_text_left(spark):
    texts = corpus(5)
    rows = sorted(repeats.removed_digests(frame(spark, texts)).select("doc_id", "n_left", "kept_sha256", "n_removed", "text").collect())
    left = [r.text for r in sorted(repeats.remove(frame(spark, texts)).select("doc_id", "text").collect())]
    for r, text, want in zip(rows, texts, left, strict=True):
        assert r.text == (want or "")
        if (text or "").isascii():
            assert (len(r.text), hashlib.sha256(r.text.encode()).hexdigest()) == (r.n_left, r.kept_sha256)
        if not r.n_removed:
            assert r.text == (text or "")
