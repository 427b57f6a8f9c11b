"""Operators 6 and 10 against brute force."""

import hashlib
import random
import re
import string

import pytest
import zstandard

from pitspark.llm import phrases, quality

SCHEMA = "doc_id long, text string, ratio string, bin string"
RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choices("etaoinshrdlucmé", k=RNG.randint(1, 9))) for _ in range(900)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) + RNG.choice(["", "", "", ",", ".\n"]) for _ in range(n))


TEXTS = [
    None, "", " \n\t", "one", "a b\n\n a b\na b\n \n \nx", "x\x0by\x0cz\x1dq\x85r", prose(19), prose(20), prose(300), prose(6000), prose(40) + "\n" + prose(30),
    (p := prose(60)) + " " + p, "spam " * 400, "\n".join(["same line here"] * 30), "".join(RNG.choices(string.ascii_letters + string.digits + "     ", k=9000)),
    prose(1500) + " " + "".join(RNG.choices(string.printable, k=9000)), "### $$$ %%% &&& ||| <<< >>> ***", "é ü 日本語 😀 " * 3, prose(8), prose(200) + " a" * 3000,
]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)} if len(windows) < 2500 else None
    if covered is None:
        from collections import Counter

        n = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)

    def fits(raw):
        ratio = len(raw) / len(zstandard.ZstdCompressor(level=3).compress(raw)) if raw else 1.0
        low, high = [(a, b) for n, a, b in quality.BANDS if n <= len(raw)][-1]
        return low <= ratio <= high

    raw = text.encode()
    chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)] if len(raw) > 4096 else []
    bad = sum(len(c) for c in chunks if not fits(c))
    kept = not failed and fits(raw) and bad <= 0.25 * len(raw)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed, kept)


def test_quality_equals_brute_force(spark):
    texts = TEXTS + [" ".join(RNG.choices("abcd", k=RNG.randint(0, 60))) for _ in range(200)]
    rows = sorted(quality.judge(frame(spark, texts)).collect())
    for row, text in zip(rows, texts, strict=True):
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words, row.base_failed, row.kept) == brute_quality(text), (text or "")[:80]
    kept = {r.doc_id for r in rows if r.kept}
    assert {7, 8, 9, 10} <= kept and not kept & {0, 1, 2, 3, 6, 11, 12, 13, 14, 15, 19}
    df = frame(spark, texts)
    assert sorted(quality.keep(df).collect()) == sorted(r for r in df.collect() if r.doc_id in kept)


def test_quality_empty_and_null_ids(spark):
    assert quality.judge(frame(spark, [])).count() == 0 and quality.keep(frame(spark, [])).count() == 0
    rows = quality.judge(spark.createDataFrame([(None, prose(50)), (None, prose(50))], "doc_id long, text string")).collect()
    assert [r.kept for r in rows] == [True, True]


def brute_phrases(raw):
    known, start = set(), 0
    out = set()
    for end in range(1, len(raw) + 1):
        if raw[start:end] not in known:
            known.add(raw[start:end])
            out.add(raw[start:end])
            start = end
    return out


def test_parse_is_lz78():
    for _ in range(300):
        raw = bytes(RNG.choices(b"abc", k=RNG.randint(0, 80)))
        other = bytes(RNG.choices(b"abc", k=RNG.randint(0, 40)))
        fork = RNG.randint(0, len(raw))
        for text, ends in zip((raw, raw[:fork] + other), phrases.parse(raw, fork, other), strict=True):
            cut = [text[a:b] for a, b in zip([0, *ends][: len(ends)], ends, strict=True)]
            assert b"".join(cut) == text and set(cut) == brute_phrases(text)
        assert phrases.parse(raw)[0] == phrases.parse(raw, len(raw), b"")[0]


def test_likeness_estimates_jaccard():
    for share in (0.0, 0.3, 0.6, 0.9, 1.0):
        raw = prose(3000).encode()
        other = raw[: int(len(raw) * share)] + prose(3000).encode()[int(len(raw) * share) :]
        a, b = brute_phrases(raw), brute_phrases(other)
        sig = phrases.signatures([raw, other], [phrases.parse(raw)[0], phrases.parse(other)[0]])
        assert abs(phrases.likeness(sig[:1], sig[1:])[0] - len(a & b) / len(a | b)) < 0.12


def edited(texts):
    out = {}
    order = sorted(range(len(texts)), reverse=True)
    for k, i in enumerate(order):
        text, following = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        out[i] = text[: len(text) - half] + following[:half]
    return out


@pytest.mark.parametrize("count", [1, 2, len(TEXTS) * 3])
def test_edited_fingerprints(spark, count):
    texts = [*TEXTS[::-1], *TEXTS, *TEXTS][:count]
    rows = sorted(phrases.edited_fingerprints(frame(spark, texts)).collect())
    want = edited(texts)
    plain = {r.doc_id: r.fingerprint for r in phrases.fingerprints(frame(spark, texts)).collect()}
    again = {r.doc_id: r.fingerprint for r in phrases.fingerprints(frame(spark, [want[i] for i in range(len(texts))])).collect()}
    assert [r.doc_id for r in rows] == list(range(len(texts)))
    for r in rows:
        assert r.n_chars == len(texts[r.doc_id] or "") and r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        assert r.fingerprint == plain[r.doc_id] and r.edited_fingerprint == again[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if r.fingerprint == r.edited_fingerprint:
            assert r.near_edited == 1
    same = {}
    for r in rows:
        assert same.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint


def test_near_edited_exceeds_near_next(spark):
    texts = [prose(800) for _ in range(40)]
    rows = phrases.edited_fingerprints(frame(spark, texts)).collect()
    assert all(r.near_edited > r.near_next + 0.1 for r in rows)


def test_fingerprint_odd_tables(spark):
    assert phrases.edited_fingerprints(frame(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "abc"), (None, "abd"), (4, "x"), (4, "x"), (4, None), (-9, "yy")], "doc_id long, text string")
    rows = phrases.edited_fingerprints(df).collect()
    got = sorted((r.doc_id is None, -(r.doc_id or 0), r.n_chars) for r in rows)
    assert got == [(False, -4, 0), (False, -4, 1), (False, -4, 1), (False, 9, 2), (True, 0, 3), (True, 0, 3)]
    by = {r.doc_id: r for r in rows if r.doc_id == -9}
    assert by[-9].edited_sha256 == hashlib.sha256(b"ya").hexdigest()
