"""The pipeline's repeated-string stage: passages of over 50 words, whatever their bytes, against brute force."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from pitspark.llm import repeats

from .test_pipeline import SCHEMA

WORDS = 51


def brute(texts):
    """Texts without strings of 400 bytes (ASCII) and passages of 51 words that occur twice."""
    at = [[i for i, c in enumerate(t) if not c.isspace() and (not i or t[i - 1].isspace())] for t in texts]
    words = [t.split() for t in texts]
    bytes_seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    words_seen = Counter(tuple(w[i : i + WORDS]) for w in words for i in range(len(w) - WORDS + 1))
    out = []
    for t, w, starts in zip(texts, words, at, strict=True):
        gone, bounds = set(), [0, *starts[1:], len(t)]
        for i in range(len(t) - 399):
            if bytes_seen[t[i : i + 400]] > 1:
                gone |= set(range(i, i + 400))
        for i in range(len(w) - WORDS + 1):
            if words_seen[tuple(w[i : i + WORDS])] > 1:
                gone |= set(range(bounds[i], bounds[i + WORDS]))
        out.append("".join(c for i, c in enumerate(t) if i not in gone))
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda most=9: "".join(rng.choices("etaoinshrdlu", k=rng.randint(1, most)))
    prose = lambda n, most=9: " ".join(word(most) for _ in range(n))
    texts = []
    for n in [*range(51, 61), 51, 51]:
        passage = prose(n, rng.choice([2, 5, 9]))
        for _ in range(rng.choice([2, 2, 3])):
            texts.append(f"{prose(rng.randint(1, 80))} {passage} {prose(rng.randint(1, 80))}")
    short = prose(50, 2)  # one word too short: both stay
    texts += [f"{prose(20)} {short} {prose(20)}" for _ in range(2)]
    letters = " ".join(rng.choices("abcdefgh", k=51))  # 101 bytes
    texts += [letters, f"  {letters}", f"{prose(9)} {letters}", letters.replace(" ", "\n") + " " + prose(30)]
    base = prose(130).split()  # overlapping parts of one passage; parts of 40 to 50 words repeat often but stay
    for _ in range(12):
        a = rng.randint(0, 80)
        texts.append(f"{prose(3)} {' '.join(base[a : a + rng.randint(40, 75)])} {prose(3)}")
    long = prose(3, 9).replace(" ", "") + "x" * 390
    same = prose(70)
    return [*texts, f"{prose(4)} {long}", f"{prose(4)} {long}", same, same, "", " \n", prose(60) + "  "]


@pytest.mark.parametrize("largest", [repeats.LARGEST, 3])
def test_short_passages_go(spark, monkeypatch, largest):
    monkeypatch.setattr(repeats, "LARGEST", largest)
    monkeypatch.setattr(repeats, "TOGETHER", 16)
    texts = corpus(largest)
    want = brute(texts)
    assert sum(a != b for a, b in zip(texts, want, strict=True)) > 25
    df = spark.createDataFrame([(i, t, "xx", "src", len(t)) for i, t in enumerate(texts)], SCHEMA)
    rows = sorted(corpus_pipeline.repeated_strings(spark, df, "").collect())
    assert [(r.text, r.n_chars) for r in rows] == [(t, len(t)) for t in want]
