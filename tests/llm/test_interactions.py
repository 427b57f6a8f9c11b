"""Operator 12: brute force over every order, ranks by hand, and odd tables."""

import itertools
import random
import re

import numpy as np
from pyspark.sql import functions as F

from pitspark.llm import interactions

DOCS = "doc_id long, text string, source string, n long, mask string, part string"
LABELS = "doc_id long, quality int, toxic int, n string"


def brute(docs, labels):
    marks = {}
    for doc, quality, toxic, _ in labels:
        old = marks.get(doc, (False, False))
        marks[doc] = (old[0] or quality == 1, old[1] or toxic == 1)
    least = {}
    for doc, text, *_ in docs:
        key = (doc is None, doc or 0)
        least[text or ""] = min(least.get(text or "", key), key)
    judged = []
    for doc, text, source, *_ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": (doc is None, doc or 0) > least[text],
        }
        judged.append((source or "", fails, *(marks.get(doc, (False, False)) if doc is not None else (False, False))))
    out = {}
    for part in {j[0] for j in judged}:
        mine = [j for j in judged if j[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [j for j in left if j[1][f]]
                left = [j for j in left if not j[1][f]]
                shapley[f] += len(gone)
                before = [j for j in mine if j[1][f] and any(j[1][g] for g in order[: step - 1])]
                alone = [j for j in mine if [g for g in "ABCDE" if j[1][g]] == [f]]
                out[part, "".join(order), step] = [len(left), len(gone), len(before), len(alone), sum(j[2] for j in gone), sum(j[3] for j in gone), f]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return {k: tuple(v) for k, v in out.items()}


def made(n, seed):
    rng = random.Random(seed)
    texts = ["", None, "A b", "x " * 60, "Ä" * 30 + "A", " word one #", *(" ".join(f"{rng.choice('abcdXY')}{rng.randint(0, rng.choice([9, 99]))}{rng.choice(['', '', '$'])}" for _ in range(rng.randint(40, 70))) for _ in range(n // 3))]
    docs = [(rng.choice([None, i, i, i, i, i // 2]), rng.choice(texts), rng.choice([None, "", "s0", "s0", "s0", "s1"]), 1, "m", "p") for i in range(n)]
    labels = [(rng.choice([None, i]), rng.choice([None, 0, 1]), rng.choice([None, 0, 1]), "x") for i in range(0, n, 2)]
    return docs + docs[: n // 10], labels + labels[:5]


def answer(df):
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in df.collect()}


def test_against_brute_force(spark):
    docs, labels = made(240, 1)
    got = interactions.audit(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", *interactions.COUNTS]
    assert answer(got) == brute(docs, labels)


def test_removal_steps_are_the_first_failing_filter():
    orders, inverse = interactions.positions(4)
    steps = interactions.removal_steps(inverse)
    for o, order in enumerate(orders):
        for mask in range(16):
            assert steps[o, mask] == next((s for s, f in enumerate(order, 1) if mask >> f & 1), 5)


def test_counts_do_not_depend_on_the_number_of_parts():
    rng = np.random.default_rng(2)
    weights = rng.integers(0, 9, (5, 32))
    whole = interactions.step_counts(5, weights, weights, weights)
    for part in range(5):
        one = interactions.step_counts(5, *[weights[part : part + 1]] * 3)
        assert all((whole[name][part] == one[name][0]).all() for name in interactions.COUNTS)


def test_other_filters(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 5), f"s{i % 90}", 0, "", "") for i in range(900)], DOCS)
    labels = spark.createDataFrame([], LABELS)
    found = interactions.audit(docs, labels, {"S": lambda t: F.char_length(t) < 2, "L": lambda t: F.char_length(t) < 4}).collect()
    assert len(found) == 90 * 2 * 2 and {r.filter_order for r in found} == {"SL", "LS"}
    assert sum(r.removed for r in found if r.filter_order == "SL" and r.step == 1) == 360
    assert sum(r.redundant for r in found if r.filter_order == "SL" and r.step == 2) == 360


def test_hot_copies_and_odd_tables(spark):
    empty = interactions.audit(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS))
    assert empty.collect() == []
    hot = [(i, "the same text", "s", 0, "", "") for i in range(3000)] + [(5, "the same text", "s", 0, "", "")]
    docs = spark.createDataFrame(hot, DOCS)
    assert answer(interactions.audit(docs, spark.createDataFrame([(7, 1, 1, ""), (7, 1, 0, "")], LABELS))) == brute(hot, [(7, 1, 1, "")])
    long = [(1, "word " * 300_000, "s", 0, "", ""), (2, "x" * 1_000_000, None, 0, "", "")]
    assert answer(interactions.audit(spark.createDataFrame(long, DOCS), spark.createDataFrame([], LABELS))) == brute(long, [])


def test_no_shuffle_row_per_copy(spark):
    """A group of copies reaches the join on digests as a row per class, not per copy."""
    docs = spark.createDataFrame([(i, "copy", "s", 0, "", "") for i in range(2000)], DOCS)
    found = interactions.masks(docs, spark.createDataFrame([], LABELS))
    assert sorted(tuple(r) for r in found.collect()) == [("s", 1, 1, 0, 0), ("s", 17, 1999, 0, 0)]
