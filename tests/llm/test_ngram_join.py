"""Operator 1 against brute force over all pairs."""

import random
import re

import pytest

from pitspark.llm import components, ngram_join

SCHEMA = "doc_id long, text string, key string, n string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, size, percent):
    sets = []
    for text in texts:
        w = words(text)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in enumerate(texts)], SCHEMA)


def corpus(seed, n=260):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeÉß", k=rng.randint(1, 6))) for _ in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=25))
    out = [None, "", " \n", "One", "one", "ONE two three", "one two three", "a a a a a a a a", "a a a a a"]
    while len(out) < n:
        base = rng.choices(vocabulary, k=rng.choice([3, 8, 20, 60, 200]))
        if rng.random() < 0.4:
            base += passage.split()
        for _ in range(rng.choice([1, 1, 1, 3, 12])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "\n", "\t "]).join(copy) if rng.random() < 0.8 else " ".join(copy).upper())
    return out


@pytest.mark.parametrize("size,percent", [(4, 85), (5, 80)])
def test_groups_equal_brute_force(spark, size, percent):
    texts = corpus(size)
    rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.groups(frame(spark, texts), size, percent).collect())
    assert rows == brute(texts, size, percent)


def test_large_group_in_parts(spark, monkeypatch):
    """Members of one group spread over many parts of a round; the complete round misses none."""
    monkeypatch.setattr(ngram_join, "PART", 6)
    monkeypatch.setattr(ngram_join, "TRIES", 1)
    monkeypatch.setattr(ngram_join, "ROUNDS", 1)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(120):
        copy = list(base)
        for _ in range(rng.randint(0, 2)):
            copy[rng.randrange(60)] = f"x{rng.randint(0, 5)}"
        texts.append(" ".join(copy))
    texts += corpus(9, 60)
    rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.groups(frame(spark, texts), 4, 85).collect())
    assert rows == brute(texts, 4, 85)


def test_odd_tables(spark):
    assert ngram_join.groups(frame(spark, [])).count() == 0
    same = "the quick brown fox jumps over the lazy dog"
    df = spark.createDataFrame([(None, same), (None, same + " x"), (7, same), (7, same), (None, None), (3, "alone here")], "doc_id long, text string")
    rows = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.groups(df, 4, 80).collect()))
    assert rows == [(0, 0, 0), (0, 6, 7), (0, 7, 7), (3, 1, 3), (7, 6, 7), (7, 6, 7)]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 70)] + [(rng.randint(100, 400), rng.randint(100, 400)) for _ in range(220)] + [(5, 5), (1000, 1001), (1001, 1000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_texts_are_not_shuffled(spark, monkeypatch):
    """The texts of sets that stay are picked by a filter while they are read, whatever the size of the list of sets."""
    plans, write = [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or write(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = corpus(3, 80)
        rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.groups(frame(spark, texts), 4, 85).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == brute(texts, 4, 85)
    (plan,) = [plan for name, plan in plans if name == "alive-sets"]
    assert plan.count("SortMergeJoin") == 1  # the sets with their list, none of texts


def test_pairs_of_a_large_group_are_cut_before_they_are_made(spark, monkeypatch):
    """Copies that share n-grams of their prefixes but differ too much: few pairs get through to be verified."""
    counts, verified = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda pairs, sets, percent: counts.append(pairs.count()) or verified(pairs, sets, percent))
    rng = random.Random(4)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for k in range(120):
        copy = list(base)
        for at in rng.sample(range(4, 146, 4), 2):  # eight n-grams of its own; two copies may differ in 11 each
            copy[at] = f"x{k}-{at}"
        texts.append(" ".join(copy))
    rows = sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.groups(frame(spark, texts), 4, 85).collect())
    assert rows == brute(texts, 4, 85)
    assert sum(counts) < 1000  # of 7,140
