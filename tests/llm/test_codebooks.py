"""Operator 13: cover trees against brute force, the whole quantisation against plain integers, odd tables."""

import hashlib
import random

import numpy as np
import pytest

from pitspark.llm import codebooks

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, trees string, code string"


def plain(rows, parts=4, entries=256, rounds=4):
    """The contract with Python integers."""
    kept = [(i, [int(np.floor(1024 * float(x))) for x in v], y) for i, v, y, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    kept = [r for r in kept if r[1] and len(r[1]) % parts == 0]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    if not kept:
        return set()
    width = len(kept[0][1]) // parts
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    books = [[cut(r[1])[p] for r in kept[:entries]] for p in range(parts)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda piece, book: min((apart(piece, c), i) for i, c in enumerate(book))
    for _ in range(rounds):
        for p, book in enumerate(books):
            pieces = [cut(r[1])[p] for r in kept]
            to = [near(x, book)[1] for x in pieces]
            for e in set(to):
                own = [x for x, t in zip(pieces, to, strict=True) if t == e]
                book[e] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    found, totals = [], {}
    for i, v, y in kept:
        each = [near(x, books[p]) for p, x in enumerate(cut(v))]
        error = sum(d for d, _ in each)
        totals[y] = totals.get(y, 0) + error
        found.append((i, "".join(f"{e:02x}" for _, e in each), error, y))
    return sorted(((i, c, e, totals[y], sha) for i, c, e, y in found), key=str)


def rows(n, seed, size=16, copies=0):
    rng = random.Random(seed)
    middle = [[rng.uniform(-0.5, 0.5) for _ in range(size)] for _ in range(6)]
    out = [(i * 7 % n, [float(np.float32(m + rng.gauss(0, 0.1))) for m in rng.choice(middle)], rng.choice([None, 0, 0, 1, 2]), "v", "t", "c") for i in range(n)]
    return out + [(n + i, out[0][1], 1, "v", "t", "c") for i in range(copies)]


def answer(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("seed", range(6))
def test_tree_assigns_exactly(seed):
    rng = np.random.default_rng(seed)
    points = rng.integers(-9, 9, (600, 3 + seed)) if seed % 2 else (rng.normal(0, 300, (600, 8)) + 2000 * rng.integers(0, 4, (600, 1))).astype(np.int64)
    entries = np.concatenate([points[:20], points[5:9], rng.integers(-20, 20, (9, points.shape[1]))])
    tree = codebooks.build(points)
    nearest = codebooks.assign(tree, entries)
    brute = ((points[:, None] - entries[None]) ** 2).sum(2).argmin(1)
    assert (nearest[tree.row] == brute).all()
    total = codebooks.sums(tree, nearest, len(entries))
    for e in range(len(entries)):
        assert (total[e, :-1] == points[brute == e].sum(0)).all() and total[e, -1] == (brute == e).sum()


def test_tree_is_a_cover_tree():
    points = np.random.default_rng(1).integers(-500, 500, (800, 4))
    tree = codebooks.build(points)
    assert (tree.points[tree.row] == points).all() and tree.counts.sum() == 800
    for node in tree.nodes:
        inside = tree.points[node["low"] : node["high"]]
        assert np.isclose(np.sqrt(((inside - inside[0]) ** 2).sum(1)).max(), node["radius"])
        kids = tree.nodes[node["child"] : node["child"] + node["children"]]
        if len(kids):
            assert kids["low"][0] == node["low"] and kids["high"][-1] == node["high"] and (kids["low"][1:] == kids["high"][:-1]).all()
            centres = tree.points[kids["low"]]
            away = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2))[~np.eye(len(kids), dtype=bool)]
            assert away.min(initial=np.inf) > node["radius"] / codebooks.SHRINK >= kids["radius"].max()


def test_whole_subtrees_are_assigned(monkeypatch):
    """Far clusters are settled at inner nodes: few points are compared one by one."""
    rng = np.random.default_rng(4)
    middle = rng.integers(-50_000, 50_000, (12, 8))
    points = (middle[rng.integers(0, 12, 2000)] + rng.integers(-20, 20, (2000, 8))).astype(np.int64)
    tree, seen, real = codebooks.build(points), [], codebooks.squares
    monkeypatch.setattr(codebooks, "squares", lambda a, b: seen.append(len(a)) or real(a, b))
    nearest = codebooks.assign(tree, middle)
    assert (nearest[tree.row] == ((points[:, None] - middle[None]) ** 2).sum(2).argmin(1)).all()
    assert sum(seen) < 200


def test_copies_are_one_point():
    tree = codebooks.build(np.tile(np.arange(8), (5000, 1)))
    assert len(tree.points) == 1 and tree.counts[0] == 5000 and len(tree.nodes) == 1


def test_large_components_stay_exact():
    points = np.array([[2**27 - 1, -(2**27)], [2**27 - 2, -(2**27)], [0, 0]], np.int64)
    assert codebooks.squares(points, points)[0].tolist() == [0, 1, (2**27 - 1) ** 2 + 2**54]


@pytest.mark.parametrize("case", [(90, 3, 16, 0, 8), (400, 5, 8, 150, 256), (300, 6, 4, 0, 40)])
def test_against_plain_integers(spark, case):
    n, seed, size, copies, entries = case
    data = rows(n, seed, size, copies)
    got = codebooks.coded(spark.createDataFrame(data, SCHEMA).repartition(3), entries=entries, rounds=3)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert answer(got) == plain(data, entries=entries, rounds=3)


def test_blocks_do_not_matter(spark, monkeypatch):
    data = rows(300, 8)
    monkeypatch.setattr(codebooks, "BLOCK_ROWS", 64)
    assert answer(codebooks.coded(spark.createDataFrame(data, SCHEMA).coalesce(2), entries=20)) == plain(data, entries=20)


def test_odd_tables(spark):
    assert codebooks.coded(spark.createDataFrame([], SCHEMA)).collect() == []
    bad = [(1, None, 1, "", "", ""), (2, [], 1, "", "", ""), (3, [0.5] * 7 + [None], 1, "", "", ""), (4, [float("nan")] * 8, 1, "", "", ""), (5, [float("-inf")] * 8, 1, "", "", ""), (6, [0.5] * 6, 1, "", "", "")]
    assert codebooks.coded(spark.createDataFrame(bad, SCHEMA)).collect() == []
    good = [(7, [-0.0001, 0.25, 1.0, -2.0, 3.5, 1e-9, -1e-9, 0.0], None, "", "", ""), (None, [0.5] * 8, None, "", "", ""), (7, [0.5] * 8, 2, "", "", ""), (8, [0.5] * 12, 2, "", "", "")]
    data = bad + good + good[:1]
    assert answer(codebooks.coded(spark.createDataFrame(data, SCHEMA))) == plain(data)
    with pytest.raises(Exception, match="beyond"):
        codebooks.coded(spark.createDataFrame([(1, [3e38] * 4, 1, "", "", "")], SCHEMA)).collect()
