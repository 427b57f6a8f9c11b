"""Leaf-wise trees against a brute-force grower, independence of the layout, missing values, wiring into the folds."""

import numpy as np
import pandas as pd
import pytest

from pitspark.functions.reasons import ValidationError
from pitspark.operators import boosting, models

NAMES = ["a", "b", "c"]


def made(n=400, seed=1, groups=2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 2)
    x[:, 2] = rng.integers(0, 3, n)
    y = (x[:, 0] * x[:, 1] + 0.3 * x[:, 2] + rng.normal(0, 0.5, n) > 0.2).astype(int)
    return pd.DataFrame(x, columns=NAMES).assign(target=y, g=[f"g{i % groups}" for i in range(n)])


def brute(data, s):
    """One group's trees, one split at a time over all leaves, thresholds between neighbouring values."""
    x, y = data[NAMES].to_numpy(), data["target"].to_numpy()
    cuts = [(v[:-1] + v[1:]) / 2 for v in (np.unique(c) for c in x.T)]
    raw = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    trees = []
    for _ in range(s.trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        leaves, splits = {1: np.arange(len(y))}, []
        term = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + s.l2)
        while len(leaves) < s.leaves:
            best = None
            for node, rows in sorted(leaves.items()):
                for f, thresholds in enumerate(cuts):
                    for t in thresholds:
                        left, right = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                        if min(len(left), len(right)) < s.min_rows:
                            continue
                        gain = round(term(left) + term(right) - term(rows), 9)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = gain, node, f, t, left, right
            if best is None:
                break
            gain, node, f, t, left, right = best
            del leaves[node]
            leaves[2 * node], leaves[2 * node + 1] = left, right
            splits.append((node, f, round(t, 9), round(gain, 6), len(left), len(right)))
        for rows in leaves.values():
            raw[rows] -= s.rate * g[rows].sum() / (h[rows].sum() + s.l2)
        trees.append(splits)
    return trees, 1 / (1 + np.exp(-raw))


def test_trees_match_a_brute_force_grower(spark):
    data = made()
    data = data[data.g.eq("g0")].assign(a=lambda d: np.round(d.a, 1), b=lambda d: np.round(d.b, 1))
    s = boosting.Settings(trees=3, rate=0.3, leaves=6, min_rows=12)
    fitted = boosting.fit(spark.createDataFrame(data).repartition(3), NAMES, "g", s)
    model = fitted.models["g0"]
    trees, probability = brute(data, s)
    assert [[(x.node, x.feature, round(float(model.thresholds[x.feature][x.bin]), 9), round(x.gain, 6), x.left_rows, x.right_rows) for x in t.splits] for t in model.trees] == trees
    assert np.allclose(model.probability(data[NAMES].to_numpy()), probability, atol=1e-6)


def test_layout_and_other_groups_do_not_matter(spark):
    s = boosting.Settings(trees=12, leaves=5, min_rows=10)  # beyond one rewrite of the raw scores
    data = made()
    both = boosting.fit(spark.createDataFrame(data).repartition(5), NAMES, "g", s)
    again = boosting.fit(spark.createDataFrame(data.sample(frac=1, random_state=2)).coalesce(1), NAMES, "g", s)
    alone = boosting.fit(spark.createDataFrame(data[data.g.eq("g1")]), NAMES, None, s)
    x = data[NAMES].to_numpy()
    for one, other in ((both.models["g1"], again.models["g1"]), (both.models["g1"], alone.models[0])):
        assert [t.splits for t in one.trees] == [t.splits for t in other.trees]
        assert (one.probability(x) == other.probability(x)).all()
    scored = boosting.score(both, spark.createDataFrame(data)).toPandas().sort_values(["g", *NAMES])
    want = np.where(data.g.eq("g0"), both.models["g0"].probability(x), both.models["g1"].probability(x))
    assert np.allclose(scored.probability, data.assign(p=want).sort_values(["g", *NAMES]).p)


@pytest.mark.parametrize("rows", [0, 60, 150])
def test_small_nodes_grow_the_same_trees_in_one_job(spark, monkeypatch, rows):
    s = boosting.Settings(trees=3, leaves=9, min_rows=8)
    data, jobs, search = made(), [], boosting.histograms
    monkeypatch.setattr(boosting, "histograms", lambda *a: jobs.append(a) or search(*a))
    small = boosting.fit(spark.createDataFrame(data).repartition(3), NAMES, "g", s)
    assert len(jobs) == s.trees
    monkeypatch.setattr(boosting, "SMALL_NODE", rows)
    large = boosting.fit(spark.createDataFrame(data).repartition(3), NAMES, "g", s)
    assert len(jobs) > 2 * s.trees
    for g, model in small.models.items():
        assert [t.splits for t in model.trees] == [t.splits for t in large.models[g].trees]


def test_tree_limits(spark):
    s = boosting.Settings(trees=2, leaves=7, min_rows=25)
    fitted = boosting.fit(spark.createDataFrame(made()), NAMES, "g", s)
    for model in fitted.models.values():
        for tree in model.trees:
            assert len(tree.splits) <= 6 and min(min(x.left_rows, x.right_rows) for x in tree.splits) >= 25
            gains, known = {x.node: x.gain for x in tree.splits}, [1]
            for x in tree.splits:  # best first: no waiting node that is split later gains more
                assert gains[x.node] >= max(gains.get(n, 0) for n in known)
                known = [n for n in known if n != x.node] + [2 * x.node, 2 * x.node + 1]
    assert boosting.split_table(spark, fitted).count() == sum(len(t.splits) for m in fitted.models.values() for t in m.trees)
    stump = boosting.fit(spark.createDataFrame(made()), NAMES, "g", boosting.Settings(trees=1, leaves=1))
    assert all(not t.splits for m in stump.models.values() for t in m.trees)


def test_equal_gains_go_to_the_lower_feature_and_bin(spark):
    x = [i // 10 for i in range(80)]
    data = pd.DataFrame({"a": x, "b": x, "c": x, "target": [int(v in (2, 3, 4, 5)) for v in x], "g": 0})
    fitted = boosting.fit(spark.createDataFrame(data), NAMES, "g", boosting.Settings(trees=1, leaves=2, min_rows=1))
    (split,) = fitted.models[0].trees[0].splits
    assert split.feature == 0 and fitted.models[0].thresholds[0][split.bin] == 1.5


def test_bins(spark):
    data = pd.DataFrame({"a": list(range(1000)), "b": [i % 2 for i in range(1000)], "c": [1.0] * 1000, "target": [i % 2 for i in range(1000)], "g": 0})
    rows = boosting.cuts(spark.createDataFrame(data), "g", NAMES, 10).collect()
    found = {f: sorted(r.threshold for r in rows if r.feature == f and r.threshold is not None) for f in range(3)}
    assert found == {0: [100 * k - 0.5 for k in range(1, 10)], 1: [0.5], 2: []}
    assert {r.feature: r.median for r in rows} == {0: 499.5, 1: 0.5, 2: 1.0}


def test_missing_values_count_as_the_median(spark):
    data = made()
    filled = data.copy()
    data.loc[::7, "a"] = np.nan
    for g in ("g0", "g1"):
        mine = data.g.eq(g)
        filled.loc[mine, "a"] = data.a[mine].fillna(data.a[mine].median())
    s = boosting.Settings(trees=1, leaves=4)
    gaps = boosting.fit(spark.createDataFrame(data), NAMES, "g", s)
    for g in ("g0", "g1"):
        assert gaps.models[g].medians[0] == data.a[data.g.eq(g)].median()
        x = data[data.g.eq(g)][NAMES].to_numpy()
        assert (gaps.models[g].probability(x) == gaps.models[g].probability(filled[filled.g.eq(g)][NAMES].to_numpy())).all()


def test_odd_tables(spark):
    schema = "a double, b double, c double, target int, g string"
    assert boosting.fit(spark.createDataFrame([], schema), NAMES, "g").models == {}
    with pytest.raises(ValidationError):
        boosting.fit(spark.createDataFrame([(1.0, 1.0, 1.0, 1, "x")] * 50, schema), NAMES, "g")
    with pytest.raises(ValueError):
        boosting.Settings(bins=300)


def test_signal_is_learned_out_of_sample(spark):
    data = made(3000, 5, 1)
    fitted = models.final_model(spark.createDataFrame(data[:2000]), NAMES, "gradient_boosting", trees=25)
    scored = models.score(fitted, spark.createDataFrame(data[2000:])).toPandas()
    p, y = scored.probability, scored.target
    loss = -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
    base = data[:2000].target.mean()
    assert loss < 0.85 * -(y * np.log(base) + (1 - y) * np.log(1 - base)).mean()
