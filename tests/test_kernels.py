"""Kernels against brute force on small random data, hot keys included."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.functions.asof import asof_join
from pitspark.functions.quantiles import exact_quantiles
from pitspark.functions.reasons import ValidationError, first_reason, reason_array, require_zero
from pitspark.functions.scan import Running, running
from pitspark.functions.times import canonical_utc, event_ns
from pitspark.operators.metrics import roc_auc


def events(seed, n, span):
    rng = random.Random(seed)
    keys = ["hot"] * 3 + ["b", "c"]
    return [(rng.choice(keys), rng.randrange(-span, span), i, rng.choice([None, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("bin_width", [None, 7])
@pytest.mark.parametrize("direction,strict,tolerance", [("backward", False, None), ("backward", True, 5), ("forward", False, 9), ("forward", True, None)])
def test_asof_matches_brute_force(spark, bin_width, direction, strict, tolerance):
    rows = {}
    for key, t, i, _ in events(1, 120, 200):
        rows.setdefault((key, t), i)
    facts = [(k, t, i) for (k, t), i in rows.items()]
    asks = [(k, t) for k, t, _, _ in events(2, 80, 220)] + [("missing", 0)] + [(k, t) for k, t, _ in facts[:20]]
    asks = sorted(set(asks))
    ev = spark.createDataFrame(facts, "k string, t bigint, v int")
    tg = spark.createDataFrame(asks, "k string, a bigint")
    got = {
        (r.k, r.a): (r.v, r.v_at)
        for r in asof_join(tg, ev, ["k"], "a", "t", {"v": F.col("v")}, direction, strict, tolerance, bin_width=bin_width).collect()
    }
    assert len(got) == len(asks)
    for key, at in asks:
        if direction == "backward":
            options = [(t, v) for k, t, v in facts if k == key and (t < at if strict else t <= at)]
            best = max(options, default=None)
        else:
            options = [(t, v) for k, t, v in facts if k == key and (t > at if strict else t >= at)]
            best = min(options, default=None)
        if best and tolerance is not None and abs(best[0] - at) > tolerance:
            best = None
        assert got[(key, at)] == ((best[1], best[0]) if best else (None, None))


def test_asof_skips_null_per_column_but_not_structs(spark):
    ev = spark.createDataFrame([("k", 1, 10, 7), ("k", 2, None, 8)], "k string, t bigint, a int, b int")
    tg = spark.createDataFrame([("k", 3)], "k string, t0 bigint")
    row = asof_join(tg, ev, ["k"], "t0", "t", {"a": F.col("a"), "b": F.col("b"), "s": F.struct("a")}, bin_width=4).first()
    assert (row.a, row.a_at, row.b, row.s.a) == (10, 1, 8, None)


def test_asof_ignores_later_events_and_input_order(spark):
    ev = [("k", t, t) for t in range(0, 50, 5)]
    tg = spark.createDataFrame([("k", 22)], "k string, a bigint")
    base = asof_join(tg, spark.createDataFrame(ev, "k string, t bigint, v int"), ["k"], "a", "t", {"v": F.col("v")}, bin_width=4).first()
    changed = [(k, t, -1 if t > 22 else v) for k, t, v in reversed(ev)]
    other = asof_join(tg, spark.createDataFrame(changed, "k string, t bigint, v int"), ["k"], "a", "t", {"v": F.col("v")}, bin_width=4).first()
    assert base == other and base.v == 20


@pytest.mark.parametrize("how", ["sum", "max", "min", "last", "prev"])
def test_running_matches_sequential(spark, how):
    rng = random.Random(3)
    data = [("hot" if i % 3 else "x", i, rng.randrange(-9, 9)) for i in range(200)]
    df = spark.createDataFrame(data, "k string, i bigint, v bigint").selectExpr("*", "i div 40 AS outer", "i div 8 AS inner")
    got = {(r.k, r.i): r.out for r in running(df, ["k"], ["outer", "inner"], ["i"], [Running("out", F.col("v"), how)]).collect()}
    seen = {}
    for key, i, v in data:
        values = seen.setdefault(key, [])
        previous = values[-1] if values else None
        values.append(v)
        want = {"sum": sum(values), "max": max(values), "min": min(values), "last": v, "prev": previous}[how]
        assert got[(key, i)] == want


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    groups = {"hot": rng.normal(size=700).round(2), "one": np.array([4.0]), "flat": np.full(50, 2.0), "four": np.array([1.0, 2, 4, 8])}
    data = [(g, float(v)) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(data, "g string, v double")
    rows = {r.g: r for r in exact_quantiles(df, ["g"], "v", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).collect()}
    for g, values in groups.items():
        for name, p in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)):
            assert math.isclose(rows[g][name], float(np.quantile(values, p)), abs_tol=1e-12)
    assert math.isclose(rows["four"].p90, 6.8)


def test_auc_with_ties_and_one_class(spark):
    rng = random.Random(8)
    data = [("a", rng.choice([0.1, 0.4, 0.4, 0.7]), rng.randrange(2)) for _ in range(200)]
    data += [("same", 0.5, i % 2) for i in range(10)] + [("ones", 0.3, 1), ("ones", 0.4, 1)]
    got = {r.g: r.roc_auc for r in roc_auc(spark.createDataFrame(data, "g string, probability double, target int"), ["g"]).collect()}
    pos = [p for g, p, t in data if g == "a" and t]
    neg = [p for g, p, t in data if g == "a" and not t]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert math.isclose(got["a"], want) and got["same"] == 0.5 and got["ones"] is None


def test_event_ns_keeps_nanoseconds_and_rejects_naive(spark):
    texts = [
        "2026-09-04T13:30:00.123456789Z", "2026-09-04T13:30:00Z", "2026-09-04T15:30:00.5+02:00", "2026-09-04T13:30:00",
        "garbage", None, "2026-13-04T13:30:00Z", "2026-09-04T13:30:00.1234567890Z",
    ]
    base = 1788528600 * 10**9
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", event_ns(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.n for r in rows] == [base + 123456789, base, base + 500000000, None, None, None, None, None]


def test_canonical_utc(spark):
    texts = ["2024-01-01T02:00:00+02:00", "2024-01-01T00:00:00.123456Z", "2024-01-01T00:00:00", "2024-01-01T00:00:00.1234567Z"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", canonical_utc(F.col("t")).alias("u")).orderBy("i").collect()
    assert [r.u for r in rows] == ["2024-01-01T00:00:00.000000+00:00", "2024-01-01T00:00:00.123456+00:00", None, None]


def test_reasons_fail_closed(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    checks = [("negative", F.col("x") < 0), ("odd", F.col("x") % 2 != 0)]
    rows = df.select("x", reason_array(checks).alias("r"), first_reason(checks).alias("f")).collect()
    assert [(r.x, r.r, r.f) for r in rows] == [(1, ["odd"], "odd"), (None, ["negative", "odd"], "negative"), (-1, ["negative", "odd"], "negative")]
    with pytest.raises(ValidationError, match="negative: 2 rows"):
        require_zero(df, {"negative": F.col("x") < 0})
