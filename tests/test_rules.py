"""Rules that were wrong or untested before: element types, optional fields, gates, cutoffs, nested bins, purged folds."""

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from pitspark.functions import quantiles
from pitspark.functions.reasons import ValidationError
from pitspark.operators import cutoffs as cut
from pitspark.operators import evidence as ev
from pitspark.operators import metrics as met
from pitspark.operators import models
from pitspark.operators import quality as ql
from pitspark.operators import study as st
from pitspark.operators import walkforward as wf
from pitspark.sources import marketdata as md


def test_entities_and_flags(spark):
    texts = {'["a","b"]': False, "[]": False, "[null]": True, '["a",null]': True, '["a",1]': True, '{"a":1}': True, '"a"': True, "[": True, None: True, "": True}
    rows = spark.createDataFrame([(t,) for t in texts], "entity_ids string").withColumn("bad", ev.entities_malformed()).collect()
    assert {r.entity_ids: r.bad for r in rows} == texts
    flags = {"{}": False, '{"a":true}': False, "[]": True, "null": True, "x": True, None: True}
    rows = spark.createDataFrame([(t,) for t in flags], "quality_flags string").withColumn("bad", ev.flags_malformed()).collect()
    assert {r.quality_flags: r.bad for r in rows} == flags


def test_optional_bar_fields_keep_their_type(spark):
    minute = "2024-01-02T15:00:00Z"
    extras = {"": None, ', "n": 3, "vw": 1.5': None, ', "n": "x"': "nonnumeric_value", ', "n": true': "nonnumeric_value", ', "vw": true': "nonnumeric_value", ', "n": null': "nonnumeric_value", ', "n": 1.5': "noninteger_trade_count"}
    payload = '{{"symbol":"SPY","records":[{{"t":"{}","o":1,"h":2,"l":1,"c":1,"v":0{}}}]}}'
    pages = spark.createDataFrame([("SPY", k, payload.format(minute, x)) for k, x in enumerate(extras)], "symbol string, k int, payload string")
    records = md.parse_bars(pages).withColumns({"start_ns": F.lit(0).cast("bigint"), "end_ns": F.lit(1 << 62)})
    got = {r.k: r.reason for r in ql.classify_bars(records).collect()}
    assert [got[k] for k in range(len(extras))] == list(extras.values())


def test_second_symbol_and_condition_shape(spark):
    record = '{{"symbol":"SPY","records":[{{"t":"2024-01-02T15:00:00Z","bp":1,"ap":2,"bs":1,"as":1{}}}]}}'
    cases = [', "symbol":"SPY","S":"JPM","c":["R"]', ', "S":"SPY","c":"R"', ', "symbol":"JPM"', ', "c":[1]', ', "c":["R","X"]']
    pages = spark.createDataFrame([("SPY", k, record.format(x)) for k, x in enumerate(cases)], "symbol string, k int, payload string")
    rows = {r.k: r for r in md.parse_quotes(pages).collect()}
    assert [rows[k].record_symbol for k in range(5)] == ["JPM", "SPY", "JPM", None, None]
    assert [rows[k].conditions_shape for k in range(5)] == ["list_of_strings", "malformed", "missing", "malformed", "list_of_strings"]
    assert rows[4].conditions == ["R", "X"] and rows[1].conditions is None


def test_mixed_feeds_have_no_usable_windows(spark):
    cols = "symbol string, window_name string, feed string, usable boolean, distribution_usable boolean, full_spread_bps double, received_count int, complete boolean, invalid_count int, source_reasons array<string>, timely_valid_quote_count int, ambiguous boolean"
    row = lambda feed: ("SPY", "opening", feed, True, True, 2.0, 1, True, 0, ["fetch_incomplete_or_truncated"], 1, False)
    one = st.aggregate_windows(spark.createDataFrame([row("sip"), row(None)], cols)).first()
    two = st.aggregate_windows(spark.createDataFrame([row("sip"), row("iex")], cols)).first()
    assert (one.usable_selected_samples, one.usable_distribution_samples, one.selected_spread_median) == (2, 2, 2.0)
    assert (two.expected_samples, two.usable_selected_samples, two.unusable_selected_samples, two.usable_distribution_samples) == (2, 0, 2, 0)
    assert two.unusable_source_window_count == 2 and two.invalid_source_metadata_window_count == 0


def _predictions(spark, rows):
    return spark.createDataFrame(rows, "symbol string, d date, fold int, probability double, base_probability double, target_return double, target int")


def test_evaluate_refuses_bad_predictions(spark):
    good = [("A", date(2024, 1, k), 1, 0.6, 0.5, 0.01 * (-1) ** k, k % 2) for k in range(1, 9)]
    assert met.evaluate(_predictions(spark, good), 5.0).first().rows == 8
    with pytest.raises(ValidationError):
        met.evaluate(_predictions(spark, [*good, good[0]]), 5.0)
    with pytest.raises(ValidationError):
        met.evaluate(_predictions(spark, [*good, ("A", date(2024, 1, 20), 1, 1.5, 0.5, 0.0, 0)]), 5.0)
    with pytest.raises(ValidationError):
        met.evaluate(_predictions(spark, [*good, ("A", date(2024, 1, 20), 1, 0.9, 0.5, -1.0, 0)]), 5.0)


@pytest.mark.parametrize("strict", [False, True])
def test_first_cutoff_is_the_first_that_knows(spark, strict):
    rng = random.Random(3)
    base = datetime(2024, 1, 1)
    cuts = sorted({base + timedelta(minutes=rng.randint(0, 9000)) for _ in range(40)})
    rows = [(k, base + timedelta(minutes=rng.randint(-5000, 9500))) for k in range(300)] + [(1000 + k, c) for k, c in enumerate(cuts)]
    got = {
        r.k: r.cutoff_index
        for r in cut.first_cutoff(spark.createDataFrame(rows, "k int, t timestamp"), spark.createDataFrame([(c,) for c in cuts], "cutoff timestamp"), "t", strict).collect()
    }
    want = {k: next(i for i, c in enumerate(cuts, 1) if (t < c if strict else t <= c)) for k, t in rows if (t < cuts[-1] if strict else t <= cuts[-1])}
    assert got == want


def test_quantiles_with_nested_bins(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "_LARGE", 3)
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=4000), np.full(700, 0.25), rng.exponential(size=1500) * 50])
    df = spark.createDataFrame([("a" if k % 3 else "b", float(v)) for k, v in enumerate(values)], "g string, v double")
    rows = {r.g: r for r in quantiles.exact_quantiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    for g in "ab":
        own = [v for k, v in enumerate(values) if ("a" if k % 3 else "b") == g]
        assert np.allclose([rows[g].p10, rows[g].p50, rows[g].p99], np.quantile(own, [0.1, 0.5, 0.99]), rtol=1e-12)


def test_walk_forward_trains_on_known_labels_only(spark):
    rng = random.Random(1)
    rows = []
    for k in range(60):
        day = datetime(2024, 1, 1) + timedelta(days=k)
        for symbol, lag in (("A", 1), ("B", 12)):
            x = rng.gauss(0, 1)
            rows.append((symbol, day.date(), x, rng.gauss(0, 1), int(x + rng.gauss(0, 0.5) > 0), day + timedelta(minutes=30), day + timedelta(days=lag)))
    data = spark.createDataFrame(rows, "symbol string, target_session date, f1 double, f2 double, target int, decision_at timestamp, label_available_at timestamp")
    protocol = wf.Protocol(min_train=20, test=15, purge=5, max_folds=2)
    out = models.walk_forward(data, ["f1", "f2"], protocol, ["base_rate", "logistic"]).collect()
    for fold in (1, 2):
        first = 60 - 15 * (3 - fold)
        decision = datetime(2024, 1, 1) + timedelta(days=first, minutes=30)
        train = [r for r in rows if (r[1] - date(2024, 1, 1)).days < first - 5 and r[6] < decision]
        own = [r for r in out if r.fold == fold]
        assert {r.train_rows for r in own} == {len(train)} and {r.last_label_available_at for r in own} == {max(r[6] for r in train)}
        assert {round(r.base_probability, 9) for r in own} == {round(sum(r[4] for r in train) / len(train), 9)}
        for model in ("base_rate", "logistic"):
            keys = [(r.symbol, r.target_session) for r in own if r.model == model]
            assert len(keys) == len(set(keys)) == 30
    hits = [(r.probability >= 0.5) == (r.target == 1) for r in out if r.model == "logistic"]
    assert sum(hits) / len(hits) > 0.75
