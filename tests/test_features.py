"""Daily features, regime attach, sessions, timing, folds and portfolio metrics."""

import math
from datetime import date, datetime, timedelta

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitspark.functions.reasons import ValidationError
from pitspark.operators import features as feat
from pitspark.operators import metrics as met
from pitspark.operators import regime as reg
from pitspark.operators import sessions as ses
from pitspark.operators import timing
from pitspark.operators import walkforward as wf

T = datetime.fromisoformat
BARS = "symbol string, d date, open double, high double, low double, close double, volume double"


def weekdays(start, n):
    out, day = [], start
    while len(out) < n:
        if day.weekday() < 5:
            out.append(day)
        day += timedelta(days=1)
    return out


def bar_rows(symbol, days, close=lambda i: 100 + i * 0.1 + math.sin(i / 5), volume=lambda i: 1e6 + 100 * i):
    return [(symbol, d, close(i) - 0.05, close(i) + 0.3, close(i) - 0.3, float(close(i)), float(volume(i))) for i, d in enumerate(days)]


def expected_features(rows):
    f = pd.DataFrame(rows, columns=["symbol", "d", "open", "high", "low", "close", "volume"])
    c, v, r = f.close, f.volume, f.close.pct_change()
    out = pd.DataFrame({"return_1": r, "return_5": c.pct_change(5), "return_20": c.pct_change(20)})
    out["volatility_5"], out["volatility_20"] = r.rolling(5).std(), r.rolling(20).std()
    out["ma_gap_5"], out["ma_gap_20"] = c / c.rolling(5).mean() - 1, c / c.rolling(20).mean() - 1
    out["range_pct"] = (f.high - f.low) / c
    out["volume_z20"] = (v - v.rolling(20).mean()) / v.rolling(20).std()
    diff = c.diff()
    up, down = diff.clip(lower=0).rolling(14).mean(), (-diff).clip(lower=0).rolling(14).mean()
    out["rsi_14"] = 100 - 100 / (1 + up / down)
    return out


def test_raw_features_match_pandas(spark):
    rows = bar_rows("SPY", weekdays(date(2020, 1, 1), 60))
    got = feat.raw_features(spark.createDataFrame(rows, BARS)).orderBy("d").toPandas()
    want = expected_features(rows)
    for name in feat.FEATURE_COLUMNS:
        np.testing.assert_allclose(got[name].astype(float), want[name], rtol=1e-8, atol=1e-9, err_msg=name)


def test_shift_label_and_future_perturbation(spark):
    days = weekdays(date(2020, 1, 1), 50)
    rows = bar_rows("SPY", days)
    base = {r.d: r for r in feat.daily_dataset(spark.createDataFrame(rows, BARS)).collect()}
    raw = {r.d: r for r in feat.raw_features(spark.createDataFrame(rows, BARS)).collect()}
    assert min(base) == days[21] and base[days[30]].return_5 == raw[days[29]].return_5
    cut = 40
    changed = rows[:cut] + [(s, d, o * 3, h * 9, lo, c * 3, v) for s, d, o, h, lo, c, v in rows[cut:]]
    moved = {r.d: r for r in feat.daily_dataset(spark.createDataFrame(list(reversed(changed)), BARS)).collect()}
    for d in days[21:cut]:
        assert moved[d] == base[d]
    # the first changed day still has untouched features, only its label moved
    assert moved[days[cut]].rsi_14 == base[days[cut]].rsi_14


def test_rsi_extremes_and_zero_variance(spark):
    days = weekdays(date(2020, 1, 1), 30)
    up = bar_rows("UP", days, lambda i: 100.0 + i, lambda i: 5.0)
    flat = bar_rows("FLAT", days, lambda i: 100.0)
    out = feat.raw_features(spark.createDataFrame(up + flat, BARS)).filter(F.col("d") == days[-1]).collect()
    by = {r.symbol: r for r in out}
    assert by["UP"].rsi_14 == 100.0 and by["FLAT"].rsi_14 == 50.0 and by["UP"].volume_z20 is None


def test_bar_validation(spark):
    rows = bar_rows("SPY", weekdays(date(2020, 1, 1), 5))
    feat.validate_daily_bars(spark.createDataFrame(rows, BARS))
    for bad in (rows[0], ("SPY", date(2021, 1, 1), 1.0, 0.5, 0.4, 1.0, 1.0), ("SPY", date(2021, 1, 1), 1.0, float("inf"), 0.5, 1.0, 1.0), ("SPY", date(2021, 1, 1), 1.0, 1.0, 1.0, None, 1.0)):
        with pytest.raises(ValidationError):
            feat.validate_daily_bars(spark.createDataFrame(rows + [bad], BARS))


def test_latest_snapshot_flags_incomplete(spark):
    rows = bar_rows("LONG", weekdays(date(2020, 1, 1), 30)) + bar_rows("SHORT", weekdays(date(2020, 1, 1), 10))
    out = {r.symbol: r.complete for r in feat.latest_snapshot(spark.createDataFrame(rows, BARS)).collect()}
    assert out == {"LONG": True, "SHORT": False}
    with pytest.raises(ValidationError):
        feat.require_complete(feat.latest_snapshot(spark.createDataFrame(rows, BARS)))


def context(days):
    rows = []
    for n, s in enumerate(reg.CONTEXT_SYMBOLS):
        rows += bar_rows(s, days, lambda i, n=n: 50.0 + 10 * n + i * (1 + n) * 0.1)
    return rows


def test_regime_weekend_and_staleness(spark):
    days = weekdays(date(2024, 1, 1), 40)  # ends on a Friday
    regime = reg.regime_table(spark.createDataFrame(context(days), BARS))
    last = days[-1]
    targets = spark.createDataFrame([(last,), (last + timedelta(days=1),), (last + timedelta(days=8),), (last + timedelta(days=9),)], "d date")
    out = {r.d: r for r in reg.attach_regime(targets, regime, complete_only=False).collect()}
    assert out[last + timedelta(days=1)].vix_level == pytest.approx(50 + 30 + 39 * 4 * 0.1)  # Saturday sees Friday
    assert out[last].vix_level == pytest.approx(50 + 30 + 38 * 4 * 0.1)  # Friday sees Thursday
    assert out[last + timedelta(days=8)].vix_level is not None  # available Saturday, exactly seven days old
    assert out[last + timedelta(days=9)].vix_level is None
    assert out[last].rate_change_20 == pytest.approx(20 * 5 * 0.1)
    with pytest.raises(ValidationError, match="missing market context"):
        reg.validate_context(spark.createDataFrame(bar_rows("SPY", days), BARS))


def calendar(spark, days, special=None):
    special = special or {}
    rows = [("XNYS", d, *special.get(d, (datetime(d.year, d.month, d.day, 13, 30), datetime(d.year, d.month, d.day, 20)))) for d in days]
    return spark.createDataFrame(rows, "calendar string, session_date date, open_at timestamp, close_at timestamp")


def test_sessions_holiday_and_completion(spark):
    days = [date(2026, 9, 3), date(2026, 9, 4), date(2026, 9, 8)]
    cal = calendar(spark, days)
    rows = spark.createDataFrame([("SPY", d) for d in days + [date(2026, 9, 5)]] + [("BTC-USD", date(2026, 9, 5))], "symbol string, d date")
    nxt = {(r.symbol, r.d): r.next_session for r in ses.next_session(rows, cal).collect()}
    assert nxt[("SPY", date(2026, 9, 4))] == date(2026, 9, 8) and nxt[("SPY", date(2026, 9, 5))] is None
    assert nxt[("BTC-USD", date(2026, 9, 5))] == date(2026, 9, 6)
    with pytest.raises(ValidationError):
        ses.require_sessions(ses.next_session(rows, cal))
    bars = spark.createDataFrame(bar_rows("SPY", days + [date(2026, 9, 5)]), BARS)
    done = lambda t: sorted(r.d for r in ses.completed_bars(bars, cal, F.lit(t).cast("timestamp")).collect())
    assert done("2026-09-04 20:29:59") == days[:1] and done("2026-09-04 20:30:00") == days[:2]


def test_plans(spark):
    early = date(2026, 11, 27)
    cal = calendar(spark, [date(2026, 11, 25), early, date(2026, 11, 30)], {early: (datetime(2026, 11, 27, 14, 30), datetime(2026, 11, 27, 18, 0))})
    now = F.lit("2026-11-28 12:00:00").cast("timestamp")
    symbols = spark.createDataFrame([("SPY",), ("BTC/USD",), ("SPY",)], "symbol string")
    plan = ses.study_plan(symbols, cal, now, 2)
    rows = {(r.symbol, str(r.session_date), r.window_name): r.target_at for r in plan.collect()}
    assert len(rows) == 12
    assert rows[("SPY", "2026-11-27", "midday")] == datetime(2026, 11, 27, 16, 15)
    assert rows[("SPY", "2026-11-27", "closing")] == datetime(2026, 11, 27, 17, 55)
    assert rows[("BTC/USD", "2026-11-27", "opening")] == datetime(2026, 11, 27, 0, 35)
    assert ses.replay_windows(plan).filter("not inside_session").count() == 0
    wanted = spark.createDataFrame([("SPY",), ("BTC-USD",), ("SPY",)], "symbol string")
    eligible = {r.symbol: (r.eligible, r.reason) for r in ses.eligible_symbols(wanted, cal, now).collect()}
    assert eligible == {"SPY": (True, None), "BTC-USD": (False, "crypto_requires_delayed_entry_target")}
    late = ses.eligible_symbols(wanted, cal, F.lit("2026-11-30 13:29:00").cast("timestamp")).filter("symbol = 'SPY'").first()
    assert late.reason == "no_future_session_with_completed_features"


def test_timing_dataset(spark):
    days = weekdays(date(2024, 1, 1), 70)
    cal = calendar(spark, days)
    ctx_rows = context(days)
    regime = reg.regime_table(spark.createDataFrame(ctx_rows, BARS))
    holiday = (days[-1] + timedelta(days=1)).replace()
    rows = bar_rows("JPM", days) + bar_rows("JPM", [holiday])
    missing = days[40]
    crypto_days = [days[0] + timedelta(days=i) for i in range(80)]
    rows = [r for r in rows if r[1] != missing] + bar_rows("BTC-USD", crypto_days)
    data = timing.timing_dataset(spark.createDataFrame(rows, BARS), cal, regime)
    out = {(r.symbol, r.target_session): r for r in data.collect()}
    target = days[35]
    row = out[("JPM", target)]
    assert row.feature_date == days[34]
    assert row.decision_at == datetime.combine(target, datetime.min.time()) + timedelta(minutes=30)
    assert row.feature_available_at == datetime(days[34].year, days[34].month, days[34].day, 20, 30)
    assert row.label_available_at - row.exit_at == timedelta(minutes=30)
    # a missing session blocks its own successor and every window that spans it
    assert ("JPM", days[41]) not in out and ("JPM", days[45]) not in out and ("JPM", days[62]) in out
    assert ("JPM", holiday) not in out
    btc = out[("BTC-USD", crypto_days[60])]
    assert btc.feature_date == crypto_days[58] and btc.entry_at == datetime.combine(crypto_days[60], datetime.min.time())
    assert btc.decision_at == datetime.combine(crypto_days[59], datetime.min.time()) + timedelta(minutes=30)
    timing.require_chronology(data)
    assert timing.empty_dataset(spark).columns == data.columns


PREDS = "symbol string, d date, probability double, target_return double, target int"


def pred(symbol, day, p, r):
    return (symbol, date(2024, 1, 1) + timedelta(days=day), p, r, int(r > 0))


def test_portfolio_sleeves_and_calendar(spark):
    rows = [pred("A", 0, 0.6, -0.1), pred("B", 0, 0.5, 0.4), pred("A", 3, 0.4, -0.2)]
    df = spark.createDataFrame(rows, PREDS)
    costs = [0, 10]
    daily = met.portfolio_daily(met.strategy_rows(df, costs), ["cost_bps"])
    got = {(r.cost_bps, r.d.day): r.daily_return for r in daily.collect()}
    assert len(got) == 8 and got[(0.0, 1)] == -0.05 and got[(0.0, 2)] == 0.0
    assert got[(10.0, 4)] == pytest.approx((0.2 - 0.001) / 2)
    out = {r.cost_bps: r for r in met.return_metrics(daily, ["cost_bps"]).collect()}
    returns = np.array([-0.05, 0, 0, 0.1])
    assert out[0.0].net_return_pct == pytest.approx(((1 + returns).prod() - 1) * 100)
    assert out[0.0].max_drawdown_pct == pytest.approx(-5.0)  # the first day's loss counts
    assert out[0.0].annualized_sharpe == pytest.approx(returns.mean() / returns.std(ddof=1) * math.sqrt(365.25))
    one = met.return_metrics(met.portfolio_daily(met.benchmark_rows(df.limit(1)))).first()
    assert one.annualized_sharpe == 0.0


def test_prediction_guards(spark):
    ok = [pred("A", 0, 0.6, 0.1)]
    met.require_predictions(spark.createDataFrame(ok, PREDS), 5.0)
    for bad in (pred("A", 0, 0.5, 0.0), pred("B", 0, 1.5, 0.1), pred("B", 0, 0.5, float("nan")), pred(None, 0, 0.5, 0.1)):
        with pytest.raises(ValidationError):
            met.require_predictions(spark.createDataFrame(ok + [bad], PREDS), 5.0)
    with pytest.raises(ValidationError, match="cost"):
        met.require_predictions(spark.createDataFrame(ok, PREDS), -1.0)
    loss = met.portfolio_daily(met.benchmark_rows(spark.createDataFrame([pred("A", 0, 0.5, -1.0)], PREDS)))
    with pytest.raises(ValidationError, match="daily return"):
        met.require_daily(loss)


def test_folds_purge_and_availability(spark):
    rows = [pred("A", i, 0.5, 0.01 if i % 3 else -0.01) for i in range(60)]
    df = spark.createDataFrame(rows, PREDS)
    protocol = wf.Protocol(min_train=20, test=15, purge=5, max_folds=2)
    dated = wf.fold_dates(df, protocol)
    spans = {r.fold: r for r in wf.folds(dated, protocol).collect()}
    assert {k: (v.test_from, v.train_to) for k, v in spans.items()} == {1: (30, 25), 2: (45, 40)}
    rates = {r.fold: r for r in wf.base_rates(df, dated, protocol).collect()}
    assert rates[1].train_rows == 25 and rates[1].base_probability == pytest.approx(sum(r[4] for r in rows[:25]) / 25)
    stamped = df.withColumns({
        "decision_at": F.col("d").cast("timestamp"),
        "label_available_at": F.timestamp_add("DAY", F.lit(6), F.col("d").cast("timestamp")),
    })
    purged = {r.fold: r for r in wf.purged_base_rates(stamped, dated, protocol).collect()}
    assert purged[1].train_rows == 24  # the label available exactly at the first decision is out
    wf.require_trainable(wf.base_rates(df, dated, protocol), protocol)
    flat = df.withColumn("target", F.lit(1))
    with pytest.raises(ValidationError, match="both classes"):
        wf.require_trainable(wf.base_rates(flat, dated, protocol), protocol)
    with pytest.raises(ValidationError):
        wf.require_dates(wf.date_index(df), 100)
    split = {r.role: r.n for r in wf.chronological_split(df).groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert split == {"train": 43, "purged": 5, "test": 12}


def test_gate_and_bootstrap(spark):
    df = spark.createDataFrame([(0.6, 0.69, 0.7, 1.0, -5.0, 0.7, 3.0), (None, 0.7, 0.7, 0.7, -20.1, 0.5, 0.0)], "a double, l double, b double, s double, d double, p double, r double")
    reasons = [r.x for r in df.select(met.rejection_reasons(*[F.col(c) for c in "albsdpr".replace("albsdpr", "albsdpr")]).alias("x")).collect()]
    assert reasons[0] == [] and len(reasons[1]) == 6
    values = np.sin(np.arange(47)) / 100
    daily = spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=i), float(v)) for i, v in enumerate(values)], "d date, daily_return double")
    row = met.bootstrap_interval(daily).first()
    starts = np.array([[int(hashlib.md5(f"17:{r}:{b}".encode()).hexdigest()[:15], 16) % 47 for b in range(3)] for r in range(500)])
    picks = (starts[..., None] + np.arange(20)) % 47
    means = values[picks.reshape(500, -1)[:, :47]].mean(axis=1) * 10000
    low, high = np.quantile(means, [0.025, 0.975])
    assert (row.lower_95_bps, row.upper_95_bps) == (pytest.approx(low), pytest.approx(high))
    one = {r.resample: r.mean_bps for r in met.bootstrap_means(daily, resamples=7, block=100).collect()}  # one wrapping block of all days
    assert len(one) == 7 and all(m == pytest.approx(values.mean() * 10000) for m in one.values())
    assert met.bootstrap_interval(daily.limit(0)).collect() == []
