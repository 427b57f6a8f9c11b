"""Journal, ledger, exposure and audit chains against sequential references."""

import hashlib
import json
import random
from datetime import date, datetime, timedelta
from decimal import Decimal
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pitspark.functions.reasons import ValidationError
from pitspark.operators import journal as jr
from pitspark.operators import ledger as lg

T = datetime.fromisoformat
FILL = "symbol string, side string, quantity decimal(18,8), price decimal(18,8), multiplier decimal(6,0), commission decimal(18,8), day date, seq bigint"


def fills(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        symbol = "HOT" if rng.random() < 0.7 else "B"
        rows.append((symbol, rng.choice(["BUY", "SELL"]), Decimal(rng.randint(1, 5)), Decimal(rng.randint(90, 110)), Decimal(100 if symbol == "B" else 1),
                     Decimal("0.35"), date(2024, 1, 1) + timedelta(days=i // 9), i))
    return rows


def sequential(rows):
    """Plain fill-by-fold position keeping."""
    state, out = {}, {}
    for symbol, side, quantity, price, multiplier, fee, day, seq in rows:
        q, average, realized, cash, fees = state.get(symbol, (Decimal(0),) * 5)
        s = quantity if side == "BUY" else -quantity
        if q == 0 or (q > 0) == (s > 0):
            average = (abs(q) * average + quantity * price) / (abs(q) + quantity)
        else:
            realized += (price - average) * min(abs(q), quantity) * (1 if q > 0 else -1) * multiplier
            if q + s == 0:
                average = Decimal(0)
            elif (q > 0) != (q + s > 0):
                average = price
        state[symbol] = (q + s, average, realized, cash - s * price * multiplier - fee, fees + fee)
        out[(symbol, seq)] = (*state[symbol], day)
    return out


def with_bins(spark, rows):
    return spark.createDataFrame(rows, FILL).withColumn("bin", F.expr("seq div 4"))


def test_running_positions(spark):
    rows = fills(1, 80)
    want = sequential(rows)
    got = lg.running_positions(with_bins(spark, rows), ["day", "bin"], ["day", "seq"]).collect()
    for r in got:
        q, _, _, cash, fees, _ = want[(r.symbol, r.seq)]
        assert (r.position, r.cash, r.fees_paid) == (q, cash, fees)


def exact(rows):
    """The sequential fold in rationals: closing (quantity, average, realized) per (symbol, day)."""
    state, out = {}, {}
    for symbol, side, quantity, price, multiplier, _, day, _ in rows:
        q, average, realized = state.get(symbol, (Fraction(0),) * 3)
        quantity, price = Fraction(quantity), Fraction(price)
        s = quantity if side == "BUY" else -quantity
        if q == 0 or (q > 0) == (s > 0):
            average = (abs(q) * average + quantity * price) / (abs(q) + quantity)
        else:
            realized += (price - average) * min(abs(q), quantity) * (1 if q > 0 else -1) * Fraction(multiplier)
            average = Fraction(0) if q + s == 0 else price if (q > 0) != (q + s > 0) else average
        state[symbol] = out[symbol, day] = (q + s, average, realized)
    return out


def close_to(decimal, fraction, places):
    return abs(Fraction(decimal) - fraction) < Fraction(1, 10**places)


@pytest.mark.parametrize("seed", [2, 3])
def test_average_cost_matches_an_exact_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(s, side, Decimal(rng.randint(1, 10**9)) / 10**8, Decimal(rng.randint(1, 10**12)) / 10**8, m, fee, day, i) for s, side, _, _, m, fee, day, i in fills(seed, 200)]
    want = exact(rows)
    got = {(r.symbol, r.day): r for r in lg.average_cost(with_bins(spark, rows), "day", "bin", ["day", "seq"]).collect()}
    assert set(got) == set(want)
    before = {}
    for key, (q, average, realized) in sorted(want.items(), key=lambda x: x[0][1]):
        r = got[key]
        assert Fraction(r.quantity) == q and close_to(r.average_price, average, 17) and close_to(r.realized_pnl, realized, 12)
        assert close_to(r.realized_day, realized - before.get(key[0], 0), 12)
        before[key[0]] = realized


def test_average_cost_does_not_depend_on_the_bins(spark):
    rows = fills(7, 150)
    wide = spark.createDataFrame(rows, FILL).withColumn("bin", F.lit(0).cast("bigint"))
    narrow = spark.createDataFrame(rows, FILL).withColumn("bin", F.col("seq"))
    states = [{(r.symbol, r.day): r for r in lg.average_cost(df, "day", "bin", ["day", "seq"]).collect()} for df in (wide, narrow)]
    for key, r in states[0].items():
        o = states[1][key]
        assert r.quantity == o.quantity and close_to(r.average_price, Fraction(o.average_price), 17) and close_to(r.realized_pnl, Fraction(o.realized_pnl), 12)


def test_average_cost_continues_from_an_opening(spark):
    rows = fills(4, 90)
    cut = date(2024, 1, 6)
    want = exact(rows)
    first = lg.average_cost(with_bins(spark, [r for r in rows if r[6] < cut]), "day", "bin", ["day", "seq"])
    opening = lg.closing_positions(first, "day")
    later = lg.average_cost(with_bins(spark, [r for r in rows if r[6] >= cut]), "day", "bin", ["day", "seq"], opening=opening).collect()
    assert {(r.symbol, r.day) for r in later} == {k for k in want if k[1] >= cut}
    for r in later:
        q, average, realized = want[r.symbol, r.day]
        assert Fraction(r.quantity) == q and close_to(r.average_price, average, 17) and close_to(r.realized_pnl, realized, 12)


def test_average_cost_edges(spark):
    day = date(2024, 1, 1)
    rows = [("A", side, Decimal(q), Decimal(p), Decimal(1), Decimal(0), day, i) for i, (side, q, p) in enumerate([("BUY", "3", "1"), ("SELL", "1", "2"), ("BUY", "1", "4"), ("SELL", "7", "5"), ("BUY", "4", "6"), ("BUY", "0.00000001", "0.00000001")])]
    (r,) = lg.average_cost(with_bins(spark, rows), "day", "bin", ["day", "seq"]).collect()
    # 3 at 1, sold 1 at 2, 1 more at 4 gives 3 at 2; 7 sold at 5 leaves -4 at 5, bought back at 6.
    assert (r.fills, r.quantity, r.average_price, r.realized_pnl) == (6, Decimal("0.00000001"), Decimal("0.00000001"), Decimal(1 + 9 - 4))
    assert lg.average_cost(with_bins(spark, []), "day", "bin", ["day", "seq"]).collect() == []
    with pytest.raises(Exception, match="(?i)overflow|out of range|NUMERIC"):
        huge = [("A", "BUY", Decimal(9 * 10**9), Decimal(1), Decimal(1), Decimal(0), day, i) for i in range(2)]
        lg.average_cost(with_bins(spark, huge), "day", "bin", ["day", "seq"]).collect()


def test_commission_schedule(spark):
    rows = [("option", 1.0, 5.0, 1.0), ("option", 10.0, 5.0, 6.5), ("crypto", 2.0, 100.0, 0.3), ("equity", 10.0, 1.0, 0.35), ("equity", 1000.0, 1.0, 3.5)]
    df = spark.createDataFrame(rows, "a string, q double, p double, want double")
    for r in df.withColumn("got", lg.commission(F.col("a"), F.col("q"), F.col("p"))).collect():
        assert r.got == pytest.approx(r.want)


def test_marks_exposure_and_missing_mark(spark):
    positions = spark.createDataFrame([("A", 10.0, 1.0, -1000.0, 1.0), ("B", -2.0, 100.0, 500.0, 2.0), ("C", 0.0, 1.0, 0.0, 0.0)], "symbol string, quantity double, multiplier double, cash double, fees_paid double")
    marks = spark.createDataFrame([("A", 110.0), ("B", 3.0)], "symbol string, mark double")
    report = lg.mark_to_market(positions, marks, 10_000.0)
    row = lg.require_marks(report).first()
    assert (row.equity, row.gross_notional, row.missing_marks) == (10_000 - 500 + 1100 - 600, 1700.0, 0)
    with pytest.raises(ValidationError):
        lg.require_marks(lg.mark_to_market(positions, marks.filter("symbol = 'A'"), 1.0))
    pending = spark.createDataFrame([("A", "BUY", 5.0), ("A", "SELL", 40.0), ("D", "SELL", 1.0)], "symbol string, side string, quantity double")
    out = {r.symbol: r for r in lg.worst_case_exposure(positions, pending, marks).collect()}
    assert (out["A"].worst_quantity, out["A"].worst_notional) == (30.0, 3300.0)
    assert out["D"].missing_mark and not out["C"].missing_mark
    gross = lg.gross_exposure(lg.worst_case_exposure(positions, pending, marks)).first()
    assert gross.missing_marks == 1


def test_equity_report(spark):
    curve = spark.createDataFrame([(date(2024, 1, 1 + i), e) for i, e in enumerate([90.0, 120.0, 60.0, 80.0])], "d date, equity double")
    row = lg.equity_report(curve, 100.0).first()
    assert (row.net_pnl, row.return_pct, row.max_drawdown_pct) == (-20.0, -20.0, 50.0)


def test_order_rate_window_edges(spark):
    rng = random.Random(6)
    second = 10**9
    times = sorted({rng.randrange(0, 200 * second) for _ in range(300)} | {0, second, 64 * second, 65 * second - 1, 65 * second})
    got = {r.ts_ns: r.orders_in_window for r in lg.order_rate(spark.createDataFrame([(t,) for t in times], "ts_ns bigint"), 3).collect()}
    assert len(got) == len(times)
    for t in times:
        assert got[t] == sum(1 for x in times if t - second < x <= t)


def test_quote_scores_use_the_previous_mid(spark):
    rows = [("A", i * 1800 * 10**9, 100.0 + i, 102.0 + i, 3.0, 1.0) for i in range(6)]
    df = spark.createDataFrame(rows, "symbol string, event_ns bigint, bid double, ask double, bid_size double, ask_size double")
    out = lg.quote_scores(df, 0.001, 0.5).orderBy("event_ns").collect()
    assert out[0].momentum == 0.0 and out[0].imbalance == 0.5 and out[0].active
    assert all(out[i].momentum == pytest.approx(1 / (100 + i)) for i in range(1, 6))


def chain(n):
    lines, previous = [], "0" * 64
    for i in range(1, n + 1):
        payload = {"data": f'{{"i":{i}}}', "event": "e", "previous_hash": previous, "ts_ns": i}
        digest = hashlib.sha256(json.dumps(payload, separators=(",", ":")).encode()).hexdigest()
        lines.append((i, payload["data"], "e", previous, i, digest))
        previous = digest
    return lines


def test_audit_chain(spark):
    cols = "line_number int, data string, event string, previous_hash string, ts_ns bigint, hash string"
    good = chain(6)
    check = lambda rows: lg.verify_chain(spark.createDataFrame(rows, cols)).first().first_bad_line
    assert check(good) is None
    edited = [r if r[0] != 3 else (3, '{"i":9}', *r[2:]) for r in good]
    assert check(edited) == 3
    assert check([r for r in good if r[0] != 4]) == 5
    assert check([(1, *chain(2)[1][1:])]) == 1


SESSION = "calendar string, session_date date, open_at timestamp, close_at timestamp"
SIGNAL = (
    "signal_id string, generated_at timestamp, symbol string, feature_as_of date, probability_up double, direction smallint, model_hash string, "
    "model_trained_through date, cost_bps double, status string, target_session date, target_open timestamp, target_close timestamp, "
    "feature_payload_json string, feature_hash string, feature_contract_version string"
)
PAYLOAD = '{"a":1}'


def signal(n=1, **c):
    d = {
        "signal_id": f"s{n}", "generated_at": T("2026-09-04T22:00:00"), "symbol": "SPY", "feature_as_of": date(2026, 9, 4), "probability_up": 0.6, "direction": 1,
        "model_hash": "m", "model_trained_through": date(2026, 9, 1), "cost_bps": 5.0, "status": "PENDING", "target_session": date(2026, 9, 8),
        "target_open": T("2026-09-08T13:30:00"), "target_close": T("2026-09-08T20:00:00"), "feature_payload_json": PAYLOAD,
        "feature_hash": hashlib.sha256(PAYLOAD.encode()).hexdigest(), "feature_contract_version": "daily_pit_v2", **c,
    }
    return tuple(d.values())


@pytest.fixture()
def sessions(spark):
    days = [date(2026, 9, 4), date(2026, 9, 8), date(2026, 9, 9)]
    return spark.createDataFrame([("XNYS", d, datetime(d.year, d.month, d.day, 13, 30), datetime(d.year, d.month, d.day, 20)) for d in days], SESSION)


def test_signal_integrity_checks(spark, sessions):
    cases = {
        "generated_after_target_open": {"generated_at": T("2026-09-08T13:30:00")},
        "target_bounds_disagree_with_calendar": {"target_open": T("2026-09-08T13:31:00")},
        "invalid_cost": {"cost_bps": -1.0},
        "obsolete_contract": {"feature_contract_version": "daily_pit_v1"},
        "direction_disagrees_with_thresholds": {"direction": 0},
        "payload_hash_mismatch": {"feature_hash": "0" * 64},
        "training_exceeds_feature_cutoff": {"model_trained_through": date(2026, 9, 5)},
    }
    rows = [signal(0)] + [signal(i + 1, **change) for i, change in enumerate(cases.values())]
    wrong = signal(99, target_session=date(2026, 9, 9), target_open=T("2026-09-09T13:30:00"), target_close=T("2026-09-09T20:00:00"))
    got = {r.signal_id: r.integrity_reasons for r in jr.integrity_reasons(spark.createDataFrame(rows + [wrong], SIGNAL), sessions).collect()}
    assert got["s0"] == [] and got["s99"] == ["target_is_not_next_session"]
    for i, reason in enumerate(cases):
        assert got[f"s{i + 1}"] == [reason]
    with pytest.raises(ValidationError):
        jr.append(spark.createDataFrame([], SIGNAL), spark.createDataFrame(rows, SIGNAL), sessions)


def test_append_once_and_settle_exactly(spark, sessions):
    empty = spark.createDataFrame([], SIGNAL)
    batch = spark.createDataFrame([signal(1), signal(2), signal(3, model_hash="m2")], SIGNAL)
    journal = jr.append(empty, batch, sessions)
    assert sorted(r.signal_id for r in journal.collect()) == ["s1", "s3"]
    assert jr.append(journal, batch, sessions).count() == 0
    bar = "symbol string, d date, open double, high double, low double, close double, volume double"
    bars = spark.createDataFrame([("SPY", date(2026, 9, 8), 100.0, 103.0, 99.0, 102.0, 1.0)], bar)
    settle = lambda j, b, t: jr.settle(j, b, F.lit(t).cast("timestamp"))
    assert {r.status for r in settle(journal, bars, "2026-09-08 20:29:59").collect()} == {"PENDING"}
    done = settle(journal, bars, "2026-09-08 20:30:00")
    row = done.first()
    assert row.status == "EVALUATED" and row.realized_return == pytest.approx(0.02) and row.strategy_return == pytest.approx(0.0195)
    later_day = bars.withColumn("d", F.lit("2026-09-09").cast("date"))
    assert {r.status for r in settle(journal, later_day, "2026-12-01 00:00:00").collect()} == {"PENDING"}
    broken = bars.withColumn("high", F.lit(1.0))
    assert {r.status for r in settle(journal, broken, "2026-12-01 00:00:00").collect()} == {"PENDING"}
    again = settle(done, bars.withColumn("close", F.lit(50.0)), "2026-12-01 00:00:00")
    assert {r.realized_return for r in again.collect()} == {row.realized_return}
    cohorts = {r.model_hash: r for r in jr.cohorts(done).collect()}
    assert set(cohorts) == {"m", "m2"} and cohorts["m"].brier_score == pytest.approx(0.16)
    assert jr.pending_symbols(journal).count() == 1 and jr.pending_symbols(done).count() == 0
    assert {r.status: r.signals for r in jr.status_counts(done).collect()} == {"EVALUATED": 2}
    jr.require_settleable(journal)
    with pytest.raises(ValidationError):
        jr.require_settleable(journal.withColumn("target_close", F.lit(None).cast("timestamp")))


def test_legacy_and_recent(spark):
    rows = spark.createDataFrame([signal(i, generated_at=T("2026-09-04T00:00:00") + timedelta(minutes=i)) for i in range(40)] + [signal(99, feature_contract_version=None)], SIGNAL)
    out = {r.signal_id: (r.status, r.legacy_status) for r in jr.invalidate_legacy(rows).collect()}
    assert out["s99"] == ("INVALIDATED_LEGACY", "PENDING") and out["s1"] == ("PENDING", None)
    top = jr.recent(rows).collect()
    assert len(top) == 30 and top[0].signal_id == "s99" and top[0].direction_label == "LONG"


def test_fills_of_a_cell_are_one_effect(spark):
    rows = fills(5, 120)
    effects = lg.fill_effects(with_bins(spark, rows), ["day", "bin"], ["day", "seq"])
    cells = with_bins(spark, rows).select("symbol", "day", "bin").distinct().count()
    found = effects.collect()
    assert len(found) == cells < len(rows) and sum(r.fills for r in found) == len(rows)


def test_missing_quantity_or_price_counts_as_null(spark):
    day = date(2024, 1, 1)
    rows = [("A", "BUY", Decimal(2), Decimal(3), Decimal(1), Decimal(0), day, 0), ("A", "BUY", None, Decimal(3), Decimal(1), Decimal(0), day, 1), ("B", "BUY", Decimal(2), None, Decimal(1), Decimal(0), day, 0)]
    got = {r.symbol: (r.fills, r.quantity, r.average_price, r.realized_pnl) for r in lg.average_cost(with_bins(spark, rows), "day", "bin", ["day", "seq"]).collect()}
    assert got == {"A": (2, Decimal(2), Decimal(3), None), "B": (1, Decimal(2), None, Decimal(0))}
