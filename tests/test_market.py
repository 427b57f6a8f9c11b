"""Minute bars, quotes, study, replay and admission."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from pitspark.operators import admission as adm
from pitspark.operators import quality as ql
from pitspark.operators import replay as rp
from pitspark.operators import study as st
from pitspark.sources import marketdata as md

MIN = 60 * 10**9
SEC = 10**9
BASE = 1788528600 * 10**9  # 2026-09-04 13:30:00Z
BAR = "w int, event_ns bigint, o double, h double, l double, c double, v double, n double, vw double"
QUOTE = "w int, symbol string, event_ns bigint, bid double, ask double, bid_size double, ask_size double, conditions array<string>, tape string, identity string, record_symbol string"


def test_bar_quality(spark):
    ok = lambda k, **c: (1, BASE + k * MIN, *[c.get(x, 10.0) for x in "ohlc"], c.get("v", 5.0), c.get("n", 2.0), c.get("vw", 10.0))
    rows = [
        ok(0), ok(0), ok(1), ok(1, c=10.0 + 1e-13), ok(2, v=0.0), ok(3, h=9.0), ok(4, n=1.5), ok(5, o=None), ok(5, o=-1.0),
        (1, BASE + 6 * MIN + 1, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), (1, None, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ok(-1), ok(10), ok(9, n=None, vw=None),
    ]
    spans = spark.createDataFrame([(1, BASE, BASE + 10 * MIN), (2, BASE, BASE + 10 * MIN)], "w int, start_ns bigint, end_ns bigint")
    out = {r.w: r for r in ql.bar_quality(spans, spark.createDataFrame(rows, BAR), ["w"]).collect()}
    q = out[1]
    assert (q.received_count, q.outside_session_count, q.valid_count, q.zero_volume_count) == (14, 2, 3, 1)
    assert (q.conflicting_minute_count, q.conflicting_record_count, q.identical_duplicate_count) == (1, 2, 1)
    assert (q.invalid_count, q.missing_count, q.expected_minutes) == (8, 7, 10)
    assert (out[2].received_count, out[2].missing_count, out[2].coverage_ratio) == (0, 10, 0.0)
    classified = ql.classify_bars(spark.createDataFrame(rows, BAR).join(spans, "w"))
    reasons = {r.reason: r.records for r in ql.reason_histogram(classified, ["w"]).collect()}
    assert reasons == {
        "invalid_ohlc_bounds": 1, "noninteger_trade_count": 1, "nonnumeric_value": 1, "nonfinite_or_invalid_value": 1,
        "not_exact_minute": 1, "invalid_or_naive_timestamp": 1,
    }
    missing = ql.missing_minutes(spans, ql.valid_minutes(classified, ["w"]), ["w"]).filter("w = 1")
    assert sorted((r.event_ns - BASE) // MIN for r in missing.collect()) == [1, 3, 4, 5, 6, 7, 8]


def quote(ns, bid=99.0, ask=101.0, w=1, symbol="SPY", size=1.0, c=("R",), z="A", tag="", record_symbol=None):
    identity = f"{ns}{bid}{ask}{size}{c}{z}{tag}"
    return (w, symbol, ns, bid, ask, size, size, list(c) if c is not None else None, z, identity, record_symbol)


def first(spark, rows, target, wait=30 * SEC, bin_width=None):
    df = spark.createDataFrame(rows, QUOTE)
    unique = ql.unique_quotes(ql.classify_quotes(df), ["w"])
    targets = spark.createDataFrame([(1, target)], "w int, target_ns bigint")
    return ql.first_quotes(targets, ql.quote_instants(unique, ["w"]), ["w"], wait_ns=wait, bin_width=bin_width).first()


@pytest.mark.parametrize("bin_width", [None, SEC])
def test_first_quote_boundaries(spark, bin_width):
    assert first(spark, [quote(BASE)], BASE, bin_width=bin_width).first_ns == BASE
    assert first(spark, [quote(BASE - 1)], BASE, bin_width=bin_width).first_ns is None
    assert first(spark, [quote(BASE + 30 * SEC)], BASE, bin_width=bin_width).mid_price == 100.0
    assert first(spark, [quote(BASE + 30 * SEC + 1)], BASE, bin_width=bin_width).first_ns is None
    crossed_then_ok = [quote(BASE, 102.0, 101.0), quote(BASE + 5, 100.0, 100.0)]
    assert first(spark, crossed_then_ok, BASE, bin_width=bin_width).first_ns == BASE + 5  # locked is allowed here
    copies = [quote(BASE), quote(BASE), quote(BASE)]
    assert first(spark, copies, BASE, bin_width=bin_width).mid_price == 100.0
    tie = first(spark, [quote(BASE), quote(BASE, 98.0), quote(BASE + 5)], BASE, bin_width=bin_width)
    assert (tie.ambiguous, tie.first_count, tie.mid_price) == (True, 2, None)


def test_cost_pair_values(spark):
    cols = "symbol string, bid double, ask double, mid_price double, full_spread_bps double, feed string, complete boolean, ambiguous boolean, reasons array<string>"
    leg = lambda b, a, feed="sip", done=True: spark.createDataFrame([("SPY", b, a, (a + b) / 2, (a - b) / ((a + b) / 2) * 1e4, feed, done, False, [])], cols)
    pair = ql.cost_pairs(leg(99.0, 101.0), leg(109.0, 111.0), ["symbol"]).first()
    assert pair.gross_mid_return == pytest.approx(0.1) and pair.touch_long_return == pytest.approx(109 / 101 - 1)
    assert pair.approximate_round_trip_spread_bps == pytest.approx((200 + 2 / 110 * 10000) / 2)
    blocked = ql.cost_pairs(leg(99.0, 101.0), leg(109.0, 111.0, "iex", False), ["symbol"]).first()
    assert blocked.reasons == ["exit_quotes_fetch_incomplete", "cross_feed_quote_pair_forbidden"] and blocked.gross_mid_return is None
    assert ql.fee_scenarios(ql.cost_pairs(leg(99.0, 101.0), leg(109.0, 111.0), ["symbol"])).count() == 5
    lone = ql.cost_pairs(leg(99.0, 101.0), leg(1.0, 2.0).limit(0), ["symbol"]).first()
    assert not lone.usable and "exit_has_no_valid_timely_quote" in lone.reasons


def test_bars_leg_of_the_pair(spark):
    cols = "symbol string, bid double, ask double, mid_price double, full_spread_bps double, feed string, complete boolean, ambiguous boolean, reasons array<string>"
    leg = spark.createDataFrame([("SPY", 99.0, 101.0, 100.0, 200.0, "sip", True, False, [])], cols)
    bar = lambda feed="sip", done=True, reasons=(), bad=0, gaps=0: spark.createDataFrame(
        [("SPY", feed, done, list(reasons), bad, gaps)], "symbol string, feed string, complete boolean, reasons array<string>, invalid_count bigint, missing_count bigint"
    )
    pair = lambda bars: ql.cost_pairs(leg, leg, ["symbol"], bars).first()
    assert pair(bar()).reasons == [] and pair(bar()).usable
    worn = pair(bar(bad=2, gaps=3))
    assert worn.usable and worn.gross_mid_return == 0.0
    assert worn.reasons == ["bar_quality_contains_invalid_or_conflicting_records", "bar_quality_has_missing_minutes"]
    assert pair(bar(done=False)).reasons == ["bars_fetch_incomplete"] and not pair(bar(done=False)).usable
    assert pair(bar("iex")).reasons == ["cross_feed_quote_pair_forbidden"]
    assert pair(bar("crypto_us")).reasons == ["unknown_or_unsupported_feed_for_symbol", "cross_feed_quote_pair_forbidden"]
    assert pair(bar(reasons=["bars_declares_wrong_symbol"], gaps=1)).reasons == ["bars_declares_wrong_symbol", "bar_quality_has_missing_minutes"]
    gone = pair(bar().limit(0))
    assert not gone.usable and gone.reasons[0] == "bars_fetch_incomplete"


def test_feed_rules(spark):
    rows = [("SPY", "sip", True), ("SPY", "crypto_us", False), ("BTC/USD", "crypto_us", True), ("BTC/USD", "sip", False), ("ETH/USD", "crypto_us", False), ("ETH-USD", "sip", False), ("SPY", None, False)]
    df = spark.createDataFrame(rows, "symbol string, feed string, want boolean")
    assert df.filter(ql.feed_allowed(F.col("symbol"), F.col("feed")) != F.col("want")).count() == 0


def test_latency_pairing_and_denominator(spark):
    quotes = [quote(BASE + 100, 99.0, 101.0), quote(BASE + 500 * 10**6, 100.0, 102.0), quote(BASE + 100, 1.0, 2.0, w=2), quote(BASE + 100, 1.5, 2.0, w=2), quote(BASE + SEC, 1.0, 2.0, w=2)]
    unique = ql.unique_quotes(ql.classify_quotes(spark.createDataFrame(quotes, QUOTE)), ["w"])
    windows = spark.createDataFrame([(w, "SPY", BASE, []) for w in (1, 2)] + [(3, "SPY", BASE, ["fetch_incomplete_or_truncated"])], "w int, symbol string, target_ns bigint, source_reasons array<string>")
    rows = {(r.w, r.latency_ms): r for r in st.latency_scenarios(windows, ql.quote_instants(unique, ["w"]), ["w"]).collect()}
    assert len(rows) == 9
    moved = rows[(1, 250)]
    assert moved.paired_with_zero and moved.ask_displacement_bps == pytest.approx((102 / 101 - 1) * 1e4)
    assert moved.event_gap_ms == pytest.approx((500 * 10**6 - 100) / 1e6) and rows[(1, 1000)].reasons == ["no_valid_timely_quote"]
    assert rows[(2, 0)].reasons == ["first_quote_ambiguous_without_sequence"]
    assert rows[(2, 250)].reasons == ["zero_latency_baseline_unavailable"] and rows[(2, 250)].available
    assert rows[(3, 0)].reasons == ["fetch_incomplete_or_truncated", "no_valid_timely_quote"]


def test_mixed_feeds_disable_pooling(spark):
    cols = "symbol string, window_name string, session_date date, feed string, available boolean, paired_with_zero boolean, full_spread_bps double, ask_displacement_bps double, bid_displacement_bps double, event_gap_ms double, wait_seconds double, latency_ms bigint"
    row = lambda d, feed: ("SPY", "opening", date(2024, 1, d), feed, True, True, 2.0, 1.0, -1.0, 1.0, 1.0, 0)
    one = st.aggregate_latency(spark.createDataFrame([row(1, "sip"), row(2, None)], cols)).first()
    two = st.aggregate_latency(spark.createDataFrame([row(1, "sip"), row(2, "iex")], cols)).first()
    assert (one.available_samples, one.spread_median) == (2, 2.0)
    assert (two.expected_samples, two.available_samples, two.spread_median) == (2, 0, None)


TARGET = BASE + 5 * SEC
ENVELOPE = "w int, symbol string, declared_symbol string, kind string, feed string, complete boolean, pages int, start_ns bigint, end_ns bigint, observed_ns bigint, target_ns bigint, window_name string, source_sha256 string"


def envelope(w=1, symbol="SPY", **c):
    return (w, symbol, c.get("declared", symbol), c.get("kind", "quotes"), c.get("feed", "crypto_us" if "/" in symbol else "sip"), c.get("complete", True),
            c.get("pages", 1), TARGET - 5 * SEC, TARGET + 2 * SEC, c.get("observed", TARGET + 3 * SEC), TARGET, "opening", "b" * 64)


def replay(spark, quotes, env=None, max_age_ms=1000, bin_width=None, **kw):
    windows = spark.createDataFrame([env or envelope()], ENVELOPE)
    records = spark.createDataFrame(quotes, QUOTE).join(windows.select("w", "start_ns", "end_ns"), "w")
    usable = rp.usable_windows(windows, records, ["w", "symbol"], **kw)
    rows = rp.scenarios(usable, rp.events(records, ["w", "symbol"]), ["w", "symbol"], max_age_ms=max_age_ms, bin_width=bin_width)
    return {r.latency_ms: r for r in rows.collect()}


@pytest.mark.parametrize("bin_width", [None, SEC])
def test_replay_strictness_and_references(spark, bin_width):
    ms = 10**6
    rows = replay(spark, [quote(TARGET - 100 * ms, 99.0, 101.0), quote(TARGET + 200 * ms, 100.0, 102.0), quote(TARGET + 900 * ms, 101.0, 103.0)], bin_width=bin_width)
    assert [rows[x].buy_reference_price for x in (0, 250, 1000)] == [101.0, 102.0, 103.0]
    exact = replay(spark, [quote(TARGET)], bin_width=bin_width)
    assert exact[0].status == "MISSING" and exact[250].scenario_status == "DECISION_BLOCKED"
    assert replay(spark, [quote(TARGET - 1)], bin_width=bin_width)[0].status == "VALID"


def test_replay_poison_recovery_ambiguity_and_age(spark):
    ms = 10**6
    ok = quote(TARGET - 500 * ms)
    for bad in (quote(TARGET - 1, 102.0, 101.0), quote(TARGET - 1, 100.0, 100.0), quote(TARGET - 1, size=0.0), quote(TARGET - 1, c=("R", "X")), quote(TARGET - 1, z="Z"), quote(TARGET - 1, c=None)):
        rows = replay(spark, [ok, bad])
        assert rows[0].status == "INVALID" and rows[0].scenario_status == "DECISION_BLOCKED"
    recovered = replay(spark, [ok, quote(TARGET - 2, 102.0, 101.0), quote(TARGET - 1, 98.0, 99.0)])
    assert recovered[0].status == "VALID" and recovered[0].buy_reference_price == 99.0
    tie = replay(spark, [ok, quote(TARGET - 1), quote(TARGET - 1, 98.0)])
    assert tie[0].reasons == ["distinct_same_timestamp_updates_unsequenced"]
    assert replay(spark, [ok, quote(TARGET - 1), quote(TARGET - 1)])[0].status == "VALID"
    assert replay(spark, [quote(TARGET - 1000 * ms)])[0].status == "VALID"
    assert replay(spark, [quote(TARGET - 1000 * ms - 1)])[0].status == "STALE"
    late = replay(spark, [ok, quote(TARGET + 10, 102.0, 101.0)])
    assert (late[0].status, late[250].scenario_status) == ("VALID", "ARRIVAL_BLOCKED")


def test_replay_source_rejection(spark):
    ok = quote(TARGET - 5)
    for env in (envelope(declared="JPM"), envelope(complete=False), envelope(pages=4), envelope(observed=TARGET), envelope(feed="x"), envelope(kind="bars")):
        assert replay(spark, [ok], env)[0].status == "SOURCE_REJECTED"
    assert replay(spark, [ok, quote(None)])[0].reasons == ["event_timestamp_missing_or_unparseable_cannot_order"]
    assert replay(spark, [ok, quote(TARGET - 4, record_symbol="JPM")])[0].status == "SOURCE_REJECTED"
    assert replay(spark, [ok, quote(TARGET - 4)], max_records=1)[0].reasons == ["record_count_exceeds_research_limit"]
    crypto = replay(spark, [quote(TARGET - 5, symbol="BTC/USD", c=None, z=None)], envelope(symbol="BTC/USD"))
    assert crypto[0].status == "VALID"


def test_transitions(spark):
    windows = spark.createDataFrame([envelope()], ENVELOPE)
    quotes = [quote(TARGET - 50, 102.0, 101.0), quote(TARGET - 40), quote(TARGET - 30, 102.0, 101.0), quote(TARGET - 30), quote(TARGET - 20), quote(TARGET - 20)]
    records = spark.createDataFrame(quotes, QUOTE).join(windows.select("w", "start_ns", "end_ns"), "w")
    row = rp.transition_counters(rp.events(records, ["w", "symbol"]), ["w"]).first()
    assert (row.state_transitions, row.invalid_state_updates, row.invalidations, row.recoveries, row.ambiguous_groups) == (4, 2, 1, 2, 1)
    assert row.first_valid_ns == TARGET - 40
    counts = rp.record_counters(records, ["w"]).first()
    assert (counts.received, counts.in_window, counts.exact_duplicates, counts.unique_events) == (6, 6, 1, 5)


def admit(spark, quotes, policy=None, evidence=None, env=None, notional="5"):
    p = {"max_notional_usd": "25", "paper_only": True, "execution_enabled": False, "max_quote_age_ms": 1000, "expected_stock_feed": "sip", "expected_crypto_feed": "crypto_us", "expected_source_sha256": None, **(policy or {})}
    e = {"verified": True, "approved_for_paper": True, "scope": adm.MODEL_SCOPE, "model_sha256": "c" * 64, **(evidence or {})}
    pdf = spark.createDataFrame([tuple(p.values())], "max_notional_usd string, paper_only boolean, execution_enabled boolean, max_quote_age_ms int, expected_stock_feed string, expected_crypto_feed string, expected_source_sha256 string")
    edf = spark.createDataFrame([tuple(e.values())], "verified boolean, approved_for_paper boolean, scope string, model_sha256 string")
    windows = spark.createDataFrame([env or envelope()], ENVELOPE)
    by = ["w", "symbol"]
    records = spark.createDataFrame(quotes, QUOTE).join(windows.select("w", "start_ns", "end_ns"), "w")
    usable = rp.usable_windows(windows, records, by)
    rows = rp.scenarios(usable, rp.events(records, by), by)
    intents = adm.generate_intents(usable, ["w"], notional)
    return adm.evaluate(intents, rows.drop("symbol"), pdf, edf, ["w"])


def test_admission_accumulates_reasons(spark):
    ok = [quote(TARGET - 5), quote(TARGET + 240 * 10**6), quote(TARGET + 900 * 10**6)]
    good = admit(spark, ok)
    assert {r.state for r in good.collect()} == {"APPROVED_FOR_SIMULATION_ONLY"} and good.count() == 6
    assert adm.require_unique_intents(good).count() == 6
    bad = admit(spark, ok, {"paper_only": False, "max_notional_usd": "30", "expected_source_sha256": "d" * 64}, {"approved_for_paper": False, "model_sha256": "zz"}, notional="26")
    reasons = bad.first().reasons
    assert reasons == sorted(["POLICY_PAPER_ONLY_REQUIRED", "POLICY_NOTIONAL_LIMIT_INVALID", "INTENT_NOTIONAL_LIMIT_EXCEEDED", "MODEL_NOT_APPROVED", "MODEL_EVIDENCE_HASH_INVALID", "SOURCE_COMPLETION_HASH_MISMATCH"])
    stale = {r.latency_ms: r.reasons for r in admit(spark, [quote(TARGET - 5)]).collect()}
    assert stale[0] == [] and stale[250] == [] and stale[1000] == ["QUOTE_ARRIVAL_STALE"]
    missing = admit(spark, [quote(TARGET + 5)]).filter("latency_ms = 0").first()
    assert missing.reasons == ["QUOTE_ARRIVAL_MISSING", "QUOTE_DECISION_MISSING"]


def test_admission_amounts_chain_and_ids(spark):
    texts = ["5", "005.500", "0.00000001", "0", "-1", "1e3", "1.123456789", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = df.select("i", adm.amount(F.col("t")).alias("a"), adm.canonical_amount(F.col("t")).alias("c")).orderBy("i").collect()
    assert [r.a is not None for r in rows] == [True, True, True, False, False, False, False, False, False]
    assert [r.c for r in rows[:3]] == ["5", "5.5", "0.00000001"]
    evaluated = admit(spark, [quote(TARGET - 5)])
    same = admit(spark, [quote(TARGET - 5)], notional="5.00")
    assert {r.intent_id for r in evaluated.collect()} == {r.intent_id for r in same.collect()}
    events = adm.lifecycle(evaluated)
    heads = adm.chain_heads(events)
    assert events.count() == 18 and {r.events for r in heads.collect()} == {3}
    altered = events.withColumn("payload", F.when(F.col("sequence") == 2, "X").otherwise(F.col("payload")))
    assert adm.chain_digest(heads).first().digest != adm.chain_digest(adm.chain_heads(altered)).first().digest
    totals = {(r.symbol, r.value): r.rows for r in adm.counts(evaluated).collect()}
    assert totals[(None, "APPROVED_FOR_SIMULATION_ONLY")] == totals[("SPY", "APPROVED_FOR_SIMULATION_ONLY")] == 4


def test_pages_parse_and_identity(spark):
    one = '{"t":"2026-09-04T13:30:00.000000001Z","bp":1.5,"ap":2,"bs":1,"as":"3","c":["R"],"z":"A","x":1}'
    same = '{"x":1,"z":"A","c":["R"],"as":"3","bs":1,"ap":2,"bp":1.5,"t":"2026-09-04T15:30:00.000000001+02:00"}'
    other = one.replace('"x":1', '"x":2').replace("true", "false")
    flag = '{"t":"2026-09-04T13:30:00","bp":true,"ap":2}'
    payload = f'{{"symbol":"SPY","records":[{one},{same},{other},{flag}],"next_page_token":null}}'
    pages = spark.createDataFrame([(1, payload), (1, '{"symbol":"SPY","records":[]}'), (2, '{"records":[],"next_page_token":"n"}'), (3, "broken")], "w int, payload string")
    rows = md.parse_quotes(pages).collect()
    assert len(rows) == 4 and len({r.identity for r in rows[:2]}) == 1 and len({r.identity for r in rows}) == 3
    assert rows[0].event_ns == BASE + 1 and rows[0].ask_size is None and rows[0].ask == 2.0
    assert rows[3].event_ns is None and rows[3].bid is None
    env = {r.w: r for r in md.envelope_summary(pages, ["w"]).collect()}
    assert (env[1].pages, env[1].records, env[1].complete) == (2, 4, True)
    assert env[2].complete is False and env[3].unreadable_pages == 1
