"""Intent admission audit: every blocker of every synthetic intent, never just the first.

Policy and model evidence are one-row tables; source and quote checks read the
replay scenario the intent refers to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import canonical_json, combine_words, word_sums
from ..functions.reasons import reason_array, require_unique
from ..functions.times import MILLI_NS
from .quality import CRYPTO_FEED, CRYPTO_PAIR
from .replay import LATENCIES_MS, LOOKAHEAD_NS, LOOKBACK_NS, MAX_PAGES, STOCK_SYMBOLS

# Hard caps, model scope, id prefix, accepted symbols and patterns.
HARD_NOTIONAL = "25"
HARD_MAX_AGE_MS = 1000
MODEL_SCOPE = "frozen_v2_gate_only_not_historical_prediction"
ID_PREFIX = "synthetic-v1-"
ID_SCHEMA = "synthetic-admission-v1"
SYMBOLS = (*STOCK_SYMBOLS, CRYPTO_PAIR)
SIDES = ("BUY", "SELL")
DECIMAL_PATTERN = r"^[0-9]+(\.[0-9]{1,8})?$"
HASH_PATTERN = r"^[0-9a-f]{64}$"


def amount(text: Column) -> Column:
    """Positive decimal with at most eight places, else NULL."""
    value = F.expr("NULL").cast("decimal(38,8)")
    ok = text.rlike(DECIMAL_PATTERN) & (F.length(text) <= 64)
    parsed = F.when(ok, text.try_cast("decimal(38,8)")).otherwise(value)
    return F.when(parsed > 0, parsed)


def canonical_amount(text: Column) -> Column:
    """Digits without leading or trailing zeros, by string work only."""
    whole = F.regexp_replace(F.split_part(text, F.lit("."), F.lit(1)), "^0+(?=[0-9])", "")
    fraction = F.regexp_replace(F.split_part(text, F.lit("."), F.lit(2)), "0+$", "")
    return F.when(F.length(fraction) > 0, F.concat_ws(".", whole, fraction)).otherwise(whole)


def is_hash(text: Column) -> Column:
    return F.coalesce(text.rlike(HASH_PATTERN), F.lit(False))


def generate_intents(windows: DataFrame, by: list[str], notional: str = "5", latencies_ms=LATENCIES_MS) -> DataFrame:
    """Windows x latencies x sides; the multipliers are fixed short lists."""
    return (
        windows.select(*by, "symbol", F.col("target_ns").alias("decision_ns"), "source_sha256")
        .withColumn("latency_ms", F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in latencies_ms])))
        .withColumn("side", F.explode(F.array(*[F.lit(s) for s in SIDES])))
        .withColumn("notional_decimal", F.lit(notional))
        .withColumn("intent_id", intent_id())
    )


def intent_id() -> Column:
    fields = F.struct(
        F.lit(ID_SCHEMA).alias("schema"), F.col("decision_ns"), F.col("latency_ms"),
        canonical_amount(F.col("notional_decimal")).alias("notional_decimal"), F.col("side"),
        F.col("source_sha256").alias("source"), F.col("symbol"),
    )
    return F.concat(F.lit(ID_PREFIX), F.sha2(F.to_json(fields, {"ignoreNullFields": "false"}), 256))


def require_unique_intents(intents: DataFrame) -> DataFrame:
    return require_unique(intents, ["intent_id"], "intent")


def intent_checks(limit: Column) -> list:
    value = amount(F.col("notional_decimal"))
    source = F.col("source_sha256")
    return [
        ("INTENT_SYMBOL_UNSUPPORTED", ~F.col("symbol").isin(*SYMBOLS)),
        ("INTENT_SIDE_INVALID", ~F.col("side").isin(*SIDES)),
        ("INTENT_NOTIONAL_INVALID", value.isNull()),
        ("INTENT_DECISION_TIME_INVALID", F.col("decision_ns").isNull()),
        ("INTENT_LATENCY_INVALID", ~F.col("latency_ms").isin(*LATENCIES_MS)),
        ("INTENT_SOURCE_HASH_INVALID", source.isNotNull() & ~is_hash(source)),
        ("INTENT_NOTIONAL_LIMIT_EXCEEDED", F.coalesce(value > limit, F.lit(False))),
        ("INTENT_ID_MISMATCH", ~F.col("intent_id").eqNullSafe(intent_id())),
    ]


def policy_checks(policy: str = "policy") -> list:
    p = lambda c: F.col(f"{policy}.{c}")
    limit = amount(p("max_notional_usd"))
    expected = p("expected_source_sha256")
    return [
        ("POLICY_PAPER_ONLY_REQUIRED", ~p("paper_only").eqNullSafe(F.lit(True))),
        ("POLICY_EXECUTION_MUST_BE_DISABLED", ~p("execution_enabled").eqNullSafe(F.lit(False))),
        ("POLICY_NOTIONAL_LIMIT_INVALID", limit.isNull() | F.coalesce(limit > F.lit(HARD_NOTIONAL).cast("decimal(38,8)"), F.lit(False))),
        ("POLICY_QUOTE_AGE_LIMIT_INVALID", ~F.coalesce(p("max_quote_age_ms").between(0, HARD_MAX_AGE_MS), F.lit(False))),
        (
            "POLICY_EXPECTED_FEED_INVALID",
            ~F.coalesce(p("expected_stock_feed").isin("sip", "iex") & (p("expected_crypto_feed") == CRYPTO_FEED), F.lit(False)),
        ),
        ("POLICY_SOURCE_HASH_INVALID", expected.isNotNull() & ~is_hash(expected)),
    ]


def effective_limit(policy: str = "policy") -> Column:
    """The policy amount when valid, else the hard cap."""
    cap = F.lit(HARD_NOTIONAL).cast("decimal(38,8)")
    limit = amount(F.col(f"{policy}.max_notional_usd"))
    return F.when(limit <= cap, limit).otherwise(cap)


def effective_age(policy: str = "policy") -> Column:
    age = F.col(f"{policy}.max_quote_age_ms")
    return F.when(age.between(0, HARD_MAX_AGE_MS), age).otherwise(F.lit(HARD_MAX_AGE_MS))


def model_checks(evidence: str = "evidence") -> list:
    e = lambda c: F.col(f"{evidence}.{c}")
    digest = e("model_sha256")
    approved = F.coalesce(e("approved_for_paper"), F.lit(False))
    return [
        ("MODEL_EVIDENCE_UNVERIFIED", ~F.coalesce(e("verified"), F.lit(False))),
        ("MODEL_NOT_APPROVED", ~approved),
        ("MODEL_EVIDENCE_SCOPE_INVALID", ~e("scope").eqNullSafe(F.lit(MODEL_SCOPE))),
        ("MODEL_EVIDENCE_HASH_INVALID", digest.isNotNull() & ~is_hash(digest)),
        ("MODEL_EVIDENCE_HASH_REQUIRED", approved & digest.isNull()),
    ]


def source_checks(policy: str = "policy", lookback: int = LOOKBACK_NS, lookahead: int = LOOKAHEAD_NS) -> list:
    """Checks of the replayed window behind an intent."""
    p = lambda c: F.col(f"{policy}.{c}")
    target = F.col("decision_ns")
    end = target + lookahead
    expected_feed = F.when(F.col("symbol") == CRYPTO_PAIR, p("expected_crypto_feed")).otherwise(p("expected_stock_feed"))
    expected = p("expected_source_sha256")
    return [
        ("SOURCE_REJECTED", F.size("source_reasons") != 0),
        ("SOURCE_SYMBOL_MISMATCH", ~F.col("declared_symbol").eqNullSafe(F.col("symbol"))),
        ("SOURCE_FEED_MISMATCH", ~F.col("feed").eqNullSafe(expected_feed)),
        ("SOURCE_METADATA_INVALID", ~(F.col("kind").eqNullSafe(F.lit("quotes")) & F.coalesce(F.col("complete"), F.lit(False)))),
        ("SOURCE_PAGE_COUNT_INVALID", ~F.coalesce(F.col("pages").between(1, MAX_PAGES), F.lit(False))),
        ("SOURCE_TARGET_TIME_MISMATCH", ~F.col("target_ns").eqNullSafe(target)),
        (
            "SOURCE_WINDOW_COVERAGE_INVALID",
            ~(F.col("start_ns").eqNullSafe(target - lookback) & F.col("end_ns").eqNullSafe(end)),
        ),
        ("SOURCE_OBSERVATION_TIME_INVALID", ~F.coalesce(F.col("observed_ns") >= end, F.lit(False))),
        ("SOURCE_EVENT_INTEGRITY_INVALID", F.coalesce(F.col("unparseable_timestamp") > 0, F.lit(False))),
        ("SOURCE_COMPLETION_HASH_MISMATCH", expected.isNotNull() & ~F.col("source_sha256").eqNullSafe(expected)),
    ]


def quote_checks(
    label: str, state: str, asof: Column, max_age_ms: Column, lookback: int = LOOKBACK_NS, lookahead: int = LOOKAHEAD_NS
) -> list:
    """Checks of one quote state; used for the decision and for the arrival.

    ``state`` is a struct (status, event_ns, age_ms, quote, reasons). Age is recomputed
    from the instants, never trusted.
    """
    s = lambda c: F.col(f"{state}.{c}")
    no = F.lit(False)
    event, status = s("event_ns"), s("status")
    valid = F.coalesce(status == "VALID", no)
    known = event.isNotNull()
    target = F.col("decision_ns")
    quote = s("quote")
    present = quote.isNotNull()
    stock = F.col("symbol").isin(*STOCK_SYMBOLS)
    age_ns = asof - event
    sizes = F.least(quote["bid"], quote["ask"], quote["bid_size"], quote["ask_size"])
    out = [(f"QUOTE_{label}_{name}", F.coalesce(status == name, no)) for name in ("INVALID", "MISSING", "SOURCE_REJECTED")]
    checks = [
        ("MISSING_STATE", F.col(state).isNull()),
        ("STATUS_INVALID", ~F.coalesce(status.isin("VALID", "STALE", "INVALID", "MISSING", "SOURCE_REJECTED"), no)),
        ("STALE", F.coalesce(status == "STALE", no) | F.coalesce(age_ns > max_age_ms * F.lit(MILLI_NS), no)),
        ("STATE_INCONSISTENT", (valid & (F.size(s("reasons")) != 0)) | (present & ~F.coalesce(status.isin("VALID", "STALE"), no))),
        ("EVENT_TIME_INVALID", valid & ~known),
        ("EVENT_NOT_STRICTLY_PRIOR", F.coalesce(event >= asof, no)),
        (
            "EVENT_OUTSIDE_SOURCE_WINDOW",
            F.coalesce((event < target - lookback) | (event >= target + lookahead), no),
        ),
        ("AGE_INCONSISTENT", known & ~F.coalesce(F.abs(s("age_ms") - age_ns / 1e6) <= 1e-9 + 1e-12 * F.abs(age_ns / 1e6), no)),
        ("PAYLOAD_MISSING", valid & ~present),
        ("PRICE_OR_SIZE_INVALID", present & ~F.coalesce(sizes > 0, no)),
        ("LOCKED_OR_CROSSED", present & F.coalesce(quote["bid"] >= quote["ask"], no)),
        ("CONDITION_INVALID", present & stock & ~F.coalesce(quote["conditions"] == F.array(F.lit("R")), no)),
        ("TAPE_INVALID", present & stock & ~F.coalesce(quote["tape"].isin("A", "B", "C"), no)),
    ]
    return out + [(f"QUOTE_{label}_{name}", cond) for name, cond in checks]


def cross_checks(decision: str, arrival: str) -> list:
    """Arrival against decision: no regression, same event means same content, zero latency is equality."""
    d, a = (lambda c: F.col(f"{decision}.{c}")), (lambda c: F.col(f"{arrival}.{c}"))
    no = F.lit(False)
    both_valid = F.coalesce((d("status") == "VALID") & (a("status") == "VALID"), no)
    reference = F.col("buy_reference_price").eqNullSafe(a("quote.ask")) & F.col("sell_reference_price").eqNullSafe(a("quote.bid"))
    return [
        ("QUOTE_ARRIVAL_EVENT_REGRESSION", F.coalesce(a("event_ns") < d("event_ns"), no)),
        (
            "QUOTE_ARRIVAL_SAME_EVENT_CONTENT_MISMATCH",
            F.coalesce(a("event_ns") == d("event_ns"), no) & ~a("quote").eqNullSafe(d("quote")),
        ),
        (
            "QUOTE_ARRIVAL_SCENARIO_STATUS_INCONSISTENT",
            both_valid & (F.col("scenario_status") != "QUOTE_ELIGIBLE_NO_FILL_ASSUMED"),
        ),
        ("QUOTE_ARRIVAL_REFERENCE_PRICE_INCONSISTENT", both_valid & ~reference),
        (
            "QUOTE_ARRIVAL_ZERO_LATENCY_STATE_MISMATCH",
            (F.col("latency_ms") == 0) & ~F.struct(a("status"), a("event_ns"), a("quote")).eqNullSafe(
                F.struct(d("status"), d("event_ns"), d("quote"))
            ),
        ),
    ]


def evaluate(
    intents: DataFrame, scenario_rows: DataFrame, policy: DataFrame, evidence: DataFrame, by: list[str],
    lookback: int = LOOKBACK_NS, lookahead: int = LOOKAHEAD_NS,
) -> DataFrame:
    """State and sorted reasons per intent. ``policy`` and ``evidence`` have one row each.

    An intent without its scenario stays and is rejected for it.
    """
    state = F.struct("status", "event_ns", "age_ms", "quote", "reasons")
    context = scenario_rows.select(
        *by, "latency_ms", "target_ns", "declared_symbol", "kind", "feed", "complete", "pages", "start_ns", "end_ns",
        "observed_ns", "source_reasons", "unparseable_timestamp", "scenario_status", "buy_reference_price",
        "sell_reference_price", "decision", state.alias("arrival"),
    )
    joined = intents.join(context, [*by, "latency_ms"], "left").withColumns(
        {
            "policy": policy.select(F.struct("*")).scalar(),
            "evidence": evidence.select(F.struct("*")).scalar(),
        }
    )
    arrival_at = F.col("decision_ns") + F.col("latency_ms") * F.lit(MILLI_NS)
    age = effective_age()
    groups = {
        "intent": intent_checks(effective_limit()),
        "policy": policy_checks(),
        "model": model_checks(),
        "source": source_checks(lookback=lookback, lookahead=lookahead),
        "decision_quote": quote_checks("DECISION", "decision", F.col("decision_ns"), age, lookback, lookahead),
        "arrival_quote": quote_checks("ARRIVAL", "arrival", arrival_at, age, lookback, lookahead) + cross_checks("decision", "arrival"),
    }
    checked = joined.withColumns({f"{name}_reasons": F.array_sort(F.array_distinct(reason_array(c))) for name, c in groups.items()})
    everything = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{n}_reasons") for n in groups]))))
    return checked.withColumn("all_reasons", everything).select(
        *intents.columns, *[f"{n}_reasons" for n in groups], F.col("all_reasons").alias("reasons"),
        F.when(F.size("all_reasons") == 0, "APPROVED_FOR_SIMULATION_ONLY").otherwise("REJECTED").alias("state"),
    )


def lifecycle(evaluated: DataFrame) -> DataFrame:
    """Three events per intent: created, checked, terminal state."""
    step = lambda n, name, payload: F.struct(F.lit(n).alias("sequence"), name.alias("event"), payload.alias("payload"))
    none = F.lit(None).cast("string")
    return evaluated.select(
        "intent_id",
        F.inline(
            F.array(
                step(1, F.lit("INTENT_CREATED"), none),
                step(2, F.lit("CHECKS_COMPLETED"), F.array_join("reasons", ",")),
                step(3, F.col("state"), none),
            )
        ),
    )


def chain_heads(events: DataFrame) -> DataFrame:
    """Hash chain of each intent's three events: intent_id, events, head."""
    payload = canonical_json(["sequence", "event", "intent_id", "payload"])
    collected = events.withColumn("_p", payload).groupBy("intent_id").agg(
        F.array_sort(F.collect_list(F.struct("sequence", "_p"))).alias("_events")  # three per intent
    )
    head = F.aggregate(
        "_events", F.lit("0" * 64), lambda acc, e: F.sha2(F.concat(acc, e["_p"]), 256)
    )
    return collected.select("intent_id", F.size("_events").alias("events"), head.alias("head"))


def chain_digest(heads: DataFrame) -> DataFrame:
    """One digest over all chain heads, independent of their order."""
    summed = heads.agg(F.count(F.lit(1)).alias("rows"), *word_sums(F.sha2(F.concat("intent_id", "head"), 256)))
    return summed.select(F.col("rows").alias("intents"), combine_words().alias("digest"))


def counts(evaluated: DataFrame) -> DataFrame:
    """Long counts (symbol, measure, value, rows) of states and reasons, with totals as NULL symbol."""
    fact = lambda measure, value: F.struct(F.lit(measure).alias("measure"), value.alias("value"))
    facts = F.concat(F.array(fact("state", F.col("state"))), F.transform("reasons", lambda r: fact("reason", r)))
    rows = evaluated.select("symbol", F.inline(facts))
    symbol, measure, value = F.col("symbol"), F.col("measure"), F.col("value")
    return rows.groupingSets([[symbol, measure, value], [measure, value]], symbol, measure, value).agg(
        F.count(F.lit(1)).alias("rows")
    )
