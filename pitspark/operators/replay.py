"""As-of quote replay: the latest update strictly before an instant governs, valid or not.

An invalid or ambiguous update poisons the state until the next valid one; older
quotes never shine through. Records are keyed by ``by`` (one fetched window each).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.asof import OUTER_BINS, asof_join
from ..functions.reasons import finite, reason_array
from ..functions.scan import Running, running
from ..functions.times import MILLI_NS, MINUTE_NS, SECOND_NS
from .quality import CRYPTO_FEED, CRYPTO_PAIR, STOCK_FEEDS, mid, spread_bps

# Symbols with stock conditions, latencies, window, page and record limits.
STOCK_SYMBOLS = ("SPY", "JPM", "XOM", "WMT", "JNJ")
LATENCIES_MS = (0, 250, 1000)
LOOKBACK_NS = 5 * SECOND_NS
LOOKAHEAD_NS = 2 * SECOND_NS
MAX_AGE_MS = 1000
MAX_PAGES = 3
MAX_RECORDS = 30_000

STATUSES = ("SOURCE_REJECTED", "MISSING", "INVALID", "STALE", "VALID")


def event_reasons() -> Column:
    """Why an update invalidates the state (empty when it is a usable quote)."""
    stock = F.col("symbol").isin(*STOCK_SYMBOLS)
    prices_ok = F.lit(True)
    for name in ("bid", "ask", "bid_size", "ask_size"):
        prices_ok = prices_ok & finite(F.col(name)) & F.coalesce(F.col(name) > 0, F.lit(False))
    return reason_array(
        [
            (
                "stock_condition_not_exact_single_regular_R",
                stock & ~F.coalesce(F.col("conditions") == F.array(F.lit("R")), F.lit(False)),
            ),
            ("stock_tape_missing_or_unknown", stock & ~F.coalesce(F.col("tape").isin("A", "B", "C"), F.lit(False))),
            ("quote_price_or_size_nonpositive_nonfinite_or_malformed", ~prices_ok),
            ("crossed_quote", prices_ok & (F.col("bid") > F.col("ask"))),
            ("locked_quote", prices_ok & (F.col("bid") == F.col("ask"))),
        ]
    )


def condition_shape(present: Column, conditions: Column) -> Column:
    """Sanitised shape of the raw condition field."""
    return F.when(~present, "missing").when(conditions.isNull(), "malformed").otherwise("list_of_strings")


def events(records: DataFrame, by: list[str], identity: str = "identity") -> DataFrame:
    """One row per (window, instant): validity, reasons and the quote when usable.

    Exact copies collapse first; more than one distinct update at an instant is
    ambiguous. Both groupings combine before their shuffle.
    """
    in_window = records.filter(F.col("event_ns").between(F.col("start_ns"), F.col("end_ns") - 1))
    tagged = in_window.dropDuplicates([*by, "event_ns", identity]).withColumn("_reasons", event_reasons())
    quote = F.struct("bid", "ask", "bid_size", "ask_size", "tape", "conditions", identity)
    grouped = tagged.groupBy(*by, "event_ns").agg(
        F.count(F.lit(1)).alias("updates"),
        F.max(quote).alias("_q"),
        # a union of a handful of fixed codes, not a list of rows
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_reasons")))).alias("_all"),
    )
    ambiguous = F.col("updates") > 1
    reasons = F.when(
        ambiguous, F.concat("_all", F.array(F.lit("distinct_same_timestamp_updates_unsequenced")))
    ).otherwise(F.col("_all"))
    valid = ~ambiguous & (F.size("_all") == 0)
    return grouped.select(
        *by, "event_ns", "updates", valid.alias("valid"), reasons.alias("reasons"), F.when(valid, F.col("_q")).alias("quote")
    )


def global_rejections(records: DataFrame, by: list[str]) -> DataFrame:
    """Windows rejected as a whole: an update that cannot be ordered or names another symbol."""
    return records.groupBy(*by).agg(
        F.count(F.lit(1)).alias("received"),
        F.count_if(F.col("event_ns").isNull()).alias("unparseable_timestamp"),
        F.count_if(F.coalesce(F.col("record_symbol") != F.col("symbol"), F.lit(False))).alias("wrong_symbol"),
    )


def source_reasons(target: Column, lookback: int = LOOKBACK_NS, lookahead: int = LOOKAHEAD_NS) -> Column:
    """Why a whole window cannot be used."""
    symbol, feed = F.col("symbol"), F.col("feed")
    allowed = F.when(symbol == CRYPTO_PAIR, feed == CRYPTO_FEED).otherwise(feed.isin(*STOCK_FEEDS))
    start, end = target - lookback, target + lookahead
    return F.array_sort(
        reason_array(
            [
                ("fetch_symbol_missing_or_wrong", ~F.col("declared_symbol").eqNullSafe(symbol)),
                ("fetch_kind_missing_or_wrong", ~F.col("kind").eqNullSafe(F.lit("quotes"))),
                ("feed_missing_or_unsupported_for_symbol", ~F.coalesce(allowed, F.lit(False))),
                ("fetch_incomplete_or_truncated", ~F.coalesce(F.col("complete"), F.lit(False))),
                ("fetch_page_count_missing_or_invalid", ~F.coalesce(F.col("pages").between(1, MAX_PAGES), F.lit(False))),
                (
                    "fetch_range_not_exact_target_range",
                    ~(F.col("start_ns").eqNullSafe(start) & F.col("end_ns").eqNullSafe(end)),
                ),
                (
                    "observation_time_missing_or_before_window_end",
                    F.col("observed_ns").isNull() | F.coalesce(F.col("observed_ns") < end, F.lit(True)),
                ),
                ("record_count_exceeds_research_limit", F.coalesce(F.col("received") > F.col("max_records"), F.lit(False))),
                ("event_timestamp_missing_or_unparseable_cannot_order", F.coalesce(F.col("unparseable_timestamp") > 0, F.lit(False))),
                ("record_declares_wrong_symbol", F.coalesce(F.col("wrong_symbol") > 0, F.lit(False))),
            ]
        )
    )


def usable_windows(
    windows: DataFrame, records: DataFrame, by: list[str], target: str = "target_ns", lookback: int = LOOKBACK_NS,
    lookahead: int = LOOKAHEAD_NS, max_records: int | None = None,
) -> DataFrame:
    """Planned windows with ``source_reasons``; the record limit is off unless given."""
    checked = windows.join(global_rejections(records, by), by, "left").withColumn(
        "max_records", F.lit(max_records).cast("bigint")
    )
    return checked.withColumn("source_reasons", source_reasons(F.col(target), lookback, lookahead)).drop("max_records")


def states(
    asks: DataFrame, events_: DataFrame, by: list[str], asof: str, max_age_ms: int = MAX_AGE_MS,
    bin_width: int = MINUTE_NS,
) -> DataFrame:
    """State strictly before ``asof`` for rows that carry ``source_reasons``.

    Adds status, event_ns, age_ms, quote and reasons. An age equal to the limit is valid.
    """
    matched = asof_join(
        asks, events_, by, asof, "event_ns", {"_e": F.struct("valid", "reasons", "quote", "updates")}, strict=True,
        bin_width=bin_width,
    )
    rejected = F.size("source_reasons") > 0
    age = F.col(asof) - F.col("_e_at")
    status = (
        F.when(rejected, "SOURCE_REJECTED").when(F.col("_e").isNull(), "MISSING").when(~F.col("_e.valid"), "INVALID")
        .when(age > max_age_ms * MILLI_NS, "STALE").otherwise("VALID")
    )
    reasons = (
        F.when(rejected, F.col("source_reasons"))
        .when(F.col("_e").isNull(), F.array(F.lit("no_event_strictly_before_asof")))
        .when(~F.col("_e.valid"), F.col("_e.reasons"))
        .when(age > max_age_ms * MILLI_NS, F.array(F.lit("latest_update_older_than_max_age")))
        .otherwise(F.array().cast("array<string>"))
    )
    shown = lambda c: F.when(~rejected, c)
    return matched.select(
        *asks.columns, status.alias("status"), shown(F.col("_e_at")).alias("event_ns"), shown(age / 1e6).alias("age_ms"),
        shown(F.col("_e.quote")).alias("quote"), shown(F.col("_e.updates")).alias("updates"), reasons.alias("reasons"),
    )


def scenarios(
    windows: DataFrame, events_: DataFrame, by: list[str], latencies_ms=LATENCIES_MS, max_age_ms: int = MAX_AGE_MS,
    bin_width: int = MINUTE_NS,
) -> DataFrame:
    """Decision state and one arrival state per latency; a blocked decision dominates.

    Decision and arrivals are matched in one as-of pass: arrival at latency zero is
    the decision itself.
    """
    offsets = sorted({0, *latencies_ms})
    asks = windows.withColumn("latency_ms", F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in offsets]))).withColumn(
        "arrival_ns", F.col("target_ns") + F.col("latency_ms") * F.lit(MILLI_NS)
    )
    matched = states(asks, events_, by, "arrival_ns", max_age_ms, bin_width)
    # as many rows per window as latencies
    decision = F.max(
        F.when(F.col("latency_ms") == 0, F.struct("status", "event_ns", "age_ms", "quote", "reasons"))
    ).over(W.partitionBy(*by, "target_ns"))
    joined = matched.withColumn("decision", decision)
    eligible = (F.col("decision.status") == "VALID") & (F.col("status") == "VALID")
    outcome = (
        F.when(eligible, "QUOTE_ELIGIBLE_NO_FILL_ASSUMED")
        .when(F.col("decision.status") != "VALID", "DECISION_BLOCKED").otherwise("ARRIVAL_BLOCKED")
    )
    return joined.filter(F.col("latency_ms").isin(*latencies_ms)).withColumns(
        {
            "scenario_status": outcome,
            "buy_reference_price": F.when(eligible, F.col("quote.ask")),
            "sell_reference_price": F.when(eligible, F.col("quote.bid")),
            "mid_price": F.when(eligible, mid(F.col("quote.bid"), F.col("quote.ask"))),
            "full_spread_bps": F.when(eligible, spread_bps(F.col("quote.bid"), F.col("quote.ask"))),
        }
    )


def transition_counters(events_: DataFrame, by: list[str], bin_width: int = SECOND_NS) -> DataFrame:
    """Transitions, invalid updates, invalidations, recoveries, ambiguity and first valid seed per window.

    The state before an update comes from a binned scan, so one heavy window is not one task.
    """
    binned = events_.withColumns(
        {
            "_outer": F.expr(f"event_ns div {bin_width * OUTER_BINS}"),
            "_inner": F.expr(f"event_ns div {bin_width}"),
        }
    )
    stepped = running(binned, by, ["_outer", "_inner"], ["event_ns"], [Running("_prev", F.col("valid"), "prev")])
    return stepped.groupBy(*by).agg(
        F.count(F.lit(1)).alias("state_transitions"),
        F.count_if(~F.col("valid")).alias("invalid_state_updates"),
        F.count_if(F.col("_prev") & ~F.col("valid")).alias("invalidations"),
        F.count_if(~F.col("_prev") & F.col("valid")).alias("recoveries"),
        F.count_if(F.col("updates") > 1).alias("ambiguous_groups"),
        F.min(F.when(F.col("valid"), F.col("event_ns"))).alias("first_valid_ns"),
    )


def record_counters(records: DataFrame, by: list[str], identity: str = "identity") -> DataFrame:
    """Received, in-window, outside, exact duplicates and unique records per window."""
    inside = F.coalesce(F.col("event_ns").between(F.col("start_ns"), F.col("end_ns") - 1), F.lit(False))
    per_record = records.withColumn("_in", inside).groupBy(*by, "event_ns", identity, "_in").agg(
        F.count(F.lit(1)).alias("_n")
    )
    return per_record.groupBy(*by).agg(
        F.sum("_n").alias("received"),
        F.sum(F.when(F.col("_in"), F.col("_n")).otherwise(0)).alias("in_window"),
        F.sum(F.when(~F.col("_in") & F.col("event_ns").isNotNull(), F.col("_n")).otherwise(0)).alias("outside"),
        F.sum(F.when(F.col("_in"), F.col("_n") - 1).otherwise(0)).alias("exact_duplicates"),
        F.count_if("_in").alias("unique_events"),
    )


def aggregate(scenario_rows: DataFrame) -> DataFrame:
    """Long counts (symbol, window_name, measure, latency_ms, value, rows); totals have NULL keys.

    One pass: every scenario row is unfolded into its counted facts, and group and
    total counts share a single partial aggregation.
    """

    def fact(measure: str, value: Column, latency: Column) -> Column:
        return F.struct(F.lit(measure).alias("measure"), latency.cast("bigint").alias("latency_ms"), value.alias("value"))

    latency, none = F.col("latency_ms"), F.lit(None).cast("bigint")
    always = F.array(fact("scenario", F.col("scenario_status"), latency), fact("arrival_state", F.col("status"), latency))
    decision = F.concat(
        F.array(fact("decision_state", F.col("decision.status"), none)),
        F.transform(F.array_distinct("decision.reasons"), lambda r: fact("decision_reason", r, none)),
    )
    facts = F.when(latency == 0, F.concat(always, decision)).otherwise(always)
    rows = scenario_rows.select("symbol", "window_name", F.inline(facts))
    keys = ["symbol", "window_name", "measure", "latency_ms", "value"]
    return rows.groupingSets([[F.col(k) for k in keys], [F.col(k) for k in keys[2:]]], *[F.col(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("rows")
    )


def mismatches(saved: DataFrame, rebuilt: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose saved scenario differs from the rebuilt one (NULL-safe)."""
    columns = [c for c in saved.columns if c not in keys]
    left = saved.select(*keys, F.struct(*columns).alias("_a"))
    right = rebuilt.select(*keys, F.struct(*columns).alias("_b"))
    return left.join(right, keys, "full").filter(~F.col("_a").eqNullSafe(F.col("_b"))).select(*keys)
