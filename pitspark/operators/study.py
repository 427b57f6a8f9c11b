"""Multi-session study: latency scenarios per planned window and equal-session aggregates.

The plan drives everything: a planned window without data stays in the result as
unavailable, and every aggregate counts it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.reasons import reason_array, require_unique
from ..functions.times import MILLI_NS, MINUTE_NS, SECOND_NS
from .quality import WAIT_NS, feed_allowed, first_quotes, source_reasons

# Latencies and the planned quote range.
LATENCIES_MS = (0, 250, 1000)
WINDOW_NS = 60 * SECOND_NS


def strict_source_reasons(window_ns: int = WINDOW_NS) -> Column:
    """Envelope checks of a planned quote fetch: exact range, mandatory symbol and kind, feed."""
    target = F.col("target_ns")
    base = source_reasons("quotes", "quotes", target, target + window_ns)
    return reason_array(
        [
            *base,
            ("quotes_symbol_missing", F.col("declared_symbol").isNull()),
            ("quotes_kind_missing", F.col("kind").isNull()),
            (
                "quotes_fetch_range_is_not_exact_planned_window",
                ~(F.col("start_ns").eqNullSafe(target) & F.col("end_ns").eqNullSafe(target + window_ns)),
            ),
            ("fetch_incomplete_or_truncated", ~F.coalesce(F.col("complete"), F.lit(False))),
            ("unknown_or_unsupported_feed_for_symbol", ~feed_allowed(F.col("symbol"), F.col("feed"))),
            ("quote_feed_differs_from_bar_feed", ~F.col("feed").eqNullSafe(F.col("bar_feed"))),
        ]
    )


def latency_scenarios(
    windows: DataFrame, instants: DataFrame, by: list[str], latencies_ms=LATENCIES_MS, wait_ns: int = WAIT_NS,
    bin_width: int = MINUTE_NS,
) -> DataFrame:
    """One row per planned window and latency, paired with its own zero-latency quote.

    ``windows`` holds ``by``, ``symbol``, ``target_ns`` and ``source_reasons``.
    """
    shifted = windows.withColumn("latency_ms", F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in latencies_ms]))).withColumn(
        "shifted_ns", F.col("target_ns") + F.col("latency_ms") * F.lit(MILLI_NS)
    )
    found = first_quotes(shifted, instants, by, "shifted_ns", wait_ns, bin_width)
    quote_reason = F.when(F.col("ambiguous"), "first_quote_ambiguous_without_sequence").when(
        F.col("mid_price").isNull(), "no_valid_timely_quote"
    )
    reasons = F.array_compact(F.concat(F.col("source_reasons"), F.array(quote_reason)))
    available = F.size("reasons") == 0
    keep = lambda c: F.when(available, F.col(c))
    rows = found.withColumn("reasons", reasons).withColumns(
        {
            "available": available,
            "first_ns": keep("first_ns"), "bid": keep("bid"), "ask": keep("ask"),
            "full_spread_bps": keep("full_spread_bps"),
            "wait_seconds": F.when(available, (F.col("first_ns") - F.col("shifted_ns")) / 1e9),
        }
    )
    # one group per window and target: as many rows as latencies
    same_window = W.partitionBy(*by, "target_ns")
    zero = lambda c: F.max(F.when(F.col("latency_ms") == 0, F.col(c))).over(same_window)
    paired = rows.withColumns({"_z_ns": zero("first_ns"), "_z_ask": zero("ask"), "_z_bid": zero("bid")})
    has_pair = F.col("available") & F.col("_z_ns").isNotNull()
    return paired.withColumns(
        {
            "paired_with_zero": has_pair,
            "event_gap_ms": F.when(has_pair, (F.col("first_ns") - F.col("_z_ns")) / 1e6),
            "ask_displacement_bps": F.when(has_pair, (F.col("ask") / F.col("_z_ask") - 1) * 10000),
            "bid_displacement_bps": F.when(has_pair, (F.col("bid") / F.col("_z_bid") - 1) * 10000),
            "reasons": F.when(
                F.col("available") & F.col("_z_ns").isNull(),
                F.concat("reasons", F.array(F.lit("zero_latency_baseline_unavailable"))),
            ).otherwise(F.col("reasons")),
        }
    ).drop("_z_ns", "_z_ask", "_z_bid", "mid_price", "bid_size", "ask_size", "first_count")


def session_stats(value: str, prefix: str = "") -> list[Column]:
    """Equal-session-weight statistics; a group has one value per session."""
    v = F.col(value)
    return [
        F.count(v).alias(f"{prefix}count"), F.min(v).alias(f"{prefix}min"),
        F.percentile(v, 0.5).alias(f"{prefix}median"), F.percentile(v, 0.9).alias(f"{prefix}p90"),
        F.max(v).alias(f"{prefix}max"), F.max(F.abs(v)).alias(f"{prefix}absolute_max"),
    ]


def require_one_per_session(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Fail on two rows of one planned observation."""
    return require_unique(rows, keys or ["symbol", "session_date", "window_name", "latency_ms"], "study observation")


def mixed_feed_guard(rows: DataFrame) -> DataFrame:
    """Adds ``pooling_allowed``: at most one known feed per symbol."""
    feeds = rows.groupBy("symbol").agg((F.count_distinct("feed") <= 1).alias("pooling_allowed"))
    return rows.join(feeds, "symbol")


def aggregate_latency(rows: DataFrame) -> DataFrame:
    """Per (symbol, window, latency): every planned sample counted, statistics over usable sessions."""
    guarded = mixed_feed_guard(rows)
    usable = F.col("available") & F.col("pooling_allowed")
    pooled = guarded.withColumns(
        {
            "_spread": F.when(usable, F.col("full_spread_bps")),
            "_paired_spread": F.when(usable & F.col("paired_with_zero"), F.col("full_spread_bps")),
            "_paired": F.when(usable & F.col("paired_with_zero"), F.col("ask_displacement_bps")),
            "_bid": F.when(usable & F.col("paired_with_zero"), F.col("bid_displacement_bps")),
            "_gap": F.when(usable & F.col("paired_with_zero"), F.col("event_gap_ms")),
            "_wait": F.when(usable, F.col("wait_seconds")),
        }
    )
    return pooled.groupBy("symbol", "window_name", "latency_ms").agg(
        F.count(F.lit(1)).alias("expected_samples"),
        F.count_if(usable).alias("available_samples"),
        F.count_if(~usable).alias("unavailable_samples"),
        F.count_if(usable & F.col("paired_with_zero")).alias("paired_with_zero_samples"),
        *session_stats("_spread", "spread_"),
        *session_stats("_paired_spread", "paired_spread_"),
        *session_stats("_paired", "ask_displacement_"),
        *session_stats("_bid", "bid_displacement_"),
        F.percentile("_gap", 0.5).alias("gap_median_ms"),
        F.percentile("_wait", 0.5).alias("wait_median_s"),
    )


def aggregate_windows(windows: DataFrame) -> DataFrame:
    """Per (symbol, window): the sample counters. One row per planned window comes in.

    Symbols seen on several feeds have no usable samples; the other counters still show every row.
    """
    guarded = mixed_feed_guard(windows)
    usable, shaped = F.col("usable") & F.col("pooling_allowed"), F.col("distribution_usable") & F.col("pooling_allowed")
    metadata = F.array_except("source_reasons", F.array(F.lit("fetch_incomplete_or_truncated")))
    pooled = guarded.withColumn("_spread", F.when(usable, F.col("full_spread_bps")))
    return pooled.groupBy("symbol", "window_name").agg(
        F.count(F.lit(1)).alias("expected_samples"),
        F.count_if(usable).alias("usable_selected_samples"),
        F.count_if(~usable).alias("unusable_selected_samples"),
        F.count_if(shaped).alias("usable_distribution_samples"),
        F.count_if(F.col("received_count") == 0).alias("missing_window_count"),
        F.count_if(~F.col("complete")).alias("incomplete_window_count"),
        F.count_if(F.col("invalid_count") > 0).alias("invalid_quote_window_count"),
        F.sum("invalid_count").alias("invalid_quote_record_count"),
        F.count_if(F.size(metadata) > 0).alias("invalid_source_metadata_window_count"),
        F.count_if(F.size("source_reasons") > 0).alias("unusable_source_window_count"),
        F.count_if(F.col("timely_valid_quote_count") == 0).alias("no_timely_valid_quote_window_count"),
        F.count_if("ambiguous").alias("ambiguous_first_quote_window_count"),
        *session_stats("_spread", "selected_spread_"),
    )


def reason_counts(rows: DataFrame, by: list[str], reasons: str = "reasons") -> DataFrame:
    """How many rows carry each reason (once per row)."""
    return rows.select(*by, F.explode(F.array_distinct(reasons)).alias("reason")).groupBy(*by, "reason").agg(
        F.count(F.lit(1)).alias("rows")
    )


def observation_windows(plan: DataFrame, counters: DataFrame, zero: DataFrame, by: list[str]) -> DataFrame:
    """Planned windows with their counters and zero-latency outcome; unfetched ones are unavailable."""
    counts = ["received_count", "invalid_count", "valid_count", "timely_valid_quote_count"]
    picked = zero.filter("latency_ms = 0").select(*by, "available", "ambiguous", "full_spread_bps", "reasons")
    joined = plan.join(counters.select(*by, *counts), by, "left").join(picked, by, "left").na.fill(0, counts)
    source_ok = F.size("source_reasons") == 0
    invalid = F.when(F.col("invalid_count") > 0, F.array(F.lit("window_contains_invalid_quotes_excluded_from_statistics")))
    empty = F.array().cast("array<string>")
    return joined.withColumns(
        {
            "complete": F.coalesce(F.col("complete"), F.lit(False)),
            "ambiguous": F.coalesce(F.col("ambiguous"), F.lit(False)),
            "usable": F.coalesce(F.col("available"), F.lit(False)),
            "distribution_usable": source_ok & (F.col("valid_count") > 0),
            "reasons": F.concat(F.coalesce(F.col("reasons"), empty), F.coalesce(invalid, empty)),
        }
    ).drop("available")


def bar_source_usable() -> Column:
    """Whether the envelope of a session's bar fetch covers it: right symbol and kind, range, time, feed, complete."""
    checks = source_reasons("bars", "bars", F.col("session_start_ns"), F.col("session_end_ns"))
    return (F.size(reason_array(checks)) == 0) & feed_allowed(F.col("symbol"), F.col("feed")) & F.coalesce("complete", F.lit(False))


def coverage_totals(bar_quality: DataFrame) -> DataFrame:
    """Minute coverage per symbol, one row per session coming in; only usable sources enter the trusted counts.

    ``bar_quality`` has ``source_usable`` and ``feed`` beside its counters. A symbol on several feeds is not pooled.
    """
    known = bar_quality.withColumn("feed", F.when(feed_allowed(F.col("symbol"), F.col("feed")), F.col("feed")))
    guarded = mixed_feed_guard(known)
    trusted = F.col("source_usable") & F.col("pooling_allowed")
    return guarded.withColumn("_ratio", F.when(trusted, F.col("coverage_ratio"))).groupBy("symbol").agg(
        F.count(F.lit(1)).alias("expected_sessions"),
        F.sum("expected_minutes").alias("expected_minutes"),
        F.sum("valid_count").alias("observed_valid_minutes"),
        F.sum(F.when(trusted, F.col("valid_count")).otherwise(0)).alias("source_usable_valid_minutes"),
        F.count_if(trusted).alias("source_usable_sessions"),
        F.count_if(trusted & (F.col("missing_count") == 0)).alias("all_minutes_present_sessions"),
        F.sum("missing_count").alias("observed_missing_minutes"),
        F.sum("invalid_count").alias("observed_invalid_bar_records"),
        F.sum("zero_volume_count").alias("observed_zero_volume_minutes"),
        *session_stats("_ratio", "daily_coverage_"),
    )


def capture_totals(envelopes: DataFrame) -> DataFrame:
    """Planned, attempted, successful and skipped fetches with their pages and raw records."""
    attempted = F.col("attempted")
    return envelopes.agg(
        F.count(F.lit(1)).alias("planned_segments"), F.count_if(attempted).alias("attempted_segments"),
        F.count_if(attempted & F.col("complete")).alias("successful_segments"),
        F.count_if(~attempted).alias("skipped_segments"),
        F.sum("pages").alias("pages"), F.sum(F.when(F.col("kind") == "bars", F.col("records")).otherwise(0)).alias("raw_bars"),
        F.sum(F.when(F.col("kind") == "quotes", F.col("records")).otherwise(0)).alias("raw_quotes"),
    )
