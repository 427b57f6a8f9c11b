"""Minute-bar and quote quality: classification, coverage, first quotes, spreads, cost pairs.

Records carry epoch-nanosecond instants. ``by`` names the columns that identify one
fetched window (or symbol and day). Classification keeps every record; a record gets
the first reason that applies, and all counts come from one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.asof import asof_join
from ..functions.quantiles import exact_quantiles
from ..functions.reasons import finite, first_reason, reason_array
from ..functions.times import MINUTE_NS, SECOND_NS

# Tolerance, wait limit, fee grid, percentiles and feeds per symbol class.
BOUND_TOLERANCE = 1e-12
WAIT_NS = 30 * SECOND_NS
FEE_GRID_BPS = [0, 5, 10, 25, 50]
SPREAD_PERCENTILES = {"median": 0.5, "p90": 0.9, "p95": 0.95}
CRYPTO_PAIR = "BTC/USD"
STOCK_FEEDS = ("iex", "sip")
CRYPTO_FEED = "crypto_us"

BAR_VALUES = ["o", "h", "l", "c", "v", "n", "vw"]
BAR_REASONS = [
    "invalid_or_naive_timestamp", "not_exact_minute", "nonnumeric_value", "nonfinite_or_invalid_value",
    "invalid_ohlc_bounds", "noninteger_trade_count",
]


def _number_checks(columns: list[str], positive: bool) -> list:
    checks = []
    for name in columns:
        value = F.col(name)
        low = value <= 0 if positive else value < 0
        checks += [
            ("nonnumeric_value", value.isNull()),
            ("nonfinite_or_invalid_value", ~finite(value) | low),
        ]
    return checks


def _optional(name: str, columns: list[str]) -> list:
    """An absent optional field is fine; a present one must be a nonnegative number."""
    value = F.col(name)
    checks = [("nonfinite_or_invalid_value", value.isNotNull() & (~finite(value) | (value < 0)))]
    if f"{name}_not_a_number" in columns:
        checks.insert(0, ("nonnumeric_value", F.col(f"{name}_not_a_number")))
    return checks


def classify_bars(records: DataFrame, start: str = "start_ns", end: str = "end_ns") -> DataFrame:
    """Adds ``outside`` and ``reason`` (NULL when valid); the range is [start, end)."""
    t = F.col("event_ns")
    outside = F.coalesce((t < F.col(start)) | (t >= F.col(end)), F.lit(False))
    slack = F.greatest("o", "h", "l", "c") * BOUND_TOLERANCE
    checks = [
        ("invalid_or_naive_timestamp", t.isNull()),
        ("not_exact_minute", t % MINUTE_NS != 0),
        *_number_checks(["o", "h", "l", "c"], True),
        *_number_checks(["v"], False),
        ("invalid_ohlc_bounds", (F.col("h") + slack < F.greatest("o", "l", "c")) | (F.col("l") - slack > F.least("o", "h", "c"))),
        *_optional("n", records.columns),
        ("noninteger_trade_count", F.coalesce(F.col("n") != F.floor("n"), F.lit(False))),
        *_optional("vw", records.columns),
    ]
    return records.withColumn("outside", outside).withColumn("reason", F.when(~outside, first_reason(checks)))


def valid_minutes(classified: DataFrame, by: list[str]) -> DataFrame:
    """One row per minute with a usable bar; identical copies collapse, conflicting minutes vanish.

    Copies combine on their whole signature before the shuffle, so a bar fetched a
    billion times costs one row per task.
    """
    signatures = _signatures(classified, by)
    return signatures.groupBy(*by, "event_ns").agg(
        F.count(F.lit(1)).alias("_signatures"), F.max(F.struct(*BAR_VALUES)).alias("_bar")
    ).filter("_signatures = 1").select(*by, "event_ns", "_bar.*")


def _signatures(classified: DataFrame, by: list[str]) -> DataFrame:
    usable = classified.filter(~F.col("outside") & F.col("reason").isNull())
    return usable.groupBy(*by, "event_ns", *BAR_VALUES).agg(F.count(F.lit(1)).alias("_copies"))


def missing_minutes(spans: DataFrame, valid: DataFrame, by: list[str]) -> DataFrame:
    """Expected minutes without a usable bar; nothing is filled."""
    return expected_minutes(spans, by).join(valid.select(*by, "event_ns"), [*by, "event_ns"], "left_anti")


def expected_minutes(spans: DataFrame, by: list[str]) -> DataFrame:
    grid = F.sequence(F.col("start_ns"), F.col("end_ns") - MINUTE_NS, F.lit(MINUTE_NS))
    return spans.select(*by, F.explode(grid).alias("event_ns"))


def bar_quality(spans: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """Counts and coverage per window; a window without records still has a row."""
    classified = classify_bars(records.join(spans.select(*by, "start_ns", "end_ns"), by))
    raw = classified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("received_count"),
        F.count_if("outside").alias("outside_session_count"),
        F.count_if(F.col("reason").isNotNull()).alias("_errors"),
    )
    minutes = _signatures(classified, by).groupBy(*by, "event_ns").agg(
        F.count(F.lit(1)).alias("_sigs"), F.sum("_copies").alias("_records"), F.max("v").alias("_v")
    )
    conflict = F.col("_sigs") > 1
    usable = minutes.groupBy(*by).agg(
        F.count_if(~conflict).alias("valid_count"),
        F.count_if(~conflict & (F.col("_v") == 0)).alias("zero_volume_count"),
        F.count_if(conflict).alias("conflicting_minute_count"),
        F.sum(F.when(conflict, F.col("_records")).otherwise(0)).alias("conflicting_record_count"),
        F.sum(F.col("_records") - F.col("_sigs")).alias("identical_duplicate_count"),
    )
    counts = [
        "received_count", "outside_session_count", "_errors", "valid_count", "zero_volume_count",
        "conflicting_minute_count", "conflicting_record_count", "identical_duplicate_count",
    ]
    joined = spans.join(raw, by, "left").join(usable, by, "left").na.fill(0, counts)
    expected = F.expr(f"(end_ns - start_ns) div {MINUTE_NS}")
    return joined.withColumn("expected_minutes", expected).select(
        *by, "expected_minutes", *[c for c in counts if c != "_errors"],
        (F.col("_errors") + F.col("conflicting_record_count")).alias("invalid_count"),
        (F.col("expected_minutes") - F.col("valid_count")).alias("missing_count"),
        (F.col("valid_count") / F.col("expected_minutes")).alias("coverage_ratio"),
    )


def reason_histogram(classified: DataFrame, by: list[str]) -> DataFrame:
    return classified.filter(F.col("reason").isNotNull()).groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("records"))


# ---- quotes -----------------------------------------------------------------


def mid(bid: Column, ask: Column) -> Column:
    return bid + (ask - bid) / 2


def spread_bps(bid: Column, ask: Column) -> Column:
    return (ask - bid) / mid(bid, ask) * 10000


def classify_quotes(records: DataFrame) -> DataFrame:
    """Adds ``outside`` (of [start_ns, end_ns) when those columns exist) and ``reason``. Locked is allowed."""
    t = F.col("event_ns")
    if "start_ns" in records.columns:
        outside = F.coalesce((t < F.col("start_ns")) | (t >= F.col("end_ns")), F.lit(False))
    else:
        outside = F.lit(False)
    checks = [
        ("invalid_or_naive_timestamp", t.isNull()),
        *_number_checks(["bid", "ask", "bid_size", "ask_size"], True),
        ("crossed_quote", F.col("bid") > F.col("ask")),
    ]
    return records.withColumn("outside", outside).withColumn("reason", F.when(~outside, first_reason(checks)))


def unique_quotes(classified: DataFrame, by: list[str], identity: str = "identity") -> DataFrame:
    """Valid quotes once per exact record, with mid and full spread."""
    valid = classified.filter(~F.col("outside") & F.col("reason").isNull())
    return valid.dropDuplicates([*by, "event_ns", identity]).withColumns(
        {
            "mid_price": mid(F.col("bid"), F.col("ask")),
            "full_spread_bps": spread_bps(F.col("bid"), F.col("ask")),
        }
    )


def quote_instants(quotes: DataFrame, by: list[str], identity: str = "identity") -> DataFrame:
    """One row per instant: how many distinct quotes share it, and the quote when it is alone."""
    row = F.struct("bid", "ask", "bid_size", "ask_size", "mid_price", "full_spread_bps", identity)
    return quotes.groupBy(*by, "event_ns").agg(F.count(F.lit(1)).alias("n"), F.max(row).alias("q"))


def first_quotes(
    targets: DataFrame, instants: DataFrame, by: list[str], target: str = "target_ns",
    wait_ns: int = WAIT_NS, bin_width: int = MINUTE_NS,
) -> DataFrame:
    """First valid instant at or after the target within the wait (inclusive); ties select nothing.

    Adds ``first_ns``, ``first_count``, ``ambiguous`` and the selected quote columns.
    """
    matched = asof_join(
        targets, instants, by, target, "event_ns", {"_hit": F.struct("n", "q")}, direction="forward",
        tolerance=wait_ns, bin_width=bin_width,
    )
    alone = F.col("_hit.n") == 1
    pick = lambda c: F.when(alone, F.col(f"_hit.q.{c}")).alias(c)
    return matched.select(
        *targets.columns, F.col("_hit_at").alias("first_ns"),
        F.coalesce(F.col("_hit.n"), F.lit(0)).alias("first_count"),
        F.coalesce(F.col("_hit.n") > 1, F.lit(False)).alias("ambiguous"),
        *[pick(c) for c in ("bid", "ask", "bid_size", "ask_size", "mid_price", "full_spread_bps")],
    )


def window_counters(
    classified: DataFrame, quotes: DataFrame, by: list[str], target: str = "target_ns", wait_ns: int = WAIT_NS
) -> DataFrame:
    """Received, invalid, outside, before and after counts per window, and unique valid ones."""
    t = F.col("event_ns")
    raw = classified.groupBy(*by).agg(
        F.count(F.lit(1)).alias("received_count"),
        F.count_if(F.col("reason").isNotNull()).alias("invalid_count"),
        F.count_if("outside").alias("outside_fetch_window_count"),
        F.count_if(F.coalesce(t < F.col(target), F.lit(False))).alias("before_target_count"),
        F.count_if(F.coalesce(t > F.col(target) + wait_ns, F.lit(False))).alias("after_deadline_count"),
        F.count_if(~F.col("outside") & F.col("reason").isNull()).alias("_valid_records"),
    )
    unique = quotes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("valid_count"),
        F.count_if(t.between(F.col(target), F.col(target) + wait_ns)).alias("timely_valid_quote_count"),
    )
    joined = raw.join(unique, by, "left").na.fill(0, ["valid_count", "timely_valid_quote_count"])
    return joined.withColumn(
        "identical_duplicate_count", F.col("_valid_records") - F.col("valid_count")
    ).drop("_valid_records")


def spread_distribution(quotes: DataFrame, by: list[str]) -> DataFrame:
    """Event-weighted spread statistics per group, exact for any group size."""
    basic = quotes.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), F.min("full_spread_bps").alias("min"),
        F.avg("full_spread_bps").alias("mean"), F.max("full_spread_bps").alias("max"),
    )
    ranked = exact_quantiles(quotes.select(*by, "full_spread_bps"), by, "full_spread_bps", SPREAD_PERCENTILES)
    return basic.join(ranked, by)


# ---- sources and pairs ------------------------------------------------------


def source_reasons(name: str, kind: str, required_start: Column, required_end: Column, wrong_record: Column | None = None):
    """Checks of one fetch envelope against the window it must cover."""
    start, end, observed = F.col("start_ns"), F.col("end_ns"), F.col("observed_ns")
    declared = lambda c, want: F.coalesce(F.col(c) != want, F.lit(False))
    return [
        (f"{name}_declares_wrong_symbol", declared("declared_symbol", F.col("symbol"))),
        (f"{name}_declares_wrong_record_kind", declared("kind", F.lit(kind))),
        (f"{name}_record_declares_wrong_symbol", wrong_record if wrong_record is not None else F.lit(False)),
        (
            f"{name}_fetch_range_does_not_cover_required_window",
            (start >= end) | (start > required_start) | (end < required_end),
        ),
        (
            f"{name}_observation_time_missing_or_before_window_end",
            observed.isNull() | F.coalesce(observed < end, F.lit(False)),
        ),
    ]


def feed_allowed(symbol: Column, feed: Column) -> Column:
    """Crypto pair on the crypto feed, stocks on a stock feed; other pairs on none."""
    other_pair = symbol.contains("/") | symbol.endswith("-USD")
    allowed = F.when(symbol == CRYPTO_PAIR, feed == CRYPTO_FEED).when(other_pair, F.lit(False)).otherwise(
        feed.isin(*STOCK_FEEDS)
    )
    return F.coalesce(allowed, F.lit(False))


def bar_leg(envelopes: DataFrame, records: DataFrame, keys: list[str]) -> DataFrame:
    """The bars fetch of each session as a leg of the pair: feed, completeness, metadata reasons, bad and missing minutes."""
    checks = reason_array(source_reasons("bars", "bars", F.col("session_start_ns"), F.col("session_end_ns")))
    counts = bar_quality(envelopes, records, keys).select(*keys, "invalid_count", "missing_count")
    return envelopes.select(*keys, "feed", "complete", checks.alias("reasons")).join(counts, keys)


def cost_pairs(entry: DataFrame, exit_: DataFrame, keys: list[str], bars: DataFrame | None = None) -> DataFrame:
    """Entry and exit touch compared: gross mid return, touch return, drag and approximate spread.

    Both sides hold selected first quotes with ``feed``, ``complete`` and ``reasons``; ``bars`` is the session's
    ``bar_leg``. All fetches must be complete, undisputed and on one feed the symbol may have. Every planned key
    stays; blocked ones carry reasons and no numbers. Bad or missing minutes are reasons that block nothing.
    """
    cols = ["bid", "ask", "mid_price", "full_spread_bps", "feed", "complete", "ambiguous", "reasons"]
    left = entry.select(*keys, F.struct(*cols).alias("en"))
    right = exit_.select(*keys, F.struct(*cols).alias("ex"))
    joined = left.join(right, keys, "full")
    fetches = ["en", "ex"]
    if bars is not None:
        fetches = ["ba", *fetches]
        leg = F.struct("feed", "complete", "reasons", "invalid_count", "missing_count").alias("ba")
        joined = joined.join(bars.select(*keys, leg), keys, "full")
    symbol = F.col("symbol")
    names = {"ba": "bars", "en": "entry_quotes", "ex": "exit_quotes"}
    same = F.lit(True)
    for one, other in zip(fetches, fetches[1:]):
        same = same & F.col(f"{one}.feed").eqNullSafe(F.col(f"{other}.feed"))
    allowed = F.lit(True)
    for one in fetches:
        allowed = allowed & feed_allowed(symbol, F.col(f"{one}.feed"))
    no_quote = lambda s: (
        (f"{s[1]}_first_quote_ambiguous_without_sequence", F.coalesce(F.col(f"{s[0]}.ambiguous"), F.lit(False))),
        (
            f"{s[1]}_has_no_valid_timely_quote",
            F.col(f"{s[0]}.mid_price").isNull() & ~F.coalesce(F.col(f"{s[0]}.ambiguous"), F.lit(False)),
        ),
    )
    own = reason_array([(f"{names[x]}_fetch_incomplete", ~F.coalesce(F.col(f"{x}.complete"), F.lit(False))) for x in fetches])
    rest = reason_array(
        [
            ("unknown_or_unsupported_feed_for_symbol", ~allowed),
            ("cross_feed_quote_pair_forbidden", ~same),
            *no_quote(("en", "entry")),
            *no_quote(("ex", "exit")),
        ]
    )
    empty = F.array().cast("array<string>")
    blocking = F.concat(own, *[F.coalesce(F.col(f"{x}.reasons"), empty) for x in fetches], rest)
    quality = empty
    if bars is not None:
        quality = reason_array(
            [
                ("bar_quality_contains_invalid_or_conflicting_records", F.coalesce(F.col("ba.invalid_count") > 0, F.lit(False))),
                ("bar_quality_has_missing_minutes", F.coalesce(F.col("ba.missing_count") > 0, F.lit(False))),
            ]
        )
    usable = F.col("usable")
    gross = F.col("ex.mid_price") / F.col("en.mid_price") - 1
    touch = F.col("ex.bid") / F.col("en.ask") - 1
    return joined.withColumns({"usable": F.size(blocking) == 0, "reasons": F.concat(blocking, quality)}).select(
        *keys, "reasons", "usable",
        F.when(usable, gross).alias("gross_mid_return"), F.when(usable, touch).alias("touch_long_return"),
        F.when(usable, (gross - touch) * 10000).alias("spread_drag_bps"),
        F.when(usable, (F.col("en.full_spread_bps") + F.col("ex.full_spread_bps")) / 2).alias(
            "approximate_round_trip_spread_bps"
        ),
    )


def fee_scenarios(pairs: DataFrame) -> DataFrame:
    """Usable pairs under each assumed round-trip fee of the fixed grid."""
    grid = F.explode(F.array(*[F.lit(float(f)) for f in FEE_GRID_BPS]))
    return pairs.filter("usable").withColumn("assumed_fee_bps", grid).withColumn(
        "spread_plus_fee_bps", F.col("approximate_round_trip_spread_bps") + F.col("assumed_fee_bps")
    )
