"""Streaming quotes: exact de-duplication, minute windows, last state, state changes, order rate.

All but one are built-in streaming aggregations, so rows combine before the shuffle and a hot symbol
costs one partial row per task and micro-batch. State changes depend on the order of instants and on
time passing without one; they are a stateful processor with event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.reasons import finite
from ..operators.quality import spread_bps
from ..operators.replay import event_reasons


def with_event_time(quotes: DataFrame, time: str = "event_ns") -> DataFrame:
    """Adds the microsecond timestamp used for watermarks; the nanosecond instant stays."""
    return quotes.withColumn("event_time", F.timestamp_micros(F.expr(f"{time} div 1000")))


def split_readable(quotes: DataFrame, time: str = "event_ns") -> tuple[DataFrame, DataFrame]:
    """(quotes with an instant, those without one and the reason); a watermark would drop the latter unseen."""
    rejected = quotes.filter(F.col(time).isNull()).withColumn("reason", F.lit("invalid_or_naive_timestamp"))
    return quotes.filter(F.col(time).isNotNull()), rejected


def deduplicate(quotes: DataFrame, keys: list[str], lateness: str = "10 minutes") -> DataFrame:
    """Exact copies arriving within the lateness bound are dropped."""
    return quotes.withWatermark("event_time", lateness).dropDuplicatesWithinWatermark(keys)


def valid_quote() -> Column:
    ok = F.lit(True)
    for name in ("bid", "ask", "bid_size", "ask_size"):
        ok = ok & finite(F.col(name)) & F.coalesce(F.col(name) > 0, F.lit(False))
    return ok & (F.col("bid") <= F.col("ask"))


def minute_windows(quotes: DataFrame, lateness: str = "10 minutes", minutes: int = 1) -> DataFrame:
    """Per symbol and tumbling window of ``minutes``: quotes, invalid ones, spreads, minute coverage; final once (append).

    The minutes that hold a valid quote are the bits of one number per window: state of fixed size that combines
    map-side. Coverage and gaps are read off it when the window closes.
    """
    if not 1 <= minutes <= 60 or 60 % minutes:
        raise ValueError("a window is a divisor of the hour")
    valid = valid_quote()
    spread = F.when(valid, spread_bps(F.col("bid"), F.col("ask")))
    minute = F.expr(f"CAST(pmod(unix_micros(event_time) div 60000000, {minutes}) AS INT)")
    seen = F.when(valid, F.call_function("shiftleft", F.lit(1).cast("bigint"), minute)).otherwise(0)
    counted = (
        quotes.withWatermark("event_time", lateness)
        .groupBy("symbol", F.window("event_time", f"{minutes} minutes"))
        .agg(
            F.count(F.lit(1)).alias("quotes"), F.count_if(~valid).alias("invalid"),
            F.min(spread).alias("min_spread_bps"), F.max(spread).alias("max_spread_bps"), F.avg(spread).alias("mean_spread_bps"),
            F.bit_or(seen).alias("seen"),
        )
    )
    gaps = F.filter(F.sequence(F.lit(0), F.lit(minutes - 1)), lambda m: F.call_function("getbit", F.col("seen"), m) == 0)
    return counted.select(
        "symbol", F.col("window.start").alias("window_start"), "quotes", "invalid", "min_spread_bps", "max_spread_bps", "mean_spread_bps",
        F.bit_count("seen").cast("int").alias("covered_minutes"), (F.bit_count("seen") / F.lit(float(minutes))).alias("coverage"), gaps.alias("missing_minutes"),
    )


def last_states(quotes: DataFrame, by: list[str], identity: str = "identity") -> DataFrame:
    """Latest instant per key and whether it leaves a usable quote (update or complete mode).

    The largest and the smallest update at the latest instant are kept; they differ
    exactly when the instant is ambiguous. Copies change nothing, so no de-duplication
    is needed, and an invalid latest update poisons the state.
    """
    row = [F.col(identity).alias("identity"), event_reasons().alias("reasons"), F.col("bid"), F.col("ask")]
    newest = F.max(F.struct(F.col("event_ns"), *row))
    other = F.min(F.struct((-F.col("event_ns")).alias("neg"), F.col(identity).alias("identity")))
    grouped = quotes.groupBy(*by).agg(newest.alias("_n"), other.alias("_o"))
    ambiguous = F.col("_n.identity") != F.col("_o.identity")
    valid = ~ambiguous & (F.size("_n.reasons") == 0)
    return grouped.select(
        *by, F.col("_n.event_ns").alias("event_ns"), ambiguous.alias("ambiguous"), valid.alias("valid"),
        F.when(valid, F.col("_n.bid")).alias("bid"), F.when(valid, F.col("_n.ask")).alias("ask"),
    )


def state_status(states: DataFrame, now_ns: Column, max_age_ms: int) -> DataFrame:
    """Status of each state when read at ``now_ns``; an age equal to the limit is valid."""
    age = now_ns - F.col("event_ns")
    return states.withColumn(
        "status",
        F.when(~F.col("valid"), "INVALID").when(age > max_age_ms * 1_000_000, "STALE").otherwise("VALID"),
    )


MILLI = 1_000_000
CHANGES = "event_ns long, status string, change string, ambiguous boolean, bid double, ask double"


class StateChanges(StatefulProcessor):
    """Instants of one key in order, once the watermark has passed them, and the moments the last one goes stale.

    State: the instants the watermark has not passed (bounded by the lateness), and the last one. An instant is
    written when its timer fires; a key that has been idle is forgotten.
    """

    def __init__(self, by: list[str], max_age_ms: int, idle_ms: int):
        self._by, self._age, self._idle = by, max_age_ms, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getMapState("waiting", "event_ns long", "low string, high string, valid boolean, bid double, ask double")
        self._last = handle.getValueState("last", "event_ns long, valid boolean, stale boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first_at = None
        for batch in rows:
            for at, same in batch.groupby("event_ns"):
                at, low, high, first = int(at), same["identity"].min(), same["identity"].max(), same.iloc[0]
                known = self._waiting.getValue((at,))
                if known:
                    low, high = min(low, known[0]), max(high, known[1])
                self._waiting.updateValue((at,), (low, high, bool(first["valid"]), float(first["bid"]), float(first["ask"])))
                first_at = at if first_at is None else min(at, first_at)
        self._handle.registerTimer(first_at // MILLI + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()  # no instant before it can come any more
        last = self._last.get() if self._last.exists() else None
        out = []

        def stale() -> None:
            nonlocal last
            out.append((last[0] + self._age * MILLI + 1, "STALE", "STALE", False, None, None))
            last = (last[0], last[1], True)

        waiting = sorted((k[0], v) for k, v in self._waiting.iterator())
        for at, (low, high, valid, bid, ask) in waiting:
            if at // MILLI + 1 > now:
                break
            if last and last[1] and not last[2] and at > last[0] + self._age * MILLI:
                stale()
            valid = valid and low == high
            change = None if last is None or last[1] == valid else "RECOVERED" if valid else "INVALIDATED"
            out.append((at, "VALID" if valid else "INVALID", change, low != high, bid if valid else None, ask if valid else None))
            last = (at, valid, False)
            self._waiting.removeKey((at,))
        wake = [at // MILLI + 1 for at, _ in waiting if at // MILLI + 1 > now][:1]
        if last:
            overdue, forgotten = last[0] // MILLI + self._age + 2, last[0] // MILLI + self._idle
            if last[1] and not last[2]:
                if now >= overdue:
                    stale()
                else:
                    wake.append(overdue)
            if now >= forgotten:
                self._last.clear()
            else:
                wake.append(forgotten)
                self._last.update(last)
        if wake:
            self._handle.registerTimer(min(wake))
        if out:
            columns = ["event_ns", "status", "change", "ambiguous", "bid", "ask"]
            yield pd.DataFrame(dict(zip(self._by, ([k] * len(out) for k in key), strict=True)) | dict(zip(columns, zip(*out, strict=True), strict=True)))

    def close(self) -> None:
        pass


def state_changes(quotes: DataFrame, by: list[str], max_age_ms: int, idle_ms: int, lateness: str = "10 minutes") -> DataFrame:
    """One row per instant and key (VALID or INVALID, and whether that invalidates or recovers the state), and one
    STALE row when a valid state has not been followed within ``max_age_ms``.

    Copies of an update change nothing; different updates of one instant are ambiguous and invalid. Rows may come in any
    order within ``lateness``; a row is written once the watermark has passed it. A key without an instant for ``idle_ms``
    (at least the age) is forgotten: its next instant changes nothing. Needs the RocksDB state store.
    """
    if idle_ms <= max_age_ms + 2:
        raise ValueError("a key may not be forgotten before its state can go stale")
    rows = quotes.withWatermark("event_time", lateness).withColumn("valid", F.size(event_reasons()) == 0)
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in by)
    return rows.select(*by, "event_time", "event_ns", "identity", "valid", "bid", "ask").groupBy(*by).transformWithStateInPandas(
        StateChanges(by, max_age_ms, idle_ms), f"{types}, {CHANGES}", "append", "eventTime"
    )


def sliding_rate(orders: DataFrame, width: str = "1 second", slide: str = "100 milliseconds", lateness: str = "10 seconds"):
    """Offered orders per sliding window: the streaming approximation of the exact batch rate."""
    return (
        orders.withWatermark("event_time", lateness).groupBy(F.window("event_time", width, slide))
        .agg(F.count(F.lit(1)).alias("orders"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "orders")
    )
