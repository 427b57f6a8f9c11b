"""Quote signals, running positions, average-cost profit, exposure and audit chains.

Sequences per symbol are cut into bins along their order (see functions/scan.py), so
a symbol holding a third of all fills is still spread over its days and key ranges.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.reasons import require_zero
from ..functions.scan import Running, running

# Commission schedule.
OPTION_FEE, OPTION_MINIMUM = 0.65, 1.00
CRYPTO_RATE = 0.0015
EQUITY_FEE, EQUITY_MINIMUM = 0.0035, 0.35
RATE_WINDOW_NS = 1_000_000_000
AMOUNT = "decimal(18,8)"
MONEY = "decimal(27,8)"


# ---- quotes -----------------------------------------------------------------


def imbalance(bid_size: Column, ask_size: Column) -> Column:
    return F.try_divide(bid_size - ask_size, bid_size + ask_size)


def quote_scores(
    quotes: DataFrame, weight: float, threshold: float, key: str = "symbol", time: str = "event_ns",
    tie: list[str] | None = None, bin_ns: int = 3_600 * 1_000_000_000,
) -> DataFrame:
    """Imbalance plus weighted momentum in bps against the previous mid; first quote has none."""
    base = quotes.withColumns(
        {
            "mid": F.col("bid") + (F.col("ask") - F.col("bid")) / 2,
            "imbalance": imbalance(F.col("bid_size"), F.col("ask_size")),
            "_day": F.expr(f"{time} div {24 * bin_ns}"),
            "_bin": F.expr(f"{time} div {bin_ns}"),
        }
    )
    order = [time, *(tie or [])]
    spaced = running(base, [key], ["_day", "_bin"], order, [Running("_prev", F.col("mid"), "prev")])
    momentum = F.coalesce(F.try_divide(F.col("mid") - F.col("_prev"), F.col("_prev")), F.lit(0.0))
    score = F.col("imbalance") + F.lit(weight) * momentum * 10000
    return spaced.withColumns(
        {"momentum": momentum, "score": score, "active": F.abs(score) >= threshold}
    ).drop("_day", "_bin", "_prev")


# ---- fills ------------------------------------------------------------------


def commission(asset_class: Column, quantity: Column, price: Column) -> Column:
    q, p = quantity.cast("double"), price.cast("double")
    return (
        F.when(asset_class == "option", F.greatest(q * OPTION_FEE, F.lit(OPTION_MINIMUM)))
        .when(asset_class == "crypto", q * p * CRYPTO_RATE)
        .otherwise(F.greatest(q * EQUITY_FEE, F.lit(EQUITY_MINIMUM)))
    )


def signed(side: str = "side", quantity: str = "quantity") -> Column:
    return F.when(F.col(side) == "BUY", F.col(quantity)).otherwise(-F.col(quantity))


def running_positions(fills: DataFrame, levels: list[str], order: list[str], key: str = "symbol") -> DataFrame:
    """Position, cash flow and fees after every fill, in exact decimals."""
    s = signed().cast(AMOUNT)
    fee = F.col("commission").cast(MONEY) if "commission" in fills.columns else F.lit(0).cast(MONEY)
    return running(
        fills, [key], levels, order,
        [Running("position", s), Running("cash", -(_notional(s) + fee)), Running("fees_paid", fee)],
    )


def _notional(amount: Column) -> Column:
    """Quantity x price x multiplier; the operand types keep at least eight decimals."""
    return (amount * F.col("price").cast(AMOUNT) * F.col("multiplier").cast("decimal(6,0)")).cast(MONEY)


# The average after a fill is a*average + b, its profit r0 + r1*average. Digits behind the point are chosen so that
# products of two fit into 38 digits after rounding; a factor is kept to 30 digits, a price to 20, a profit to 18.
_FACTOR, _PRICE, _CLOSED, _PROFIT = "decimal(31,30)", "decimal(28,20)", "decimal(34,24)", "decimal(36,18)"
_ONE, _NAN, _DIGITS = 10**30, float("nan"), Context(prec=60)
_NOTHING = (_ONE, 0, 0, 0, 0, False, 0)  # effect (a, b, r0, r1) of no fills, their sum, whether it has a value, their number


def _effect(a: Column, b: Column, r0: Column, r1: Column) -> list[Column]:
    return [a.cast(_FACTOR).alias("a"), b.cast(_PRICE).alias("b"), r0.cast(_PROFIT).alias("r0"), r1.cast(_CLOSED).alias("r1")]


def _after(average: Column, effect: Column) -> Column:
    """Average price behind a stretch of fills."""
    return ((effect["a"] * average).cast(_PRICE) + effect["b"]).cast(_PRICE)


def _gain(average: Column, effect: Column) -> Column:
    """Profit within a stretch of fills."""
    return (effect["r0"] + (effect["r1"] * average).cast(_PROFIT)).cast(_PROFIT)


def _compose(first: Column, second: Column) -> Column:
    """Two consecutive stretches of fills as one."""
    slope = first["r1"] + (second["r1"] * first["a"]).cast(_CLOSED)
    return F.struct(*_effect(second["a"] * first["a"], _after(first["b"], second), first["r0"] + _gain(first["b"], second), slope))


def _identity() -> Column:
    return F.struct(*_effect(F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def _fold(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Compose the effects of a group's bins in order."""
    listed = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(*order, F.struct("a", "b", "r0", "r1").alias("e")))).alias("_l"),
        F.sum("signed").alias("signed"), F.sum("fills").alias("fills"),
    )
    folded = F.aggregate("_l", _identity(), lambda acc, x: _compose(acc, x["e"]))
    return listed.select(*keys, "signed", "fills", folded.alias("_f")).select(*keys, "signed", "fills", "_f.*")


_FILL = ("_s", "_q0", "_q1", "price", "multiplier")


def _rounded(x, unit: int):
    """x / unit as a whole number, halves away from zero."""
    return (x + unit // 2) // unit if x >= 0 else -((-x + unit // 2) // unit)


def _whole(column: pa.Array) -> list:
    """Decimals of at most 18 digits as whole numbers of their last digit; NaN for null."""
    words = np.frombuffer(column.buffers()[1], np.int64)[2 * column.offset : 2 * (column.offset + len(column)) : 2].tolist()
    return [w if known else _NAN for w, known in zip(words, column.is_valid().to_pylist(), strict=True)] if column.null_count else words


def _decimals(values: list, digits: int, scale: int) -> pa.Array:
    """Whole numbers of 10^-scale as decimals (NaN: null); what does not fit raises."""
    return pa.array([None if v != v else Decimal(v).scaleb(-scale, _DIGITS) for v in values], pa.decimal128(digits, scale))


def _folded(state: tuple, fills: list[tuple]) -> tuple:
    """The effect of a stretch with the fills behind it; a fill is (amount, position before and after, price, multiplier)."""
    a, b, r0, r1, total, known, count = state
    for s, q0, q1, price, multiplier in fills:
        count += 1
        if s == s:
            total, known = total + s, True
        if q0 == 0 or (q0 > 0 and s > 0) or (q0 < 0 and s < 0):
            size = abs(q0) + abs(s)
            kept = abs(q0) * _ONE // size if size else _ONE
            a = _rounded(kept * a, _ONE)
            b = _rounded(kept * b, _ONE) + _rounded((_ONE - kept) * price, 10**18)
            continue
        closed = min(abs(q0), abs(s)) * (1 if q0 > 0 else -1) if s == s else _NAN
        part = -closed * multiplier * 10**16
        r0 = r0 + closed * price * multiplier * 100 + _rounded(_rounded(part * b, 10**25), 10)
        r1 = r1 + _rounded(part * a, _ONE)
        flips = (q0 > 0 and q1 < 0) or (q0 < 0 and q1 > 0)
        if q1 == 0 or flips:
            a, b = 0, 0 * b + (price if flips else 0) * 10**12
    return a, b, r0, r1, total, known, count


def fill_effects(fills: DataFrame, levels: list[str], order: list[str], key: str = "symbol", opening: DataFrame | None = None):
    """Fills of a (key, level) as one affine effect on the average cost, in decimals.

    The position before a fill is a running sum, which fixes whether it opens, adds,
    reduces or flips; given that, the new average is a*average + b and the realised
    profit r0 + r1*average. Effects compose, so the order-dependent average cost needs
    no sequential pass over a whole symbol. The cells of a task pass by in order, and their
    fills compose in whole numbers: decimal expressions take several times as long. A missing
    quantity or price is NaN there and makes what depends on it NULL.
    """
    s = signed().cast(AMOUNT)
    placed = running(fills.withColumn("_s", s), [key], levels, order, [Running("_after", F.col("_s"))])
    if opening is not None:
        start = opening.select(key, F.col("quantity").cast(MONEY).alias("_open"))
        placed = placed.join(start, key, "left").withColumn("_after", F.col("_after") + F.coalesce("_open", F.lit(0)))
    cells = [key, *levels]
    rows = placed.select(
        *cells, *[c for c in order if c not in cells], "_s", F.col("_after").cast(AMOUNT).alias("_q1"), (F.col("_after") - F.col("_s")).cast(AMOUNT).alias("_q0"),
        F.col("price").cast(AMOUNT).alias("price"), F.col("multiplier").cast("decimal(6,0)").alias("multiplier"),
    )
    # fills of one instant go by their effects, as near as doubles tell them apart
    q0, q1, sd, price = (F.col(c).cast("double") for c in ("_q0", "_q1", "_s", "price"))
    adds, flips = (q0 == 0) | (F.signum(q0) == F.signum(sd)), F.signum(q0) * F.signum(q1) < 0
    size = F.abs(q0) + F.abs(sd)
    kept = F.when(size > 0, F.try_divide(F.abs(q0), size)).otherwise(1.0)
    closed = F.least(F.abs(q0), F.abs(sd)) * F.signum(q0) * F.col("multiplier").cast("double")
    ties = [
        F.when(adds, kept).when((q1 == 0) | flips, 0.0).otherwise(1.0), F.when(adds, (1 - kept) * price).when(flips, price).otherwise(0.0),
        F.when(adds, 0.0).otherwise(closed * price), F.when(adds, 0.0).otherwise(-closed),
    ]
    # the hash, a number, decides most comparisons at once
    dealt = rows.repartition(*cells).sortWithinPartitions(F.xxhash64(*cells), *cells, *order, *ties).select(*cells, *_FILL)
    sizes = {"a": (31, 30), "b": (28, 20), "r0": (36, 18), "r1": (34, 24), "signed": (28, 8)}

    def listed(done: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True))
        at, (*effect, total, known, count) = columns[: len(cells)], columns[len(cells) :]
        total = [t if k else _NAN for t, k in zip(total, known, strict=True)]
        exact = [_decimals(v, *d) for v, d in zip((*effect, total), sizes.values(), strict=True)]
        return pa.record_batch([*(pa.array(v, k) for v, k in zip(at, kinds, strict=True)), *exact, pa.array(count, pa.int64())], names=[*cells, *sizes, "fills"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, kinds = None, None, []
        for batch in batches:
            kinds, n, done = [batch.schema.field(c).type for c in cells], batch.num_rows, []
            if not n:
                continue
            fresh = np.zeros(n, bool)
            fresh[0] = True
            for c in cells:
                number = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                fresh[1:] |= number[1:] != number[:-1]
            first = np.flatnonzero(fresh)
            names = zip(*(batch.column(c).take(pa.array(first)).to_pylist() for c in cells), strict=True)
            values = list(zip(*(_whole(batch.column(c)) for c in _FILL), strict=True))
            for name, begin, end in zip(names, first.tolist(), [*first[1:].tolist(), n], strict=True):
                if state is None or name != at:
                    if state is not None:
                        done.append((*at, *state))
                    at, state = name, _NOTHING
                state = _folded(state, values[begin:end])
            if done:
                yield listed(done, kinds)
        if state is not None:
            yield listed([(*at, *state)], kinds)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields[: len(cells)]]
    return dealt.mapInArrow(run, ", ".join([*fields, *(f"{n} decimal({p},{d})" for n, (p, d) in sizes.items()), "fills bigint"]))


QUANTITY = "decimal(28,8)"


def average_cost(
    fills: DataFrame, day: str, bin_: str, order: list[str], key: str = "symbol", opening: DataFrame | None = None
) -> DataFrame:
    """Per (symbol, day): fills, closing quantity, average price and realised profit, flips included, in decimals.

    Fills are folded per (symbol, day, key range) and key ranges per day; the daily effects
    of a symbol (bounded by the calendar) are chained by one aggregate over their array.
    Prices below 10^8, positions below 10^10 and profits below 10^18 fit; larger ones raise.
    """
    per_bin = fill_effects(fills, [day, bin_], order, key, opening)
    per_day = _fold(per_bin, [key, day], [bin_])
    daily = F.struct(day, "fills", F.col("signed").cast(QUANTITY).alias("signed"), F.struct("a", "b", "r0", "r1").alias("e"))
    chained = per_day.groupBy(key).agg(F.array_sort(F.collect_list(daily)).alias("_l"))
    if opening is None:
        start = chained.select("*", *[F.lit(None).alias(c) for c in ("_q", "_avg", "_pnl")])
    else:
        start = chained.join(
            opening.select(key, F.col("quantity").alias("_q"), F.col("average_price").alias("_avg"), F.col("realized_pnl").alias("_pnl")), key, "left"
        )

    def state(quantity: Column, average: Column, gain: Column, realized: Column, at: Column, fills_: Column) -> Column:
        return F.struct(
            at.alias(day), fills_.cast("bigint").alias("fills"), quantity.cast(QUANTITY).alias("quantity"), average.cast(_PRICE).alias("average_price"),
            gain.cast(_PROFIT).alias("realized_day"), realized.cast(_PROFIT).alias("realized_pnl"),
        )

    none = F.lit(0)
    first = state(F.coalesce("_q", none), F.coalesce("_avg", none), none, F.coalesce("_pnl", none), F.lit(None).cast(per_day.schema[day].dataType), none)

    def step(states: Column, x: Column) -> Column:
        last = F.element_at(states, -1)
        gain = _gain(last["average_price"], x["e"])
        after = state(last["quantity"] + x["signed"], _after(last["average_price"], x["e"]), gain, last["realized_pnl"] + gain, x[day], x["fills"])
        return F.array_append(states, after)

    states = F.aggregate("_l", F.array(first), step)
    return start.select(key, F.inline(F.slice(states, 2, F.size("_l"))))


def closing_positions(daily: DataFrame, day: str, key: str = "symbol") -> DataFrame:
    """Last state per symbol: the opening of the next batch."""
    return daily.groupBy(key).agg(F.max_by(F.struct("quantity", "average_price", "realized_pnl"), day).alias("_c")).select(
        key, "_c.*"
    )


# ---- portfolio --------------------------------------------------------------


def mark_to_market(positions: DataFrame, marks: DataFrame, starting_cash) -> DataFrame:
    """Equity, gross notional, fees (exact decimals) and missing marks.

    ``positions(symbol, quantity, multiplier, cash, fees_paid)``; ``marks(symbol, mark)``, a mark counts to eight decimals.
    """
    joined = positions.join(marks, "symbol", "left")
    quantity = F.col("quantity").cast(AMOUNT)
    open_ = quantity != 0
    worth = ((quantity * F.col("mark").cast(AMOUNT)).cast("decimal(30,16)") * F.col("multiplier").cast("decimal(6,0)")).cast(_PROFIT)
    total = lambda value: F.coalesce(F.sum(value), F.lit(0)).cast(_PROFIT)
    return joined.agg(
        (F.lit(starting_cash).cast("decimal(27,8)") + total(F.col("cash").cast(MONEY)) + total(F.when(open_, worth))).cast(_PROFIT).alias("equity"),
        total(F.when(open_, F.abs(worth))).alias("gross_notional"),
        total(F.col("fees_paid").cast(MONEY)).alias("fees_paid"),
        F.count_if(open_ & F.col("mark").isNull()).alias("missing_marks"),
    )


def require_marks(report: DataFrame) -> DataFrame:
    return require_zero(report, {"missing mark for an open position": F.col("missing_marks") > 0})


def equity_report(curve: DataFrame, starting_equity: float, time: str = "d") -> DataFrame:
    """Net profit, return % and maximum drawdown % of an equity curve (one row per period)."""
    run = W.partitionBy(F.lit(0)).orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
    start = F.lit(float(starting_equity))
    peaked = curve.withColumn("_peak", F.greatest(F.max("equity").over(run), start))
    drop = F.when(F.col("_peak") > 0, (F.col("_peak") - F.col("equity")) / F.col("_peak"))
    return peaked.agg(
        F.max_by("equity", time).alias("ending_equity"),
        (F.max_by("equity", time) - start).alias("net_pnl"),
        ((F.max_by("equity", time) - start) / start * 100).alias("return_pct"),
        (F.greatest(F.max(drop), F.lit(0.0)) * 100).alias("max_drawdown_pct"),
    )


def order_rate(orders: DataFrame, limit: int, by: list[str] | None = None, time: str = "ts_ns", window_ns: int = RATE_WINDOW_NS):
    """Offered orders in (t - window, t] and whether the limit is exceeded.

    Counts every offered order; a risk gate that counts approved orders only would see
    fewer. Time is cut into bins of many windows; the end of a bin is copied into the
    next one, so each bin is counted on its own.
    """
    by = by or []
    width = 16 * window_ns
    binned = orders.withColumn("_bin", F.expr(f"{time} div {width}"))
    near_end = F.col(time) > (F.col("_bin") + 1) * F.lit(width) - F.lit(window_ns)
    copies = F.when(near_end, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    spread = binned.withColumn("_halo", F.explode(copies)).withColumn("_bin", F.col("_bin") + F.col("_halo"))
    frame = W.partitionBy(*by, "_bin").orderBy(time).rangeBetween(-(window_ns - 1), 0)
    counted = spread.withColumn("orders_in_window", F.count(F.lit(1)).over(frame)).filter("_halo = 0")
    return counted.drop("_bin", "_halo").withColumn("breach", F.col("orders_in_window") > limit)


def worst_case_exposure(positions: DataFrame, pending: DataFrame, marks: DataFrame) -> DataFrame:
    """Per symbol max(|q + buys|, |q - sells|) in money; a missing mark is flagged."""
    open_orders = pending.groupBy("symbol").agg(
        F.sum(F.when(F.col("side") == "BUY", F.col("quantity")).otherwise(0)).alias("_buys"),
        F.sum(F.when(F.col("side") == "SELL", F.col("quantity")).otherwise(0)).alias("_sells"),
    )
    joined = positions.join(open_orders, "symbol", "full").join(marks, "symbol", "left")
    q = F.coalesce(F.col("quantity"), F.lit(0)).cast("double")
    buys, sells = (F.coalesce(F.col(c), F.lit(0)).cast("double") for c in ("_buys", "_sells"))
    worst = F.greatest(F.abs(q + buys), F.abs(q - sells))
    return joined.select(
        "symbol", worst.alias("worst_quantity"),
        F.when(worst == 0, 0.0).otherwise(worst * F.col("mark") * F.coalesce("multiplier", F.lit(1))).alias("worst_notional"),
        ((worst != 0) & F.col("mark").isNull()).alias("missing_mark"),
    )


def gross_exposure(exposure: DataFrame) -> DataFrame:
    return exposure.agg(
        F.sum("worst_notional").alias("gross_worst_notional"), F.count_if("missing_mark").alias("missing_marks")
    )


# ---- audit log --------------------------------------------------------------


def audit_payload() -> Column:
    """Canonical text a log line's hash covers."""
    return F.to_json(F.struct("data", "event", "previous_hash", "ts_ns"), {"ignoreNullFields": "false"})


def verify_chain(lines: DataFrame, by: list[str] | None = None, number: str = "line_number") -> DataFrame:
    """First corrupt line per log (NULL when intact): a hash that does not recompute or a broken link.

    The predecessor comes from an equality join on the line number, so one long log is
    checked in parallel.
    """
    by = by or []
    previous = lines.select(*by, (F.col(number) + 1).alias(number), F.col("hash").alias("_before"))
    joined = lines.join(previous, [*by, number], "left")
    expected_link = F.when(F.col(number) == 1, F.lit("0" * 64)).otherwise(F.col("_before"))
    bad = ~F.col("previous_hash").eqNullSafe(expected_link) | ~F.col("hash").eqNullSafe(F.sha2(audit_payload(), 256))
    return joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("lines"), F.min(F.when(bad, F.col(number))).alias("first_bad_line")
    )
