"""Knowledge-time rules and latest-version selection.

Two strengths exist and are never mixed: warehouse reads are inclusive
(``available_at <= T``), evidence reads are strict (``available_at < T``, and in
``local_observed`` mode also ``ingested_at < T``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MODES = ("local_observed", "reconstructed")


def known_inclusive(cutoff: Column) -> Column:
    return F.col("available_at") <= cutoff


def known_strict(cutoff: Column, mode: str = "local_observed") -> Column:
    if mode not in MODES:
        raise ValueError("unsupported availability mode")
    known = F.col("available_at") < cutoff
    return known & (F.col("ingested_at") < cutoff) if mode == "local_observed" else known


def latest_version(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row per key in ``order``.

    ``row_number() = 1`` becomes a group limit that runs before the shuffle, so a
    task sends one row per key it saw, however many versions a key has.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def first_cutoff(df: DataFrame, cutoffs: DataFrame, time: str, strict: bool = False) -> DataFrame:
    """Adds ``cutoff_index``: the first cutoff (1-based, ascending) at which a row is known.

    Rows known only after the last cutoff drop out. ``cutoffs(cutoff)`` holds distinct instants, as many as a calendar
    has. Rows older than the first cutoff need no match. The gap between neighbouring cutoffs is spread over the hours it
    touches, so the others are matched by an equality join on the hour plus a residual comparison. The hours are bounded
    by the calendar and broadcast: the rows themselves are not shuffled before they are reduced to one per key.
    """
    order = W.partitionBy(F.lit(0)).orderBy("cutoff")
    spans = cutoffs.select(
        "cutoff", F.row_number().over(order).alias("cutoff_index"), F.lag("cutoff").over(order).alias("_after")
    )
    hour = lambda c: F.date_trunc("HOUR", c)
    hours = spans.filter(F.col("_after").isNotNull()).select(
        "cutoff", "cutoff_index", "_after",
        F.explode(F.sequence(hour(F.col("_after")), hour(F.col("cutoff")), F.expr("INTERVAL 1 HOUR"))).alias("_hour"),
    )
    earliest = cutoffs.agg(F.min("cutoff")).scalar()
    t = F.col(time)
    before = (lambda bound: t < bound) if strict else (lambda bound: t <= bound)
    old = df.filter(before(earliest)).withColumn("cutoff_index", F.lit(1))
    later = df.filter(~before(earliest)).withColumn("_hour", hour(t))
    matched = later.join(F.broadcast(hours), "_hour").filter(before(F.col("cutoff")) & ~before(F.col("_after")))
    return old.unionByName(matched.select(*df.columns, "cutoff_index"))


def versions_at_cutoffs(
    df: DataFrame,
    cutoffs: DataFrame,
    keys: list[str],
    ranking: list[Column],
    known_at: str = "available_at",
    strict: bool = False,
) -> DataFrame:
    """The winning version of every key at every cutoff (one row per key and cutoff).

    ``ranking`` is descending with NULLs last. Each key is first reduced to one row
    per cutoff interval before the shuffle, so carrying winners forward handles at
    most as many rows per key as there are cutoffs.
    """
    placed = first_cutoff(df, cutoffs, known_at, strict)
    best = latest_version(placed, [*keys, "cutoff_index"], [c.desc_nulls_last() for c in ranking])
    best = best.withColumn("_rank", F.struct(*ranking))
    payload = [c for c in df.columns if c not in keys]
    carry = W.partitionBy(*keys).orderBy("cutoff_index").rowsBetween(W.unboundedPreceding, W.currentRow)
    winners = best.select(
        *keys,
        "cutoff_index",
        F.max(F.struct("_rank", F.struct(*payload).alias("row"))).over(carry).alias("_win"),
        F.lead("cutoff_index").over(W.partitionBy(*keys).orderBy("cutoff_index")).alias("_next"),
    )
    order = W.partitionBy(F.lit(0)).orderBy("cutoff")
    indexed = cutoffs.select("cutoff", F.row_number().over(order).alias("cutoff_index"))
    last = cutoffs.agg(F.count(F.lit(1)).cast("int")).scalar()
    spans = winners.select(
        *keys,
        *[F.col(f"_win.row.{c}").alias(c) for c in payload],
        F.sequence(F.col("cutoff_index"), F.coalesce(F.col("_next") - 1, last)).alias("_span"),
    )
    filled = spans.select(*keys, *payload, F.explode("_span").alias("cutoff_index"))
    return filled.join(indexed, "cutoff_index").select("cutoff", *keys, *payload)
