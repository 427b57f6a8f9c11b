"""Exact linear-interpolated quantiles for groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation
buffer. Here values are counted first (copies collapse map-side), cut into bins
by an approximate sketch, and ranked inside the bins; the sketch only balances
the bins, so the result stays exact. A bin that is still large is cut again by a
sketch of its own, so a group of any size is spread over up to 256 x 256 bins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_BINS = 256
_LARGE = 100_000  # distinct values above which a bin is cut again


def _bin_of(value: Column, cuts: Column) -> Column:
    """Number of sorted cuts below the value, by halving: eight steps for 255 cuts."""
    halves = F.array(*[F.lit(_BINS >> k) for k in range(1, _BINS.bit_length())])
    return F.aggregate(
        halves,
        F.lit(0),
        lambda found, half: found + F.when(F.get(cuts, found + half - 1) < value, half).otherwise(0),
    )


def value_ranks(df: DataFrame, keys: list[str], value: str, weights: dict[str, Column] | None = None) -> DataFrame:
    """One row per (keys, value): ``n``, ``below`` (rows with a smaller value), ``total``.

    ``weights`` adds summed columns and, for each, the sum over smaller values.
    """
    weights = weights or {}
    sums = {"n": F.count(F.lit(1)), **{k: F.sum(c) for k, c in weights.items()}}
    counted = df.groupBy(*keys, value).agg(*[c.alias(k) for k, c in sums.items()])
    cuts = df.groupBy(*keys).agg(
        F.percentile_approx(value, [i / _BINS for i in range(1, _BINS)], 1000).alias("_cuts")
    )
    if keys:
        placed = counted.join(cuts, keys)
    else:
        placed = counted.withColumn("_cuts", cuts.scalar())
    outer = placed.withColumn("_outer", _bin_of(F.col(value), F.col("_cuts"))).drop("_cuts")
    finer = outer.groupBy(*keys, "_outer").agg(
        F.count(F.lit(1)).alias("_values"),
        F.percentile_approx(value, [i / _BINS for i in range(1, _BINS)], 1000).alias("_cuts"),
    )
    cut_again = finer.filter(F.col("_values") > _LARGE).drop("_values")
    inner = F.when(F.col("_cuts").isNull(), 0).otherwise(_bin_of(F.col(value), F.col("_cuts")))
    nested = outer.join(cut_again, [*keys, "_outer"], "left")
    binned = nested.withColumn("_bin", F.col("_outer") * _BINS + inner).drop("_cuts", "_outer")

    totals = binned.groupBy(*keys, "_bin").agg(*[F.sum(k).alias(f"_b_{k}") for k in sums])
    before_bin = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*keys)
    offsets = totals.select(
        *keys,
        "_bin",
        *[F.coalesce(F.sum(f"_b_{k}").over(before_bin), F.lit(0)).alias(f"_o_{k}") for k in sums],
        F.sum("_b_n").over(whole).alias("total"),
    )
    in_bin = W.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    ranked = binned.select(
        "*", *[F.coalesce(F.sum(k).over(in_bin), F.lit(0)).alias(f"_r_{k}") for k in sums]
    )
    names = {"n": "below", **{k: f"{k}_below" for k in weights}}
    return ranked.join(offsets, [*keys, "_bin"]).select(
        *keys,
        value,
        *sums,
        *[(F.col(f"_o_{k}") + F.col(f"_r_{k}")).alias(names[k]) for k in sums],
        "total",
    )


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """One row per group with a column per named probability; NULL values are ignored."""
    ranked = value_ranks(df.filter(F.col(value).isNotNull()), keys, value)
    aggregates = []
    for name, p in probabilities.items():
        position = (F.col("total") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            covers = (F.col("below") <= rank) & (rank < F.col("below") + F.col("n"))
            aggregates.append(F.max(F.when(covers, F.col(value))).alias(f"_{side}_{name}"))
    picked = ranked.groupBy(*keys).agg(F.max("total").alias("_total"), *aggregates)
    outputs = []
    for name, p in probabilities.items():
        position = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outputs.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return picked.select(*keys, *outputs)
