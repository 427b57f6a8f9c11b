"""The as-of join used everywhere: backward or forward, strict or inclusive.

Events and targets are put on one time line and every target takes the last
event before it (or the next one after it, by running time backwards). The scan
is binned (see scan.py), so a hot key is spread over its time bins.

NULL policy: a value that is NULL on an event is skipped, so the match looks
further back for that value alone. Pass a struct that is never NULL when an
invalid event must hide the older ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scan import Running, running

OUTER_BINS = 1440
CALENDAR = None  # as a bin width: the calendar bounds a key, so one group holds it


def asof_join(
    targets: DataFrame,
    events: DataFrame,
    by: list[str],
    target_time: str,
    event_time: str,
    values: dict[str, Column],
    direction: str = "backward",
    strict: bool = False,
    tolerance: int | None = None,
    *,
    bin_width: int | None,
) -> DataFrame:
    """Targets plus ``<name>`` and ``<name>_at`` for each value; NULL without a match.

    Times are BIGINT in one unit. ``strict`` excludes an event at the target
    itself; ``tolerance`` is inclusive. Rows are scanned per bin of ``bin_width`` (same
    unit). ``CALENDAR`` makes a key one group: only for series of at most a row a day.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction must be backward or forward")
    sign = 1 if direction == "backward" else -1
    event_rank, target_rank = (1, 0) if strict else (0, 1)
    names = list(values)

    left = targets.select(
        *by,
        (F.col(target_time).cast("bigint") * sign).alias("_t"),
        F.lit(target_rank).alias("_tie"),
        F.struct(*targets.columns).alias("_target"),
    )
    right = events.select(
        *by,
        (F.col(event_time).cast("bigint") * sign).alias("_t"),
        F.lit(event_rank).alias("_tie"),
        *[
            F.when(v.isNotNull(), F.struct(F.col(event_time).cast("bigint").alias("at"), v.alias("value"))).alias(
                f"_v_{n}"
            )
            for n, v in values.items()
        ],
    )
    line = left.unionByName(right, allowMissingColumns=True)
    is_target = F.col("_target").isNotNull()
    specs = [Running(f"_m_{n}", F.col(f"_v_{n}"), "last") for n in names]

    if bin_width is None:
        frame = W.partitionBy(*by).orderBy("_t", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
        matched = line.select(
            "_target", "_t", *[s.over(s.column, frame).alias(s.name) for s in specs]
        ).filter(is_target)
    else:
        line = line.withColumn("_outer", F.expr(f"_t div {bin_width * OUTER_BINS}")).withColumn(
            "_inner", F.expr(f"_t div {bin_width}")
        )
        matched = running(line, by, ["_outer", "_inner"], ["_t", "_tie"], specs, keep=is_target)

    def within(name: str) -> Column:
        hit = F.col(f"_m_{name}").isNotNull()
        if tolerance is None:
            return hit
        return hit & (F.abs(F.col(f"_m_{name}.at") * sign - F.col("_t")) <= tolerance)

    return matched.select(
        "_target.*",
        *[F.when(within(n), F.col(f"_m_{n}.value")).alias(n) for n in names],
        *[F.when(within(n), F.col(f"_m_{n}.at")).alias(f"{n}_at") for n in names],
    )
