"""Running values over long sequences without one task per key.

A plain ``partitionBy(key).orderBy(t)`` window puts a whole key into one task.
When a third of all rows share a key that task decides the runtime. Here the
sequence is cut into nested bins that follow its order (for instance day, then
minute). Every bin is scanned on its own; bin totals are small, and their
exclusive prefixes are added back. Groups are therefore (key, innermost bin) at
row level and (key, outer bin) on the totals.

Bins must be non-decreasing along the order and neither keys nor bins may be NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Running:
    """Output ``name``: running sum, max or min of ``column``, its last non-NULL value, or its previous value.

    "prev" is the value on the row before (NULL on the first row of a key).
    """

    name: str
    column: Column
    how: str = "sum"

    def over(self, column: Column, window) -> Column:
        if self.how in ("last", "prev"):
            return F.last(column, ignorenulls=True).over(window)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.how](column).over(window)

    def total(self, column: Column, order: list[str]) -> Column:
        if self.how in ("last", "prev"):
            at = F.col(order[0]) if len(order) == 1 else F.struct(*order)
            return F.max_by(column, F.when(column.isNotNull(), at))
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.how](column)

    def combine(self, inner: Column, outer: list[Column], kind: T.DataType) -> Column:
        if self.how == "sum":
            # adding two DECIMAL(38,s) would drop a digit of the scale; 36 digits leave room
            fit = (lambda c: c.cast(T.DecimalType(36, kind.scale))) if isinstance(kind, T.DecimalType) else (lambda c: c)
            result = fit(inner)
            for part in outer:
                result = fit(result + F.coalesce(fit(part), fit(F.lit(0))))
            return result
        if self.how in ("last", "prev"):
            return F.coalesce(inner, *outer)
        pick = F.greatest if self.how == "max" else F.least
        return pick(inner, *outer) if outer else inner


def running(
    df: DataFrame,
    keys: list[str],
    levels: list[str],
    order: list[str],
    specs: list[Running],
    keep: Column | None = None,
) -> DataFrame:
    """Inclusive running values along ``order`` within ``keys``.

    ``keep`` restricts which rows are returned (all rows still count towards the
    running values); it is applied before the prefixes are joined back.
    """
    cells = keys + levels
    source = df.select("*", *[s.column.alias(f"_in_{s.name}") for s in specs])
    inner = W.partitionBy(*cells).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    ordered = W.partitionBy(*cells).orderBy(*order)
    rows = source.select(
        "*",
        *[
            (F.lag(f"_in_{s.name}").over(ordered) if s.how == "prev" else s.over(F.col(f"_in_{s.name}"), inner)).alias(
                f"_run_{s.name}"
            )
            for s in specs
        ],
    )
    if keep is not None:
        rows = rows.filter(keep)

    present = F.lit(True)
    for name in cells:
        present = present & F.col(name).isNotNull()
    # with the filter spelled out, joins infer nothing new and all levels share one exchange
    totals = source.filter(present).groupBy(*cells).agg(
        *[s.total(F.col(f"_in_{s.name}"), order).alias(f"_tot_{s.name}") for s in specs]
    )
    prefixes = None
    for depth in range(len(levels), 0, -1):
        group, level = keys + levels[: depth - 1], levels[depth - 1]
        before = W.partitionBy(*group).orderBy(level).rowsBetween(W.unboundedPreceding, -1)
        part = totals.select(
            *group,
            level,
            *[s.over(F.col(f"_tot_{s.name}"), before).alias(f"_pre{depth}_{s.name}") for s in specs],
        )
        prefixes = part if prefixes is None else prefixes.join(part, group + [level])
        if depth > 1:
            totals = totals.groupBy(*group).agg(
                *[s.total(F.col(f"_tot_{s.name}"), [level]).alias(f"_tot_{s.name}") for s in specs]
            )
    joined = rows.join(prefixes, cells, "left")
    outputs = [
        s.combine(
            F.col(f"_run_{s.name}"),
            [F.col(f"_pre{d}_{s.name}") for d in range(len(levels), 0, -1)],
            rows.schema[f"_run_{s.name}"].dataType,
        ).alias(s.name)
        for s in specs
    ]
    return joined.select(*df.columns, *outputs)
