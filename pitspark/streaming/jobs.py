"""Streaming jobs with their own tables: ledger, point-in-time ingest, settlement.

Each micro-batch runs the batch operator against what earlier ones left and overwrites its own partition
``batch_id``; a replayed batch rewrites the same partition from the same inputs, so a restart changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.reasons import finite
from ..operators import ledger, warehouse
from ..operators.metrics import signal


def table(spark: SparkSession, root: str, schema: str, partitions: tuple[str, ...] = ("batch_id",)) -> DataFrame:
    """A Parquet table partitioned by ``partitions`` (the batch last), empty where nothing was written yet."""
    empty = spark.createDataFrame([], schema)
    empty.write.partitionBy(*partitions).mode("append").parquet(root)
    return spark.read.schema(empty.schema).parquet(root)


def overwrite_batch(rows: DataFrame, root: str, batch_id: int, partitions: tuple[str, ...] = ("batch_id",)) -> None:
    stamped = rows.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    stamped.write.partitionBy(*partitions).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(root)


def newest(rows: DataFrame, before: int = 2**62) -> DataFrame:
    """Rows of the newest batch below ``before``; the comparison prunes partitions."""
    last = rows.where(F.col("batch_id") < before).agg(F.max("batch_id")).first()[0]  # partition values only
    return rows.where(F.col("batch_id") == F.lit(-1 if last is None else last))


def _started(stream: DataFrame, step, checkpoint: str, trigger: dict | None):
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


POSITION_SCHEMA = "symbol string, quantity decimal(28,8), average_price decimal(28,20), realized_pnl decimal(36,18)"


def position_schema(fills: DataFrame, order: list[str]) -> str:
    """A snapshot of all positions per batch, with the place of the last fill that counts."""
    place = ", ".join(f"{c}: {fills.schema[c].dataType.simpleString()}" for c in order)
    return f"{POSITION_SCHEMA}, last struct<{place}>, batch_id bigint"


def ledger_job(
    fills: DataFrame, positions: str, late: str, checkpoint: str, day: str, bin_: str, order: list[str],
    trigger: dict | None = None,
):
    """Average-cost positions kept up to date by micro-batches, as snapshots in the table ``positions``.

    Average cost depends on the order of fills. A fill that comes after a later one of its symbol has been counted
    cannot be placed any more: it goes to the table ``late`` and leaves the position as it is.
    """
    spark, schema = fills.sparkSession, position_schema(fills, order)
    table(spark, positions, schema)
    table(spark, late, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fills.schema), "batch_id bigint"]))

    def step(batch: DataFrame, batch_id: int) -> None:
        opening = newest(table(batch.sparkSession, positions, schema), batch_id)
        placed = batch.join(opening.select("symbol", "last"), "symbol", "left")
        is_late = F.coalesce(F.struct(*order) <= F.col("last"), F.lit(False))
        overwrite_batch(placed.where(is_late).select(*batch.columns), late, batch_id)
        timely = placed.where(~is_late).select(*batch.columns)
        daily = ledger.average_cost(timely, day, bin_, order, opening=opening)
        last = timely.groupBy("symbol").agg(F.max(F.struct(*order)).alias("last"))
        touched = ledger.closing_positions(daily, day).join(last, "symbol")
        quiet = opening.join(last.select("symbol"), "symbol", "left_anti")
        columns = ["symbol", "quantity", "average_price", "realized_pnl", "last"]
        overwrite_batch(touched.select(*columns).unionByName(quiet.select(*columns)), positions, batch_id)

    return _started(fills, step, checkpoint, trigger)


SNAPSHOT_PARTS = ("period", "batch_id")


def ingest_job(bars: DataFrame, root: str, schema: str, checkpoint: str, trigger: dict | None = None):
    """Append-if-changed ingest: each micro-batch adds only new or changed snapshots.

    The table is partitioned by the month of the bar; a batch reads the months it brings, not the whole history.
    """
    parts = f"{schema}, period date, batch_id bigint"
    table(bars.sparkSession, root, parts, SNAPSHOT_PARTS)

    def step(batch: DataFrame, batch_id: int) -> None:
        month = F.trunc(F.col("event_time").cast("date"), "month")
        months = [r.period for r in batch.select(month.alias("period")).distinct().collect()]  # bounded by the calendar
        stored = table(batch.sparkSession, root, parts, SNAPSHOT_PARTS)
        touched = stored.where(F.col("period").isin(months) & (F.col("batch_id") < batch_id)).drop(*SNAPSHOT_PARTS)
        added = warehouse.append_if_changed(touched, batch).withColumn("period", month)
        overwrite_batch(added, root, batch_id, SNAPSHOT_PARTS)

    return _started(bars, step, checkpoint, trigger)


def settlement_stream(signals: DataFrame, bars: DataFrame, lateness: str = "7 days", wait: str = "3 days") -> DataFrame:
    """Every pending signal leaves once: EVALUATED or INVALID_BAR with its exact target bar, else EXPIRED.

    ``signals`` has event time ``target_close``, ``bars`` has ``closed_at``. An outer interval join: the bar must close
    within ``wait`` of the target's close, and the watermark (``lateness`` behind both inputs) bounds the state; a signal
    without a bar is written when the watermark has passed its wait.
    """
    if "status" in signals.columns:
        signals = signals.filter(F.col("status") == "PENDING")
    valid = F.lit(True)
    for price in ("open", "close"):
        valid = valid & finite(F.col(price)) & (F.col(price) > 0)
    s = signals.withWatermark("target_close", lateness).alias("s")
    b = bars.withColumn("valid", valid).withWatermark("closed_at", lateness).alias("b")
    on = (
        (F.col("s.symbol") == F.col("b.symbol"))
        & (F.col("s.target_session") == F.col("b.session_date"))
        & (F.col("b.closed_at") >= F.col("s.target_close"))
        & (F.col("b.closed_at") <= F.col("s.target_close") + F.expr(f"INTERVAL {wait}"))
    )
    good = F.coalesce(F.col("b.valid"), F.lit(False))
    realized = F.when(good, F.try_divide(F.col("b.close"), F.col("b.open")) - 1)
    direction = signal(F.col("s.probability_up"))
    return s.join(b, on, "leftOuter").select(
        F.col("s.signal_id").alias("signal_id"), F.col("s.symbol").alias("symbol"),
        F.col("s.target_session").alias("target_session"),
        F.when(F.col("b.symbol").isNull(), "EXPIRED").when(good, "EVALUATED").otherwise("INVALID_BAR").alias("outcome"),
        realized.alias("realized_return"),
        (direction * realized - F.when(direction != 0, F.col("s.cost_bps") / 10000).otherwise(0.0)).alias("strategy_return"),
    )


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there now into parquet files (append mode)."""
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
    query.awaitTermination()


def run_complete(stream: DataFrame, write: Callable[[DataFrame], None], checkpoint: str) -> None:
    """Run a stream to the end; the final complete result goes to ``write`` per micro-batch."""
    query = stream.writeStream.outputMode("complete").foreachBatch(lambda df, _: write(df)).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start()
    query.awaitTermination()
