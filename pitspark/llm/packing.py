"""Operator 7: best-fit packing planned over the histogram of lengths.

The plan never sees documents: best fit in decreasing length works on counts (at most ``capacity`` lengths, so it
is small whatever the corpus). It yields runs of equal slots; pieces then take slots by an equality join on
(length, rank within the length).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .bpe import Bpe, default_path
from .storage import stored

SLOT_RUN = "length int, first_rank long, count long, first_sequence long, offset int"
_CHUNK = 1 << 14  # slots that one row unfolds to


def pieces(df: DataFrame, capacity: int = 1024, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Token pieces: doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit).

    A document is its ids followed by ``end_id``, so a null or empty text is the end id alone. Only documents longer
    than ``capacity`` are cut, into pieces of exactly ``capacity``; a remainder makes the first piece.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path or default_path())
        for part, data, offsets in ta.blocks(batches):
            ids, at = bpe.encode(data, offsets)
            ids = np.insert(ids.astype("<u4"), at[1:], end_id)
            at = at + np.arange(len(at))
            size = np.diff(at)
            count = -(-size // capacity)
            row = np.repeat(np.arange(len(size)), count)
            piece = ta.ranges(np.zeros(len(size), np.int64), count)
            head = size - (count - 1) * capacity
            end = head[row] + piece * capacity
            start = np.where(piece == 0, 0, end - capacity)
            cuts = np.append(at[row] + start, at[-1])
            yield pa.record_batch(
                [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(end - start), ta.binary(ids, cuts)],
                names=["doc_id", "piece", "start", "length", "ids"],
            )

    source = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs of slots (length, first rank, count, first sequence, offset) for all counted lengths.

    Best fit decreasing: the longest pieces first, each into the fullest sequence that has room, as many at once as
    there are equal sequences. Offsets of a sequence are gapless from 0.
    """
    open_at: dict[int, list[list]] = {}  # free room -> [number of sequences, pattern of (length, times)]
    rooms: list[int] = []
    closed: list[list] = []

    def put(room: int, count: int, pattern: tuple):
        if not count:
            return
        if room == 0:
            closed.append([count, pattern])
            return
        if room not in open_at:
            open_at[room] = []
            insort(rooms, room)
        open_at[room].append([count, pattern])

    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is not within 1..{capacity}")
        left = histogram[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                count, pattern = open_at[room].pop()
                if not open_at[room]:
                    del open_at[room]
                    rooms.pop(at)
            else:
                room, count, pattern = capacity, left, ()
            times = room // length
            full = min(count, left // times)
            put(room - times * length, full, (*pattern, (length, times)))
            left, count = left - full * times, count - full
            if left and count and left < times:
                put(room - left * length, 1, (*pattern, (length, left)))
                left, count = 0, count - 1
            if pattern:
                put(room, count, pattern)
    for room in rooms:
        closed += open_at[room]
    runs, ranks, sequence = [], dict.fromkeys(histogram, 0), 0
    for count, pattern in closed:
        offset = 0
        for length, times in pattern:
            for _ in range(times):
                runs.append((length, ranks[length], count, sequence, offset))
                ranks[length] += count
                offset += length
        sequence += count
    return runs


def pack(df: DataFrame, order_by: list[str], capacity: int = 1024) -> DataFrame:
    """Add sequence_id and offset to rows with a ``length`` of 1 to ``capacity``.

    ``df`` is read several times and must give the same rows each time (store it first). Ranks are exact without
    gathering a length in one task: rows are numbered within (length, bucket), buckets start at the sum of those
    before. Ties and repeated rows take slots of their own; an empty table stays empty. Lengths outside the range
    raise. Columns of ``df`` other than length and order_by are carried along unread.
    """
    spark = df.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*order_by), F.lit(buckets)).cast("int"))
    counts = stored(rows.groupBy("length", "_bucket").count(), "pack-counts")
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base"))
    number = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order_by))
    ranked = rows.withColumn("_number", number).join(bases, ["length", "_bucket"]).withColumn("_rank", F.col("_base") + F.col("_number") - 1)
    # Unfolded slots are as many as pieces, which the size estimate of their few source rows does not show: merge.
    planned = slots(spark, plan(histogram, capacity)).hint("merge")
    return ranked.join(planned, ["length", "_rank"]).drop("_bucket", "_base", "_number", "_rank")


def slots(spark, runs: list[tuple]) -> DataFrame:
    """All planned slots, unfolded on the executors: length, _rank, sequence_id, offset."""
    table = spark.createDataFrame(runs, SLOT_RUN)
    part = table.select("*", F.explode(F.expr(f"sequence(0L, (count - 1) div {_CHUNK})")).alias("_part"))
    first, last = F.col("_part") * _CHUNK, F.least((F.col("_part") + 1) * _CHUNK, F.col("count")) - 1
    unfolded = part.repartition("length", "first_rank", "_part").select("*", F.explode(F.sequence(first, last)).alias("_step"))
    return unfolded.select(
        F.col("length").cast("long").alias("length"),
        (F.col("first_rank") + F.col("_step")).alias("_rank"),
        (F.col("first_sequence") + F.col("_step")).alias("sequence_id"),
        F.col("offset").cast("long").alias("offset"),
    )


def packed_documents(df: DataFrame, capacity: int = 1024) -> DataFrame:
    """Contract of the query: every piece with the checksum of its ids and its place.

    Pieces are tokenized once; the stored table has their checksums, not their ids.
    """
    cut = pieces(df, capacity).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    table = stored(cut, "pieces")
    places = pack(table, ["doc_id", "piece", "ids_crc32"], capacity)
    return places.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
