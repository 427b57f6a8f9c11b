"""Operator 4: token sequences in training order, as fixed-stride binary shards.

A keyed Feistel network over the smallest even number of bits that holds the index space, with cycle-walking back
into it, permutes the index of every sequence without any table or global sort. The index is the document's place
in the range of doc_ids times the most pieces a document can have, plus the piece, so it is known in the task that
tokenizes the text: one pass, one shuffle. Equal ranges of permuted indexes hold equal shares of the sequences; a
task sorts its range and writes it as one shard, so holes in the index space vanish and the global slot is the rank
of the permuted index. Every record has the same size, so slot s is at byte (s - first_slot) * stride of its shard.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .bpe import Bpe, default_path
from .storage import new_folder, open_input, open_output, readers, stored

_U = np.uint64
HEADER = np.dtype([("doc_id", "<i8"), ("null_id", "u1"), ("pad", "u1"), ("n_tokens", "<u2"), ("piece", "<u4")])
ROUNDS = 6
_WIDEST = 1 << 62


def record_type(sequence_length: int, id_type: str = "<u2") -> np.dtype:
    """A record: 16 bytes of header, then ``sequence_length`` ids, zero beyond n_tokens."""
    return np.dtype([("head", HEADER), ("ids", id_type, (sequence_length,))])


def permute(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Keyed bijection of 0..size-1 onto itself: Feistel rounds, walked on until the value is below ``size``."""
    half = max(1, -(-max(size - 1, 1).bit_length() // 2))
    mask, shift = _U((1 << half) - 1), _U(half)
    keys = [ta.mix(np.array([(key * ROUNDS + r + 1) % (1 << 64)], _U))[0] for r in range(ROUNDS)]
    out = index.astype(_U, copy=True)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (ta.mix(right + k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= _U(size)]
    return out


def write_shards(
    df: DataFrame,
    folder: str,
    key: int = 20240229,
    sequence_length: int = 512,
    end_id: int = 2,
    shard_bytes: int = 32 << 20,
    path: str | None = None,
) -> DataFrame:
    """Tokenize, order and write all documents; return the manifest: shard, uri, first_slot, rows.

    A document is its ids and ``end_id``, cut into sequences of ``sequence_length``, the last one shorter. Null doc_ids
    count as one more id below the smallest; documents that share a doc_id are ordered by piece and content, so the
    order does not depend on partitions. An empty table has an empty manifest. A task writes under a name of its own
    and only the rows of finished attempts reach the manifest: lost executors leave unlisted files, nothing more.
    """
    bpe_size = Bpe.load(path or default_path()).size
    record = record_type(sequence_length, "<u2" if bpe_size <= 1 << 16 else "<u4")
    source = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = F.octet_length("text")
    facts = source.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max(size).alias("most"), F.sum(size).alias("bytes"), F.count("*").alias("n")).first()
    low, high = facts["low"] or 0, facts["high"] or 0
    per_document = -(-((facts["most"] or 0) + 1) // sequence_length)  # a token has at least one byte
    ids = high - low + 2
    space = min(ids * per_document, _WIDEST)
    dense = ids * per_document <= _WIDEST
    sequences = facts["n"] + (facts["bytes"] or 0) // (2 * sequence_length)  # an estimate: it only sets the shard size
    shards = int(max(1, -(-sequences * record.itemsize // shard_bytes)))
    width = -(-space // shards)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path or default_path())
        for part, data, offsets in ta.blocks(batches):
            tokens, at = bpe.encode(data, offsets)
            tokens = np.insert(tokens, at[1:], end_id)
            at = at + np.arange(len(at))
            length = np.diff(at)
            count = -(-length // sequence_length)
            row = np.repeat(np.arange(len(length)), count)
            piece = ta.ranges(np.zeros(len(length), np.int64), count)
            begin = piece * sequence_length
            taken = np.minimum(length[row] - begin, sequence_length)
            doc = part.column("doc_id")
            null = np.asarray(doc.is_null())
            number = np.asarray(doc.fill_null(0))
            place = np.where(null, 0, number - low + 1)[row]
            if dense:
                index = place.astype(_U) * _U(per_document) + piece.astype(_U)
            else:  # ids too far apart: hashed places, equal ones are told apart below
                index = (ta.mix(place) + piece.astype(_U)) % _U(space)
            order = permute(index, space, key)
            out = np.zeros(len(row), record)
            out["head"]["doc_id"], out["head"]["null_id"] = np.where(null, 0, number)[row], null[row]
            out["head"]["n_tokens"], out["head"]["piece"] = taken, piece
            unit = record["ids"].base
            units, head_units = record.itemsize // unit.itemsize, HEADER.itemsize // unit.itemsize
            out.view(unit)[ta.ranges(np.arange(len(row)) * units + head_units, taken)] = tokens[ta.ranges(at[row] + begin, taken)]
            used = HEADER.itemsize + taken * unit.itemsize
            flat = out.view(np.uint8)  # records travel without their padding
            flat = flat[ta.ranges(np.arange(len(row)) * record.itemsize, used)]
            yield pa.record_batch(
                [pa.array((order // _U(width)).astype(np.int32)), pa.array(order.astype(np.int64)), ta.binary(flat, np.append(0, np.cumsum(used)))],
                names=["shard", "place", "record"],
            )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows, file, uri = None, 0, None, ""
        done: list[tuple[int, str, int]] = []
        for batch in batches:
            numbers = batch.column("shard").to_pylist()
            for number, value in zip(numbers, batch.column("record").to_pylist(), strict=True):
                if number != shard:
                    if file:
                        file.close()
                        done.append((shard, uri, rows))
                    shard, rows, uri = number, 0, f"{folder}/shard-{number:06d}-{uuid.uuid4().hex}.bin"
                    file = open_output(uri)
                file.write(value.ljust(record.itemsize, b"\0"))
                rows += 1
        if file:
            file.close()
            done.append((shard, uri, rows))
        yield pa.record_batch([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int64()))], names=["shard", "uri", "rows"])

    cuts = source.mapInArrow(cut, "shard int, place long, record binary")
    ranged = cuts.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "place", "record")  # one shard a task
    written = stored(ranged.mapInArrow(write, "shard int, uri string, rows long"), "shard-rows")
    # One row per shard, not per sequence: the window is as small as the file listing.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("rows").over(before), F.lit(0))
    return written.select("shard", "uri", first.alias("first_slot"), "rows")


def read_slots(
    spark: SparkSession, manifest: DataFrame, sequence_length: int = 512, start: int = 0, stop: int | None = None, id_type: str = "<u2"
) -> DataFrame:
    """Sequences of slots start..stop-1 read back by byte ranges: slot, doc_id, piece, n_tokens, ids (binary u32).

    Reading on after a stop is a seek: nothing before ``start`` is touched. Shards are cut into ranges of their bytes, so
    a large shard is read by several tasks. An empty manifest gives no rows; a shard without rows is not opened.
    """
    record = record_type(sequence_length, id_type)
    step = max(1, (4 << 20) // record.itemsize)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                first, last = shard["first_slot"], min(shard["at"] + step, shard["rows"])
                at = max(shard["at"], start - first)
                end = last if stop is None else min(last, stop - first)
                if at >= end:
                    continue
                with open_input(shard["uri"]) as file:
                    while at < end:
                        n = min(step, end - at)
                        rows = np.frombuffer(file.read_at(n * record.itemsize, at * record.itemsize), record)
                        head = rows["head"]
                        taken = head["n_tokens"].astype(np.int64)
                        ids = rows["ids"].reshape(-1)[ta.ranges(np.arange(n) * sequence_length, taken)].astype("<u4")
                        yield pa.record_batch(
                            [
                                pa.array(np.arange(first + at, first + at + n)),
                                pa.array(head["doc_id"], mask=head["null_id"] == 1),
                                pa.array(head["piece"].astype(np.int32)),
                                pa.array(taken),
                                ta.binary(ids, np.append(0, np.cumsum(taken))),
                            ],
                            names=["slot", "doc_id", "piece", "n_tokens", "ids"],
                        )
                        at += n

    pieces = F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(step).cast("long"))).alias("at")
    ranges = manifest.where("rows > 0").select("uri", "first_slot", "rows", pieces)
    total = manifest.agg(F.sum("rows")).first()[0]
    spread = ranges.repartition(readers((total or 0) * record.itemsize))
    return spread.mapInArrow(read, "slot long, doc_id long, piece int, n_tokens long, ids binary")


def ordered_sequences(df: DataFrame) -> DataFrame:
    """Query: write all documents' shards to the shared folder, read every slot back."""
    spark = df.sparkSession
    manifest = write_shards(df, new_folder(spark, "training-order"))
    return read_slots(spark, manifest).select("slot", "doc_id", "piece", "n_tokens", F.crc32("ids").alias("ids_crc32"))
