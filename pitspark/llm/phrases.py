"""Operator 10: Lempel-Ziv phrase fingerprints.

A text's UTF-8 bytes are parsed into LZ78 phrases (each the longest phrase known so far and one more byte). The set of
phrases is hashed and reduced to the minimum hash of each of ``BINS`` equal parts of the hash space; the share of equal
minima estimates the Jaccard likeness of two phrase sets, which follows how well one text compresses the other.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta

BINS = 256
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
EMPTY = np.uint32(0xFFFFFFFF)


def parse(data: bytes, fork: int = -1, other: bytes = b"") -> tuple[list[int], list[int]]:
    """Ends of the LZ78 phrases of ``data``; and of ``data[:fork] + other`` if ``fork`` is not negative.

    The second parse goes on from the first one's state at ``fork``. A last phrase that is known already ends the text.
    """
    known: dict[int, int] = {}
    get = known.get
    ends: list[int] = []
    added: list[int] = []
    node, size = 0, 256

    def walk(part: bytes, at: int, node: int, size: int) -> tuple[int, int]:
        for at, byte in enumerate(part, at + 1):  # noqa: B020
            key = node | byte
            node = get(key, 0)
            if not node:
                known[key] = size
                size += 256
                added.append(key)
                ends.append(at)
        return node, size

    if fork < 0:
        node, size = walk(data, 0, node, size)
        return (ends + [len(data)] if node else ends), []
    node, size = walk(data[:fork], 0, node, size)
    mark, held = len(ends), (node, size)
    node, size = walk(data[fork:], fork, node, size)
    own = ends + [len(data)] if node else ends[:]
    for key in added[mark:]:
        del known[key]
    del ends[mark:]
    node, size = walk(other, fork, *held)
    return own, (ends + [fork + len(other)] if node else ends)


def signatures(texts: list[bytes], ends: list[list[int]]) -> np.ndarray:
    """Minimum hashes, one row of BINS per text; EMPTY where a part of the hash space has no phrase."""
    out = np.full((len(texts), BINS), EMPTY)
    data = np.frombuffer(b"".join(texts), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    count = np.array([len(e) for e in ends])
    if not len(data):
        return out
    row = np.repeat(np.arange(len(texts)), count)
    end = np.concatenate([np.asarray(e, np.int64) for e in ends]) + base[row]
    start = np.concatenate([[0], end[:-1]])
    start[np.cumsum(count[count > 0])[:-1]] = base[:-1][count > 0][1:]
    start[0] = base[:-1][count > 0][0]
    value = ta.mix(ta.PrefixHash(data).ranges(start, end) + ta.mix(end - start))
    cell = row * BINS + (value >> _SHIFT).astype(np.int64)
    low = np.minimum((value & np.uint64(0xFFFFFFFF)).astype(np.uint32), EMPTY - np.uint32(1))
    order = np.argsort(cell, kind="stable")
    first = np.flatnonzero(np.append(True, cell[order][1:] != cell[order][:-1]))
    out.reshape(-1)[cell[order][first]] = np.minimum.reduceat(low[order], first)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal minima among the parts that either has; two texts without phrases are alike."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=1)
    same = ((a == b) & (a != EMPTY)).sum(axis=1)
    return np.where(used > 0, same / np.maximum(used, 1), 1.0)


def as_text(signature: np.ndarray) -> list[str]:
    return [base64.b64encode(row.astype("<u4").tobytes()).decode() for row in signature]


def fingerprints(df: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of (doc_id, text); null texts count as empty. Map only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in ta.blocks(batches):
            raw, at = data.tobytes(), offsets.tolist()
            texts = [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch([part.column("doc_id"), pa.array(as_text(signatures(texts, [parse(t)[0] for t in texts])))], names=["doc_id", "fingerprint"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def in_order(df: DataFrame) -> DataFrame:
    """Rows of (doc_id, text) cut into bins of descending doc_id, each closed by a copy of the row that follows it.

    Columns: bin, closing, doc_id, text, dealt by bin and sorted. The row after the last is the first. Rows with the
    same doc_id go by descending text, null doc_ids come last. Only the largest doc_id of each bin reaches the driver:
    as many values as there are bins, which depends on the number of shuffle partitions alone.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = df.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("_at", F.col("doc_id").cast("double"))
    cuts = sorted(set(source.approxQuantile("_at", [k / (4 * partitions) for k in range(1, 4 * partitions)], 0.2 / partitions)))
    if len(cuts) > 1:
        bucketizer = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_at", outputCol="_bucket", handleInvalid="keep")
        top = len(cuts)
        binned = bucketizer.transform(source).withColumn("bin", F.when(F.col("doc_id").isNull(), top + 1).otherwise(top - F.col("_bucket")).cast("int"))
    else:
        binned = source.withColumn("bin", F.when(F.col("doc_id").isNull(), 1).otherwise(0))
    heads = sorted((r["bin"], r["head"]) for r in binned.groupBy("bin").agg(F.max("doc_id").alias("head")).collect())
    before = [(head, heads[k - 1][0]) for k, (_, head) in enumerate(heads)]  # the first bin's head closes the last
    closes = spark.createDataFrame(before, "head long, closes int")
    marked = binned.join(F.broadcast(closes), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct(F.col("bin").alias("bin"), F.lit(False).alias("closing"))
    copy = F.struct(F.col("closes").alias("bin"), F.lit(True).alias("closing"))
    places = F.when(F.col("closes").isNull(), F.array(own)).otherwise(F.array(own, copy))
    rows = marked.select(F.explode(places).alias("p"), "doc_id", "text").select("p.bin", "p.closing", "doc_id", "text")
    return rows.repartition(partitions, "bin").sortWithinPartitions("bin", "closing", F.col("doc_id").desc_nulls_last(), F.col("text").desc())


def edited_fingerprints(df: DataFrame) -> DataFrame:
    """Contract of the query, over (doc_id, text): fingerprints of every text and of its edited text, and likeness.

    The edited text keeps the first code points and has the last floor(n_chars / 2) replaced by the first as many (or
    all) of the next document. Null texts count as empty; one document is its own next.
    """

    def half_byte(text: bytes, chars: int) -> int:
        """Byte offset of code point number ``chars`` (or the end)."""
        if text.isascii():
            return min(chars, len(text))
        lead = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)
        return int(lead[chars]) if chars < len(lead) else len(text)

    def work(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        """All rows but the last, whose only use is to be the next one."""
        from hashlib import sha256

        chars = [len(t.decode("utf-8", "replace")) for t in texts[:-1]]
        own_ends, edited_ends, edited = [], [], []
        for text, following, n in zip(texts[:-1], texts[1:], chars, strict=True):
            fork = half_byte(text, n - n // 2)
            put = following[: half_byte(following, n // 2)]
            own, new = parse(text, fork, put)
            own_ends.append(own)
            edited_ends.append(new)
            edited.append(text[:fork] + put)
        own_ends.append(parse(texts[-1])[0])
        own, new = signatures(texts, own_ends), signatures(edited, edited_ends)
        return pa.record_batch(
            [
                pa.array(ids[:-1], pa.int64()),
                pa.array(chars, pa.int64()),
                pa.array([sha256(t).hexdigest() for t in edited]),
                pa.array(as_text(own[:-1])),
                pa.array(as_text(new)),
                pa.array(likeness(own[:-1], new)),
                pa.array(likeness(own[:-1], own[1:])),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, bin_now, closed = [], [], 0, None, False
        for part, data, offsets in ta.blocks(batches):
            raw, at = data.tobytes(), offsets.tolist()
            for k, (number, closing, doc_id) in enumerate(zip(part.column("bin").to_pylist(), part.column("closing").to_pylist(), part.column("doc_id").to_pylist(), strict=True)):
                if number != bin_now:
                    ids, texts, size, bin_now, closed = [], [], 0, number, False
                if closed:
                    continue  # further rows with the doc_id of the closing one
                ids.append(doc_id)
                texts.append(raw[at[k] : at[k + 1]])
                size += len(texts[-1])
                closed = closing
                if len(texts) > 1 and (closing or size >= ta.BLOCK_BYTES or len(texts) > 2000):
                    yield work(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])

    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return in_order(df).mapInArrow(run, fields)
