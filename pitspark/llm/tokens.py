"""Operator 8: BPE encoding and decoding of whole text columns (rounds in ``bpe.Bpe``)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .bpe import Bpe, default_path


def encode(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", path: str | None = None) -> DataFrame:
    """One row per row of ``df``: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers as binary).

    ``path``: tokenizer file as the workers see it; None takes the public byte-level vocabulary. Null and empty
    texts have no ids, null doc_ids and repeated rows stay, other columns of ``df`` are not read. Texts are
    encoded whole; memory per task is bounded by the longest text, not by the partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path or default_path())
        for part, data, offsets in ta.blocks(batches):
            ids, at = bpe.encode(data, offsets)
            yield pa.record_batch(
                [part.column("doc_id"), pa.array(np.diff(at)), ta.binary(ids.astype("<u4"), at)],
                names=["doc_id", "n_tokens", "ids"],
            )

    source = df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(df: DataFrame, path: str | None = None) -> DataFrame:
    """Replace the column ``ids`` by ``text``, the decoded string; all other columns stay.

    Ids outside the vocabulary stand for nothing, bytes that are no UTF-8 become U+FFFD, null ids an empty text.
    """
    kept = [c for c in df.columns if c not in ("ids", "text")]
    source = df.select(*kept, "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.load(path or default_path())
        for batch in batches:
            for row in range(0, batch.num_rows, 256):
                part = batch.slice(row, 256)
                column = part.column("ids").fill_null(b"").cast(pa.large_binary())
                _, where, raw = column.buffers()
                at = np.frombuffer(where, np.int64, len(column) + 1, column.offset * 8)
                ids = np.frombuffer(raw, np.uint8)[at[0] : at[-1]].view("<u4") if at[-1] > at[0] else np.zeros(0, "<u4")
                data, offsets = bpe.decode(ids, (at - at[0]) // 4)
                raw, ends = data.tobytes(), offsets.tolist()
                texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.record_batch([*(part.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, "text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "ids"]
    return source.mapInArrow(run, ", ".join([*fields, "text string"]))


def digests(df: DataFrame) -> DataFrame:
    """Contract of the query: ids and decoded text as SHA-256 digests."""
    coded = encode(df).withColumn("ids_sha256", F.sha2("ids", 256))
    return decode(coded).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
