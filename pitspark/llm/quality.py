"""Operator 6: quality rules with compression bands.

A text is rejected when zstandard shrinks it too well (repetition) or too little (noise) for its length. The ratio is
taken over the whole text and over fixed chunks, so that a repetitive or random stretch shows in a long text too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .storage import small_batches

# (bytes from, lowest ratio, highest ratio): raw bytes over compressed bytes, zstandard level 3. Short texts carry
# the frame header and no history, so their ratios are low whatever they say; ordinary prose of four languages keeps
# at least a fifth of a distance from both limits at every length.
BANDS = ((0, 0.0, 3.0), (64, 0.6, 2.6), (128, 0.85, 2.8), (256, 1.0, 2.8), (512, 1.15, 2.9), (1024, 1.3, 3.0), (2048, 1.4, 3.1), (4096, 1.45, 3.2), (8192, 1.5, 3.4), (32768, 1.5, 3.6))
CHUNK_BYTES = 4096
BAD_CHUNK_SHARE = 0.25  # of a text's bytes that may lie in chunks outside their band
LEVEL = 3
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

MEASURES = (
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("ratio", "double"), ("bad_chunk_share", "double"), ("base_failed", "boolean"), ("kept", "boolean"),
)


def _per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of true flags between the offsets ``at``."""
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[at[1:]] - total[at[:-1]]


def _groups(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated, later): whether (row, key) occurs twice or more, and whether it occurred before."""
    mixed = ta.mix(key + ta.mix(row))
    order = np.argsort(mixed, kind="stable")
    ordered = mixed[order]
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    repeated, later = np.zeros(len(order), bool), np.zeros(len(order), bool)
    later[order] = same[:-1]
    repeated[order] = same[:-1] | same[1:]
    return repeated, later


def within(size: np.ndarray, ratio: np.ndarray, bands: Sequence[tuple[int, float, float]] = BANDS) -> np.ndarray:
    low_at, low, high = (np.array(x) for x in zip(*bands, strict=True))
    band = np.searchsorted(low_at, size, "right") - 1
    return (ratio >= low[band]) & (ratio <= high[band])


def measures(data: np.ndarray, offsets: np.ndarray, bands=BANDS) -> dict[str, np.ndarray]:
    """All measures of the texts of one block."""
    import zstandard

    n = len(offsets) - 1
    starts, ends, first = ta.words(data, offsets)
    row = ta.rows_of(first)
    hashes = ta.PrefixHash(data)
    words = ta.mix(hashes.pieces(starts, ends))
    n_words = np.diff(first)
    lead = ((data & 0xC0) != 0x80) & ~ta.SPACE[data]

    windows = ta.window_hashes(words, WINDOW)
    whole = row[: len(windows)] == row[WINDOW - 1 :] if len(windows) else np.zeros(0, bool)
    where = np.flatnonzero(whole)
    twice = where[_groups(row[where], windows[where])[0]]
    step = np.zeros(len(words) + 1, np.int32)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + WINDOW, -1)
    covered = np.cumsum(step)[: len(words)] > 0

    line_start, line_end = ta.spans(data != 0x0A, offsets)
    has_word = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    _, again = _groups(line_row, hashes.pieces(line_start, line_end))

    size = np.diff(offsets)
    ratio, bad = np.ones(n), np.zeros(n)
    pack = zstandard.ZstdCompressor(level=LEVEL)
    raw = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size):
        a, b = int(offsets[i]), int(offsets[i + 1])
        ratio[i] = (b - a) / len(pack.compress(raw[a:b]))
        if b - a > CHUNK_BYTES:
            at = np.arange(a, b, CHUNK_BYTES)
            length = np.minimum(at + CHUNK_BYTES, b) - at
            each = np.array([n / len(pack.compress(raw[k : k + n])) for k, n in zip(at.tolist(), length.tolist(), strict=True)])
            bad[i] = length[~within(length, each, bands)].sum() / (b - a)
    n_repeat = _per_text(covered, first)
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words,
        "word_chars": _per_text(lead, offsets),
        "n_symbols": _per_text(_SYMBOL[data], offsets),
        "n_dup_lines": np.bincount(line_row[again], minlength=n),
        "n_repeat_words": n_repeat,
        "ratio": ratio,
        "bad_chunk_share": bad,
        "base_failed": failed,
        "kept": ~failed & within(size, ratio, bands) & (bad <= BAD_CHUNK_SHARE),
    }


def judge(df: DataFrame, bands=BANDS) -> DataFrame:
    """doc_id, the measures and the verdict of every row of ``df`` (doc_id, text); other columns are not read.

    A null or empty text has no words: it fails. Null doc_ids and repeated rows stay. Texts are taken whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in ta.blocks(batches):
            found = measures(data, offsets, bands)
            yield pa.record_batch([part.column("doc_id"), *(pa.array(found[name]) for name, _ in MEASURES)], names=["doc_id", *(name for name, _ in MEASURES)])

    source = df.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, ", ".join(f"{name} {kind}" for name, kind in (("doc_id", "long"), *MEASURES)))


def keep(df: DataFrame, bands=BANDS) -> DataFrame:
    """The rows of ``df`` whose text is kept, with all their columns; one pass, no shuffle."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in ta.blocks(batches):
            yield part.filter(pc.equal(pa.array(measures(data, offsets, bands)["kept"]), True))

    return df.mapInArrow(run, df.schema)
