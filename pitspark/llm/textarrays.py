"""Flat numpy views of Arrow text batches, for operators that run inside ``mapInArrow``.

Texts of a batch lie one after another in one byte array, so words, lines, windows and their hashes are
found for many documents at once. Memory is bounded by ``BLOCK_BYTES`` plus the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18  # text bytes worked on at once
BLOCK_ROWS = 4096
LONG = 256  # bytes up to which words, lines and texts are hashed by the polynomial

_U = np.uint64
# An odd base, its inverse modulo 2**64, and the multipliers of the splitmix64 finaliser.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_MIX1, _MIX2 = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)

SPACE = np.zeros(256, bool)  # the white space of the word pattern [^\x20\x09-\x0D]+
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)  # A-Z to a-z, all other bytes as they are
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(values: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser: spreads every input bit over the word."""
    x = values.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _MIX1
    x ^= x >> _U(27)
    x *= _MIX2
    x ^= x >> _U(31)
    return x


_BYTE_VALUES = [mix(np.arange(1, 257, dtype=_U)), mix(np.arange(1001, 1257, dtype=_U))]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64; grown on demand and kept."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, 1 << 16), base, _U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=_U)
    return have


class PrefixHash:
    """Polynomial hash of every byte range of ``data`` from one prefix sum (modulo 2**64).

    Ranges of 1,024 bytes and more can be built to collide (Thue-Morse strings, whatever the base): ``pieces`` hashes long
    words, lines and texts by BLAKE2 instead.
    """

    def __init__(self, data: np.ndarray, salt: int = 0):
        n = len(data)
        self.data, self.salt = data, salt.to_bytes(8, "little")
        terms = _BYTE_VALUES[salt][data]
        terms *= powers(BASE, n)[:n]
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(terms, out=self.sums[1:])
        self.inverse = powers(INVERSE, n)

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of bytes [start, end): equal bytes give equal hashes wherever they lie."""
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def pieces(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """As ``ranges``, for ranges that do not overlap: those of more than ``LONG`` bytes by a cryptographic hash."""
        out = self.ranges(start, end)
        for i in np.flatnonzero(end - start > LONG):
            raw = np.ascontiguousarray(self.data[start[i] : end[i]])
            out[i] = int.from_bytes(blake2b(raw, digest_size=8, salt=self.salt).digest(), "little")
        return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple]:
    """(batch slice, bytes, offsets) of bounded size; a text longer than the bound is a block of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = utf8(batch.column(column))
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1
            end = min(max(end, row + 1), row + BLOCK_ROWS, batch.num_rows)
            part = batch.slice(row, end - row)
            yield part, *utf8(part.column(column))
            row = end


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes; runs end where a text ends."""
    n = len(inside)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    starts = inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the number of the first word of every text (one more than texts)."""
    starts, ends = spans(~SPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The text number of every item, from the number of the first item of every text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_hashes(items: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` items in order (len(items) - size + 1 of them)."""
    n = len(items) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = items[:n].copy()
    for k in range(1, size):
        out *= _U(BASE)
        out += items[k : k + n]
    return mix(out)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after another."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column whose rows are the bytes of values[offsets[i]:offsets[i + 1]]."""
    size = values.dtype.itemsize
    at = (np.asarray(offsets) * size).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])
