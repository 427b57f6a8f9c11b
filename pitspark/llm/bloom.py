"""A Bloom filter of fixed size, to leave out rows before a shuffle that a join would drop after it.

Its size does not depend on the data: when it fills up it lets more rows pass and the join does the work, with the
same result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 18  # of 64 bits: 2 MiB, sent to the driver and to every executor
_U = np.uint64


def build(df: DataFrame, column: str) -> bytes:
    """The filter over the long values of a column, OR-ed word by word on the executors."""
    key = F.xxhash64(column)
    marks = F.array(*(F.struct(F.pmod(F.shiftright(key, s), F.lit(WORDS)).alias("word"), F.pmod(F.shiftright(key, s + 20), F.lit(64)).cast("int").alias("bit")) for s in (0, 32)))
    bits = df.select(F.explode(marks).alias("m")).groupBy("m.word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("m.bit"))).alias("bits"))
    table = bits.toArrow()
    out = np.zeros(WORDS, _U)
    out[np.asarray(table["word"])] = np.asarray(table["bits"]).view(_U)
    return out.tobytes()


def xxhash64(values: np.ndarray, seed: np.ndarray | int = 42) -> np.ndarray:
    """Spark's ``xxhash64`` of one long; ``seed`` is the hash of the columns before it."""
    # The primes of XXH64.
    p1, p2, p3, p4, p5 = (_U(p) for p in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))

    def turn(x: np.ndarray, r: int) -> np.ndarray:
        return x << _U(r) | x >> _U(64 - r)

    x = np.asarray(values, np.int64).view(_U)
    h = np.asarray(seed, np.int64).view(_U) + np.zeros(len(x), _U) + p5 + _U(8)
    h ^= turn(x * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ h >> _U(33)) * p2
    h = (h ^ h >> _U(29)) * p3
    return (h ^ h >> _U(32)).view(np.int64)


def may_have(bits: bytes, values: np.ndarray) -> np.ndarray:
    """False only for values that are surely not in the filter."""
    words = np.frombuffer(bits, _U)
    key = xxhash64(values)
    out = np.ones(len(values), bool)
    for shift in (0, 32):
        word, bit = (key >> shift) % WORDS, (key >> (shift + 20)) % 64
        out &= (words[word] >> bit.astype(_U) & _U(1)) == 1
    return out
