"""Operator 9: removal of long byte strings that occur twice or more, by a hash-compared suffix sort.

Of every LENGTH bytes one place is an anchor, chosen by content alone (the smallest hash of SEED bytes within reach), so
equal strings have equal anchors. A string can only be repeated if the seed at its anchor is. For a repeated seed, what
lies left and right of it decides: occurrences with equal surroundings are counted and need no comparison; different
surroundings are sorted, as suffixes to the right and as reversed prefixes to the left, by a mergesort whose comparison
finds the common extension of two suffixes by binary search over prefix polynomial hashes. The common extensions of
neighbours, checked byte by byte, say which strings around the anchor occur again.

Only anchors are shuffled (one in about 85 bytes), and the surroundings of seeds that have several.

Lengths can be counted in words instead (``Size``): a text is then the string of its words' hashes, WORD bytes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from . import textarrays as ta
from .storage import small_batches, stored

LENGTH = 400
WORD = 8  # bytes that stand for a word when lengths are counted in words
TOGETHER = 4096  # surroundings sorted at once
LARGEST = 32768  # surroundings of one seed sorted in one task; the strings of larger ones are counted one by one
_U = np.uint64
_TOP = _U(2**64 - 1)


class Size(NamedTuple):
    """Length of the strings in units (bytes, or words of WORD bytes each), and what follows from it."""

    count: int
    unit: int = 1

    @property
    def reach(self) -> int:
        """Anchors are the least of this many units in a row."""
        return self.count // 2

    @property
    def length(self) -> int:
        return self.count * self.unit

    @property
    def side(self) -> int:
        """Bytes of a string that may lie on either side of its seed."""
        return (self.reach - 1) * self.unit

    @property
    def seed(self) -> int:
        return self.length - self.side


BYTES = Size(LENGTH)
SEED, SIDE = BYTES.seed, BYTES.side


class _WordHash(ta.PrefixHash):
    """The same over the hashes of words in place of bytes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.sums = np.zeros(n + 1, _U)
        np.cumsum(words * ta.powers(ta.BASE, n)[:n], out=self.sums[1:])
        self.inverse = ta.powers(ta.INVERSE, n)


def _units(data: np.ndarray, offsets: np.ndarray, hashes: ta.PrefixHash, size: Size) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a block or the hashes of its words, and where each text begins in them."""
    if size.unit == 1:
        return data, offsets
    starts, ends, first = ta.words(data, offsets)
    return ta.mix(hashes.pieces(starts, ends)), first


def _slide(values: np.ndarray, width: int, op: np.ufunc, fill: np.uint64) -> np.ndarray:
    """op over every ``width`` values in a row, from running values within blocks in both directions."""
    n = len(values) - width + 1
    blocks = np.append(values, np.full(-len(values) % width, fill, _U)).reshape(-1, width)
    forth = op.accumulate(blocks, axis=1).ravel()
    back = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[:n], forth[width - 1 : width - 1 + n])


def _text_hash(hashes: ta.PrefixHash, offsets: np.ndarray) -> np.ndarray:
    return ta.mix(hashes.pieces(offsets[:-1], offsets[1:]) + ta.mix(np.diff(offsets))).view(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, hashes: ta.PrefixHash, size: Size = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place in the block (in units) and seed hash of all anchors of a block of texts."""
    n, length, reach = len(data), size.count, size.reach
    width = size.seed // size.unit
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    end = np.repeat(offsets[1:], np.diff(offsets))
    place = np.arange(n - width + 1)
    seed = ta.mix(hashes.ranges(place, place + width))
    outside = place + width > end[: len(place)]
    seed[outside] = _TOP
    least = _slide(seed, reach, np.minimum, _TOP)
    least[np.arange(len(least)) + length > end[: len(least)]] = 0  # a string may not cross texts
    margin = np.zeros(reach - 1, _U)
    chosen = np.flatnonzero((_slide(np.concatenate([margin, least, margin]), reach, np.maximum, _U(0)) == seed) & ~outside)
    return np.searchsorted(offsets, chosen, "right") - 1, chosen, seed[chosen]


def _texts(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _anchor_rows(df: DataFrame, size: Size) -> DataFrame:
    """ref (hash of the text), doc_id, n_bytes, sha256 and the anchors: place, seed and hash of the surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in ta.blocks(batches):
            hashes = ta.PrefixHash(data)
            ref = _text_hash(hashes, offsets)
            units, first = _units(data, offsets, hashes, size)
            if size.unit > 1:
                hashes = _WordHash(units)
            row, at, seed = anchors(units, first, hashes, size)
            start, end = np.maximum(at - (size.reach - 1), first[row]), np.minimum(at + size.count, first[row + 1])
            around = ta.mix(hashes.ranges(start, end) + ta.mix((at - start) * (size.count + 1) + end - at))
            cuts = pa.array(np.searchsorted(row, np.arange(len(offsets))).astype(np.int32))
            raw, ends = memoryview(np.ascontiguousarray(data)), offsets.tolist()
            digests = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            lists = [pa.ListArray.from_arrays(cuts, pa.array(v)) for v in ((at - first[row]) * size.unit, seed.view(np.int64), around.view(np.int64))]
            yield pa.record_batch(
                [pa.array(ref), part.column("doc_id"), pa.array(np.diff(first) * size.unit), pa.array(digests), *lists],
                names=["ref", "doc_id", "n_bytes", "sha256", "places", "seeds", "arounds"],
            )

    return _texts(df).mapInArrow(run, "ref long, doc_id long, n_bytes long, sha256 string, places array<long>, seeds array<long>, arounds array<long>")


def _possible_texts(df: DataFrame, bits: bytes, size: Size) -> DataFrame:
    """ref and bytes (of words: their hashes) of the texts that the filter lets pass, one row per row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in ta.blocks(batches):
            hashes = ta.PrefixHash(data)
            ref = _text_hash(hashes, offsets)
            number = np.asarray(part.column("doc_id").fill_null(0))
            kept = pa.array(bloom.may_have(bits, bloom.xxhash64(number, bloom.xxhash64(ref))))
            yield pa.record_batch([pa.array(ref), ta.binary(*_units(data, offsets, hashes, size))], names=["ref", "data"]).filter(kept)

    return _texts(df).mapInArrow(run, "ref long, data binary")


def _filtered(rows: DataFrame, column: str, bits: bytes) -> DataFrame:
    """Rows whose value may be in the filter; exact joins follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.may_have(bits, np.asarray(batch.column(column)))))

    return rows.mapInArrow(run, rows.schema)


# -- suffix sort ---------------------------------------------------------------------------------------------------


class Strings:
    """Rows of at most ``side`` bytes with the hashes of all their prefixes."""

    def __init__(self, values: list[bytes], side: int = SIDE):
        self.side = side
        self.size = np.array([len(v) for v in values], np.int64)
        flat = np.frombuffer(b"".join(v.ljust(side + 1, b"\0") for v in values), np.uint8)
        self.bytes = flat.reshape(len(values), side + 1)
        terms = ta._BYTE_VALUES[0][self.bytes[:, :side]] * ta.powers(ta.BASE, side)[:side]
        self.prefix = np.zeros((len(values), side + 1), _U)
        np.cumsum(terms, axis=1, out=self.prefix[:, 1:])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of rows a and b: binary search for the longest prefix of equal hash."""
        low, high = np.zeros(len(a), np.int64), np.minimum(self.size[a], self.size[b])
        for _ in range(self.side.bit_length()):
            middle = (low + high + 1) >> 1
            same = self.prefix[a, middle] == self.prefix[b, middle]
            low, high = np.where(same, middle, low), np.where(same, high, np.maximum(middle - 1, low))
        return low

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether row a sorts before row b: the byte after the common extension decides, or the shorter row."""
        n = self.common(a, b)
        a_ends, b_ends = n >= self.size[a], n >= self.size[b]
        return np.where(a_ends | b_ends, a_ends & ~b_ends, self.bytes[a, n] < self.bytes[b, n])

    def checked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common extension of rows a and b byte by byte: what equal hashes claim is not taken on trust."""
        out = np.empty(len(a), np.int64)
        for at in range(0, len(a), 1 << 14):
            x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
            differ = self.bytes[x] != self.bytes[y]
            differ[:, self.side] = True
            out[at : at + len(x)] = np.minimum(differ.argmax(axis=1), np.minimum(self.size[x], self.size[y]))
        return out


def merge_sort(strings: Strings, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Order of the rows within groups [start, start + size), by mergesort of all groups at once.

    Runs of 1, 2, 4, ... are merged: a row's place is its place in its own run plus its rank in the other one, found by
    binary search with hash-compared comparisons.
    """
    order = np.arange(int(size.sum()))
    first, total = np.repeat(start, size), np.repeat(size, size)
    width = 1
    while width < size.max(initial=0):
        todo = np.flatnonzero(total > width)
        base, local = first[todo], todo - first[todo]
        run = local // width
        low = np.minimum((run ^ 1) * width, total[todo])
        high = np.minimum(low + width, total[todo])
        begin, mine, left = low.copy(), order[todo], run % 2 == 0
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            middle = (low[open_] + high[open_]) >> 1
            other = order[base[open_] + middle]
            own, is_left = mine[open_], left[open_]
            # equal rows: those of the left run come first
            x, y = np.where(is_left, other, own), np.where(is_left, own, other)
            before = strings.less(x, y) ^ ~is_left  # left: other < own; right: not own < other
            low[open_] = np.where(before, middle + 1, low[open_])
            high[open_] = np.where(before, high[open_], middle)
        place = base + (run // 2) * 2 * width + local % width + low - begin
        merged = order.copy()
        merged[place] = mine
        order = merged
        width *= 2
    return order


def repeated_spans(left: list[bytes], right: list[bytes], group: np.ndarray, size: Size = BYTES) -> list[tuple[int, int, int]]:
    """(row, start, end) relative to the anchor: parts covered by strings that another row of the group has too.

    ``left`` are the reversed bytes before the seed, ``right`` those after it; rows of a group are together. Strings are
    those of ``length`` bytes around the anchor that begin j bytes before it, j = 0..side.
    """
    n, length, widest = len(group), size.length, size.side
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(start, n))
    sides = (Strings(left, widest), Strings(right, widest))
    best, before, after, sorted_rows = [], [], [], []
    for strings in sides:
        order = merge_sort(strings, start, sizes)
        inner = np.ones(max(n - 1, 0), bool)
        inner[start[1:] - 1] = False
        a, b = order[:-1][inner], order[1:][inner]
        common = strings.checked(a, b)
        most, up, down = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        np.maximum.at(most, a, common)
        np.maximum.at(most, b, common)
        up[b], down[a] = a, b
        shared = np.full(n, -1)  # with the row before in order; none at the start of a group
        shared[1:][inner] = common
        best.append(most)
        before.append(up)
        after.append(down)
        sorted_rows.append((order, shared))
    most_left, most_right = best
    # string j needs j equal bytes on the left and side - j on the right
    low, high = np.maximum(widest - most_right, 0), np.minimum(most_left, widest)
    hope = (most_left >= 0) & (low <= high)
    done = np.zeros(n, bool)
    rows = np.arange(n)
    for side in (0, 1):
        for partner in (before[side], after[side]):
            ask = np.flatnonzero(hope & ~done & (partner >= 0))
            both = [sides[k].checked(rows[ask], partner[ask]) for k in (0, 1)]
            done[ask] = (both[0] >= most_left[ask]) & (both[1] >= most_right[ask])
    found = [(int(i), -int(high[i]), length - int(low[i])) for i in np.flatnonzero(done)]
    rest = np.flatnonzero(hope & ~done)
    if len(rest):
        found += _each_string(sorted_rows, group, rest, low, high, length, widest)
    return found


def _each_string(sorted_rows: list, group: np.ndarray, rest: np.ndarray, low: np.ndarray, high: np.ndarray, length: int, side: int) -> list[tuple[int, int, int]]:
    """Rows whose best neighbours differ to the left and right: their strings one by one, against all of the group.

    In either order, rows that share d bytes are a run without a common extension below d, so the two runs of a row, at j
    bytes to the left and side - j to the right, name string j exactly.
    """
    n = len(group)
    (by_left, shared_left), (by_right, shared_right) = sorted_rows
    wanted = np.isin(group, np.unique(group[rest]))
    left, right = np.empty(n, np.int64), np.empty(n, np.int64)
    again = np.zeros((n, side + 2), bool)
    for j in range(int(low[rest].min()), int(high[rest].max()) + 1):
        rows = np.flatnonzero(wanted & (low <= j) & (j <= high))
        left[by_left], right[by_right] = np.cumsum(shared_left < j), np.cumsum(shared_right < side - j)
        name = left[rows] * (n + 1) + right[rows]
        order = np.argsort(name)
        same = name[order][1:] == name[order][:-1]
        again[rows[order[1:][same]], j] = True
        again[rows[order[:-1][same]], j] = True
    again = again[rest]
    edge = np.diff(again, axis=1, prepend=False)
    row, at = np.nonzero(edge)  # starts and ends of runs alternate within a row
    return [(int(rest[i]), -(int(end) - 1), length - int(begin)) for i, begin, end in zip(row[::2], at[::2], at[1::2], strict=True)]


# -- operator ------------------------------------------------------------------------------------------------------


def _surroundings(texts: DataFrame, wanted: DataFrame, size: Size) -> DataFrame:
    """seed, proof (second hash of the seed), around, left (reversed), right of every wanted place."""
    side, seed = size.side, size.seed
    lists = wanted.groupBy("ref").agg(F.collect_list(F.struct("place", "seed", "around")).alias("want"))
    rows = texts.join(lists.hint("merge"), "ref").select("data", F.col("want.place").alias("place"), F.col("want.seed").alias("seed"), F.col("want.around").alias("around"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column("data")[i].as_buffer()
                data = np.frombuffer(raw, np.uint8)
                place = batch.column("place")[i].values.to_numpy()
                proof = ta.PrefixHash(data, 1).ranges(place, place + seed).view(np.int64)
                view = raw.to_pybytes()
                left = [view[max(0, p - side) : p][::-1] for p in place.tolist()]
                right = [view[p + seed : p + seed + side] for p in place.tolist()]
                yield pa.record_batch(
                    [batch.column("seed")[i].values, pa.array(proof), batch.column("around")[i].values, pa.array(left, pa.binary()), pa.array(right, pa.binary())],
                    names=["seed", "proof", "around", "left", "right"],
                )

    return rows.mapInArrow(run, "seed long, proof long, around long, left binary, right binary")


_SPANS = "seed long, around long, spans array<struct<start:long,end:long>>"


def _sorted_spans(rows: DataFrame, size: Size) -> DataFrame:
    """seed, around, spans for surroundings that share strings with others of their seed."""
    dealt = rows.repartition("seed").sortWithinPartitions("seed", "proof", "around")

    def work(seeds: list, arounds: list, left: list, right: list, group: list) -> pa.RecordBatch:
        spans: dict[int, list] = {}
        for i, start, end in repeated_spans(left, right, np.array(group, np.int64), size):
            spans.setdefault(i, []).append({"start": start, "end": end})
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.record_batch([pa.array([seeds[i] for i in spans], pa.int64()), pa.array([arounds[i] for i in spans], pa.int64()), pa.array(list(spans.values()), kind)], names=["seed", "around", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, ...] = ([], [], [], [], [])
        last, number = None, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("seed", "proof", "around", "left", "right")]
            for seed, proof, around, left, right in zip(*columns, strict=True):
                if last == (seed, proof, around):
                    continue  # a text that has several rows was read for each
                if last is None or last[:2] != (seed, proof):
                    if len(held[0]) >= TOGETHER:
                        yield work(*held)
                        held = ([], [], [], [], [])
                    number += 1
                last = (seed, proof, around)
                for values, value in zip(held, (seed, around, left, right, number), strict=True):
                    values.append(value)
        if held[0]:
            yield work(*held)

    return dealt.mapInArrow(run, _SPANS)


def _counted_spans(rows: DataFrame, size: Size) -> DataFrame:
    """The same for seeds with too many surroundings for one task: every string is a row, counted by its hashes."""

    side = size.side

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                left, right = (Strings(part.column(c).to_pylist(), side) for c in ("left", "right"))
                j = np.arange(0, side + 1, size.unit)
                fits = (left.size[:, None] >= j) & (right.size[:, None] >= side - j)
                row, begin = np.nonzero(fits)
                begin = j[begin]
                hashes = [ta.mix(left.prefix[row, begin] + ta.mix(right.prefix[row, side - begin] + _U(salt))) for salt in (1, 2)]
                index = pa.array(row)
                columns = [part.column(c).take(index) for c in ("seed", "proof", "around")]
                yield pa.record_batch([*columns, pa.array(begin), *(pa.array(h.view(np.int64)) for h in hashes)], names=["seed", "proof", "around", "j", "h1", "h2"])

    strings = rows.mapInArrow(run, "seed long, proof long, around long, j long, h1 long, h2 long").distinct()
    keys = ["seed", "proof", "j", "h1", "h2"]
    again = strings.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    span = F.struct((-F.col("j")).alias("start"), (F.lit(size.length) - F.col("j")).cast("long").alias("end"))
    return strings.join(again.hint("merge"), keys, "left_semi").groupBy("seed", "around").agg(F.collect_list(span).alias("spans"))


def removals(df: DataFrame, size: Size = BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, spans, texts) over the rows (doc_id, text) of ``df``; other columns are not read.

    documents: ref (hash of the text), doc_id, n_bytes, sha256 of every row. spans: ref, spans (start, end in bytes; sorted,
    they may overlap), for every text with removed bytes. texts: ref and bytes of all texts with partly removed bytes, and some
    more. A byte goes if it lies in a string of ``size`` that also starts elsewhere, in any text; matches never
    cross texts. Null texts are empty; shorter texts lose nothing. Repeated rows are copies: a text of that
    length with a copy goes whole. Counted in words, n_bytes, spans and bytes are those of the words' hashes.
    """
    small_batches(df.sparkSession)
    rows = stored(_anchor_rows(df, size), "anchors")
    documents = rows.select("ref", "doc_id", "n_bytes", "sha256")
    copies = documents.groupBy("ref").agg(F.count("*").alias("copies"), F.min(F.coalesce("doc_id", F.lit(0))).alias("first_id"), F.max("n_bytes").alias("n_bytes"))
    unfolded = rows.select("ref", "n_bytes", F.inline(F.arrays_zip("places", "seeds", "arounds"))).toDF("ref", "n_bytes", "place", "seed", "around")

    # seeds that occur again, and whether with different surroundings
    seeds = unfolded.groupBy("seed").agg(F.min("around").alias("low"), F.max("around").alias("high"), F.count("*").alias("n"))
    again = stored(seeds.where("n > 1").select("seed", (F.col("low") != F.col("high")).alias("differs")), "seeds")
    possible = _filtered(unfolded, "seed", bloom.build(again, "seed")).distinct()  # copies of a text fall together
    places = stored(possible.join(again.hint("merge"), "seed"), "places")
    whole = F.struct((F.col("place") - F.least("place", F.lit(size.side))).alias("start"), F.least(F.col("place") + size.length, "n_bytes").alias("end"))
    equal = places.where("NOT differs").select("ref", whole.alias("span"))

    # one place for each kind of surroundings; those that occur again are removed without a comparison
    differing = places.where("differs")
    kinds = differing.groupBy("seed", "around").agg(F.count("*").alias("n"), F.min("ref").alias("ref"), F.min_by("place", "ref").alias("place"))
    kinds = stored(kinds, "kinds")
    firsts = places.select("ref").distinct().join(copies.hint("merge"), "ref").select(F.xxhash64("ref", "first_id").alias("key"))
    texts = stored(_possible_texts(df, bloom.build(firsts, "key"), size), "texts")
    around = _surroundings(texts, kinds.select("ref", "place", "seed", "around"), size)
    large = stored(kinds.groupBy("seed").agg(F.count("*").alias("m")).where(F.col("m") > LARGEST).select("seed"), "large-seeds")
    if large.isEmpty():
        compared = _sorted_spans(around, size)
    else:
        around = stored(around, "surroundings")
        compared = _sorted_spans(around.join(large, "seed", "left_anti"), size).unionByName(_counted_spans(around.join(large, "seed", "left_semi"), size))
    known = kinds.where("n > 1").select("seed", "around", F.lit(None).cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    single = compared.join(kinds.where("n = 1").select("seed", "around").hint("merge"), ["seed", "around"], "left_semi")
    decided = stored(known.unionByName(single), "decided")
    met = differing.join(decided.hint("merge"), ["seed", "around"])
    shifted = F.transform("spans", lambda s: F.struct((F.col("place") + s["start"]).alias("start"), (F.col("place") + s["end"]).alias("end")))
    different = met.select("ref", F.explode(F.coalesce(shifted, F.array(whole))).alias("span"))

    twice = copies.where(F.col("copies") > 1).where(F.col("n_bytes") >= size.length).select("ref", F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")).alias("span"))
    every = equal.unionByName(different).unionByName(twice).distinct()
    gathered = every.groupBy("ref").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    return documents, stored(gathered, "spans"), texts


def joined(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted spans with overlapping and touching ones as one."""
    reach = np.maximum.accumulate(ends)
    fresh = np.append(True, starts[1:] > reach[:-1])
    return starts[fresh], reach[np.append(np.flatnonzero(fresh)[1:] - 1, len(ends) - 1)]


def _bounds(spans: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    fields = spans.values
    return fields.field("start").to_numpy(), fields.field("end").to_numpy()


def _word_bounds(data: bytes, spans: pa.ListScalar) -> tuple[np.ndarray, np.ndarray]:
    """Spans over the hashes of words as spans of bytes: whole words, each with the white space behind it."""
    starts, _, _ = ta.words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    starts = np.append(starts, len(data))
    starts[0] = 0
    first, last = _bounds(spans)
    return starts[-(-first // WORD)], starts[last // WORD]


def _cut(data: bytes, spans: pa.ListScalar, word_spans: pa.ListScalar | None = None) -> tuple[bytes, int, int]:
    """What is left of a text, and the number of removed bytes and runs."""
    found = [_bounds(spans)] if spans.is_valid else []
    if word_spans is not None and word_spans.is_valid:
        found.append(_word_bounds(data, word_spans))
    starts, ends = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(found) > 1:
        order = np.argsort(starts, kind="stable")
        starts, ends = starts[order], ends[order]
    starts, ends = joined(starts, ends)
    keep = zip([0, *ends.tolist()], [*starts.tolist(), len(data)], strict=True)
    return b"".join(data[a:b] for a, b in keep), int((ends - starts).sum()), len(starts)


def removed_digests(df: DataFrame) -> DataFrame:
    """Contract of the query: bytes, removed bytes and runs, digest and length of what is left, of every document, and last
    the text that is left (a character cut in half goes whole from it, not from the digest).

    Texts that lose nothing are not shuffled, and pass one Python worker of a task and not two.
    """
    spans = removals(df)[1]
    bits = bloom.build(spans, "ref")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_left", "text"]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_left long, text string"

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in ta.blocks(batches):
            sure = ~bloom.may_have(bits, _text_hash(ta.PrefixHash(data), offsets))
            raw, size = memoryview(np.ascontiguousarray(data)), pa.array(np.diff(offsets)[sure])
            digests = [hashlib.sha256(raw[offsets[i] : offsets[i + 1]]).hexdigest() for i in np.flatnonzero(sure)]
            kept, none = part.filter(pa.array(sure)), pa.array(np.zeros(len(size), np.int64))
            yield pa.record_batch([kept.column("doc_id"), size, none, none, pa.array(digests, pa.string()), size, kept.column("text").fill_null("")], names=names)

    def unsure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in ta.blocks(batches):
            value = _text_hash(ta.PrefixHash(data), offsets)
            yield part.append_column("ref", pa.array(value)).filter(pa.array(bloom.may_have(bits, value)))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists, out = batch.column("text"), batch.column("spans"), []
            for i in range(batch.num_rows):
                data = (texts[i].as_py() or "").encode()
                left, removed, runs = _cut(data, lists[i]) if lists[i].is_valid else (data, 0, 0)
                out.append((len(data), removed, runs, hashlib.sha256(left).hexdigest(), len(left), left.decode("utf-8", "ignore")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
            columns = [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column("doc_id"), *columns], names=names)

    touched = _texts(df).mapInArrow(unsure, "doc_id long, text string, ref long").join(spans.hint("merge"), "ref", "left").select("doc_id", "text", "spans")
    return _texts(df).mapInArrow(whole, schema).unionByName(touched.mapInArrow(digest, schema))


def remove(df: DataFrame, words: int | None = None) -> DataFrame:
    """The rows of ``df`` with all columns and the repeated bytes cut out of ``text``.

    With ``words``, passages of so many words that occur twice go too, whatever their bytes and the white space between them.

    Rows that lose nothing are neither shuffled nor changed. A character cut in half goes whole. Rows that lose all stay,
    with an empty text.
    """
    spans = removals(df)[1].withColumnRenamed("spans", "bytes")
    if words is None:
        spans = spans.withColumn("words", F.lit(None).cast(spans.schema["bytes"].dataType))
    else:
        more = removals(df, Size(words, WORD))[1].withColumnRenamed("spans", "words")
        spans = stored(spans.join(more.hint("merge"), "ref", "full_outer"), "both-spans")
    bits, names = bloom.build(spans, "ref"), df.columns
    ref = next(name for k in range(len(names) + 1) if (name := f"_ref{k}") not in names)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in ta.blocks(batches):
            value = _text_hash(ta.PrefixHash(data), offsets)
            yield part.append_column(ref, pa.array(value, mask=~bloom.may_have(bits, value)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.column("_row").flatten(), strict=True))
            (lists, more), texts = batch.column("_spans").flatten(), columns["text"]
            columns["text"] = pa.array(
                [_cut(texts[i].as_py().encode(), lists[i], more[i])[0].decode("utf-8", "ignore") if lists[i].is_valid or more[i].is_valid else texts[i].as_py() for i in range(batch.num_rows)], pa.string()
            )
            yield pa.record_batch(list(columns.values()), names=names)

    schema = T.StructType([*df.schema.fields, T.StructField(ref, T.LongType())])
    marked = df.mapInArrow(mark, schema)
    unsure = marked.where(F.col(ref).isNotNull()).select(F.struct(*names).alias("_row"), F.col(ref).alias("_ref"))
    named = spans.select(F.col("ref").alias("_key"), F.struct("bytes", "words").alias("_spans"))
    touched = unsure.join(named.hint("merge"), F.col("_ref") == F.col("_key"), "left").select("_row", "_spans")
    return marked.where(F.col(ref).isNull()).select(*names).unionByName(touched.mapInArrow(cut, df.schema))
