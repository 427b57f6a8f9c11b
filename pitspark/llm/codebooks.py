"""Operator 13: product quantisation whose Lloyd rounds assign whole subtrees of partition-local cover trees.

Vectors become integers, so every distance, sum and tie is exact. Each task cuts its rows into blocks and builds one
cover tree per block and part position: a node covers a contiguous range of the block's points, its first point is its
centre, and the children's centres lie further apart than the radius they cover. Cumulative sums over the points give
the sum of any node. The trees are written once; a round reads them, gives a node to one entry when the triangle
inequality proves that entry nearest for all its points, and compares points one by one only in small undecided nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .storage import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK_ROWS = 2048  # points of one tree
SHRINK = 1.3  # a child covers this much less than its parent
BUCKET = 8  # nodes of so few points have no children
LARGEST = 1 << 27  # components beyond it could overflow 64-bit distances
DOUBLE_EXACT = 1 << 20  # below it, distances of up to 2,048 components are exact in doubles too

Node = np.dtype([("low", "<i4"), ("high", "<i4"), ("child", "<i4"), ("children", "<i4"), ("radius", "<f8")])


class Tree(NamedTuple):
    """Distinct points in tree order, how often each occurs, the place of every row in them, and the nodes."""

    points: np.ndarray
    counts: np.ndarray
    row: np.ndarray
    nodes: np.ndarray


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, points by entries."""
    largest = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if largest < DOUBLE_EXACT and points.shape[1] <= 2048:
        a, b = points.astype(float), entries.astype(float)
        return (a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)
    return np.stack([((points - entry) ** 2).sum(1) for entry in entries], 1)


def build(block: np.ndarray) -> Tree:
    """The cover tree of the rows of ``block``; equal rows are one point."""
    points, row, counts = np.unique(block, axis=0, return_inverse=True, return_counts=True)
    order, nodes = np.arange(len(points)), []
    waiting = [(0, len(points))] if len(points) else []
    while waiting:  # breadth first, so that the children of a node are neighbours
        level, waiting = waiting, []
        first_child = len(nodes) + len(level)
        for low, high in level:
            inside = order[low:high]
            away = np.sqrt(squares(points[inside], points[inside[:1]])[:, 0])
            radius, children = away.max(), []
            if high - low > BUCKET:
                bound, pieces = radius / SHRINK, []
                while len(inside):
                    covered = away <= bound
                    pieces.append(inside[covered])
                    inside = inside[~covered]
                    if len(inside):
                        away = np.sqrt(squares(points[inside], points[inside[:1]])[:, 0])
                order[low:high] = np.concatenate(pieces)
                ends = low + np.cumsum([len(p) for p in pieces])
                children = list(zip(ends - [len(p) for p in pieces], ends, strict=True))
            nodes.append((low, high, first_child + len(waiting), len(children), radius))
            waiting += children
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return Tree(points[order], counts[order], place[row.ravel()], np.array(nodes, Node))


def assign(tree: Tree, entries: np.ndarray) -> np.ndarray:
    """The nearest entry of every point, ties to the lower index."""
    nearest = np.zeros(len(tree.points), np.int64)
    level = tree.nodes[:1]
    while len(level):
        away = squares(tree.points[level["low"]], entries)
        best = away.argmin(1)
        least = np.sqrt(np.take_along_axis(away, best[:, None], 1)[:, 0])
        if len(entries) > 1:
            second = np.sqrt(np.partition(away, 1, axis=1)[:, 1])
            sure = second - least > 2 * level["radius"] * (1 + 1e-9) + 1e-9 * second
        else:
            sure = np.ones(len(level), bool)
        sure |= level["high"] - level["low"] == 1  # the centre itself was compared
        whole = level[sure]
        nearest[ta.ranges(whole["low"].astype(np.int64), (whole["high"] - whole["low"]).astype(np.int64))] = np.repeat(best[sure], whole["high"] - whole["low"])
        level = level[~sure]
        small = level[level["children"] == 0]
        at = ta.ranges(small["low"].astype(np.int64), (small["high"] - small["low"]).astype(np.int64))
        nearest[at] = squares(tree.points[at], entries).argmin(1) if len(at) else 0
        inner = level[level["children"] > 0]
        level = tree.nodes[ta.ranges(inner["child"].astype(np.int64), inner["children"].astype(np.int64))]
    return nearest


def sums(tree: Tree, nearest: np.ndarray, entries: int) -> np.ndarray:
    """Per entry: the sum of its points and their number (last), from cumulative sums over runs of one entry."""
    total = np.zeros((len(tree.points) + 1, tree.points.shape[1] + 1), np.int64)
    np.cumsum(np.column_stack([tree.points, np.ones(len(tree.points), np.int64)]) * tree.counts[:, None], axis=0, out=total[1:])
    edge = np.flatnonzero(np.diff(nearest, prepend=-1, append=-1))
    out = np.zeros((entries, total.shape[1]), np.int64)
    np.add.at(out, nearest[edge[:-1]], total[edge[1:]] - total[edge[:-1]])
    return out


def _integers(df: DataFrame) -> DataFrame:
    """vec_id, label, vector: kept rows with their components as integers."""
    value = F.col("embedding")
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    limit = F.lit(LARGEST / SCALE)
    scaled = lambda x: F.when(F.abs(x.cast("double")) < limit, F.floor(SCALE * x.cast("double"))).otherwise(
        F.raise_error(F.lit(f"a component beyond {LARGEST // SCALE}")).cast("long")
    )
    # One expression: a filter of its own could be moved behind the conversion, which raises.
    vector = F.when(value.isNotNull() & finite, F.transform(value, scaled))
    whole = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), vector.alias("vector"))
    return whole.where("vector IS NOT NULL")


def trees(kept: DataFrame, size: int, parts: int) -> DataFrame:
    """One row per block of ``kept``: ids and labels, and the trees of all part positions as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(at, BLOCK_ROWS)
                block = piece.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                made = [build(part) for part in np.split(block, parts, axis=1)]
                packed = [[array.astype(kind, copy=False).tobytes() for array, kind in zip(tree, ("<i4", "<i4", "<i4", Node), strict=True)] for tree in made]
                yield pa.record_batch(
                    [
                        pa.array([piece.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                        pa.array([piece.column("label").to_pylist()], pa.list_(pa.string())),
                        pa.array([packed], pa.list_(pa.list_(pa.binary()))),
                    ],
                    names=["vec_ids", "labels", "trees"],
                )

    return kept.mapInArrow(run, "vec_ids array<long>, labels array<string>, trees array<array<binary>>")


def _unpacked(packed: list, width: int) -> list[Tree]:
    kinds = ("<i4", "<i4", "<i4", Node)
    made = [[np.frombuffer(raw, kind) for raw, kind in zip(tree, kinds, strict=True)] for tree in packed]
    return [Tree(points.astype(np.int64).reshape(-1, width), counts.astype(np.int64), row, nodes) for points, counts, row, nodes in made]


def lloyd_sums(planted: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """part, entry, total: sums of the points of every used entry, their number last; a task sends each entry once."""
    parts, entries, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for packed in batch.column("trees"):
                for part, tree in enumerate(_unpacked(packed.as_py(), width)):
                    found[part] += sums(tree, assign(tree, codebooks[part]), entries)
        part, entry = np.nonzero(found[:, :, -1])
        yield pa.record_batch([pa.array(part), pa.array(entry), pa.array(list(found[part, entry]), pa.list_(pa.int64()))], names=["part", "entry", "total"])

    partial = planted.select("trees").mapInArrow(run, "part long, entry long, total array<long>")
    return partial.groupBy("part", "entry").agg(F.array(*(F.sum(F.col("total")[i]) for i in range(width + 1))).alias("total"))


def codes(planted: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, code (binary, one byte per part), error of every row against final codebooks."""
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                made = _unpacked(batch.column("trees")[row].as_py(), width)
                nearest = [assign(tree, codebooks[part]) for part, tree in enumerate(made)]
                apart = [((tree.points - codebooks[part][to]) ** 2).sum(1) for part, (tree, to) in enumerate(zip(made, nearest, strict=True))]
                code = np.stack([to[tree.row] for tree, to in zip(made, nearest, strict=True)], 1).astype(np.uint8)
                error = sum(d[tree.row] for tree, d in zip(made, apart, strict=True))
                yield pa.record_batch(
                    [
                        batch.column("vec_ids")[row].values,
                        batch.column("labels")[row].values,
                        pa.array([c.tobytes() for c in code], pa.binary()),
                        pa.array(error.astype(np.int64)),
                    ],
                    names=["vec_id", "label", "code", "error"],
                )

    return planted.mapInArrow(run, "vec_id long, label string, code binary, error long")


def digest(codebooks: np.ndarray) -> str:
    """SHA-256 of all components in order of part, entry and place."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def train(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame | None]:
    """(codebooks by part, entry and component; the written trees, None when no row is kept)."""
    if not 1 <= entries <= 256:
        raise ValueError("a code byte holds 256 entries at most")
    kept = _integers(df).where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    head = kept.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(entries).select("vector").collect()
    if not head:
        return np.zeros((parts, 0, 0), np.int64), None
    size = len(head[0].vector)
    start = np.array([r.vector for r in head if len(r.vector) == size], np.int64)
    codebooks = start.reshape(len(start), parts, size // parts).transpose(1, 0, 2).copy()
    planted = stored(trees(kept.where(F.size("vector") == size), size, parts), "covers")
    for _ in range(rounds):
        for r in lloyd_sums(planted, codebooks).collect():  # parts x entries rows at most
            codebooks[r.part, r.entry] = [value // r.total[-1] for value in r.total[:-1]]
    return codebooks, planted


def coded(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every kept row of ``df`` (vec_id, embedding, label).

    Rows whose vector is null, empty or holds null or non-finite components are left out; so are vectors that cannot be
    cut into ``parts`` or are not as long as that of the smallest vec_id. Repeated rows and null vec_ids stay (null ids
    come last in the starting order, ties go by the vector). Fewer rows than ``entries`` give as many entries. No kept
    row gives no rows; components beyond ``LARGEST / SCALE`` raise. Other columns of ``df`` are not read. The
    driver holds the codebooks alone.
    """
    codebooks, planted = train(df, parts, entries, rounds)
    if planted is None:
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    final = stored(codes(planted, codebooks), "codes")
    totals = final.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    return final.join(totals, F.col("label").eqNullSafe(F.col("of_label")), "left").select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256")
    )


def _coded_sql(rounds: int = ROUNDS) -> str:
    """The contract in SQL: brute-force distances, one pair of views a round (unused entries stay)."""
    distance = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        """kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS whole FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "pieces AS (SELECT vec_id, label, part, whole[part * (len(whole) // 4) + 1 : (part + 1) * (len(whole) // 4)] AS v FROM kept, range(4) r(part))",
        "heads AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT 256)",
        "book0 AS (SELECT part, entry, v FROM pieces JOIN heads USING (vec_id))",
    ]
    near = lambda i: f"near{i} AS MATERIALIZED (SELECT p.vec_id, any_value(p.label) AS label, p.part, any_value(p.v) AS v, min(({distance}) * 256 + c.entry) AS least FROM pieces p JOIN book{i} c USING (part) GROUP BY p.vec_id, p.part)"
    for i in range(rounds):
        parts.append(near(i))
        parts.append(
            f"""book{i + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(n.v, b.v) AS v FROM book{i} b LEFT JOIN (
    SELECT part, entry, list(middle ORDER BY place) AS v FROM (
      SELECT part, entry, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS middle
      FROM (SELECT part, least % 256 AS entry, unnest(v) AS x, generate_subscripts(v, 1) AS place FROM near{i}) GROUP BY ALL)
    GROUP BY ALL) n USING (part, entry))"""
        )
    parts.append(near(rounds))
    parts.append(
        "coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', (least % 256)::INTEGER), '' ORDER BY part) AS code, "
        "sum(least // 256)::BIGINT AS error FROM near4 GROUP BY vec_id)".replace("near4", f"near{rounds}")
    )
    book = f"SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM book{rounds}"
    return "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, ({book}) AS codebooks_sha256 FROM coded"


CODED_SQL = _coded_sql()
