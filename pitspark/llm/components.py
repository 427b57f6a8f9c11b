"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

MOST_ROUNDS = 60  # rounds grow with the logarithm of the longest path


def _forests(edges: DataFrame) -> DataFrame:
    """The edges of each batch as a star of every group they join: fewer edges, the same components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            root: dict[int, int] = {}

            def find(x: int) -> int:
                while (up := root.setdefault(x, x)) != x:
                    root[x] = x = root[up]
                return x

            for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                a, b = find(a), find(b)
                root[max(a, b)] = min(a, b)
            nodes = [x for x in root if root[x] != x]
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["u", "v"])

    return edges.mapInArrow(run, "u long, v long")


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, label): the smallest node of its component, for every node that has an edge to another node.

    Edges are long pairs. Each round points every node to the smallest neighbour known, by grouped minima and joins on
    the node; the edge table never grows. It is written to the shared folder after each round, so lost executors cost
    a round at most. Nothing is gathered by component. Self-edges and repeats are allowed, edges with a null are none.
    """
    now = edges.select(F.col(left).cast("long").alias("u"), F.col(right).cast("long").alias("v")).where("u <> v")
    now = stored(_forests(now).distinct(), "edges")  # u > v from here on
    seen = None
    for _ in range(MOST_ROUNDS):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u go to the smallest node around u
        large = both.where("v > u").join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: what u points to, and u itself, go to the smallest of them
        small = large.join(least.hint("merge"), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = stored(small.where("u <> v").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots.select("node", F.col("node").alias("label")))
