"""Leaf-wise boosted trees for a binary target, for many groups (folds) at once.

A tree grows best first: of all leaves the one whose best split gains most is split next, until there are ``leaves`` of
them. The gain has the L2 term in its denominator. What a split gains depends on the rows of its node alone, so all
nodes the best-first order can reach next are searched in one job: every task sends one gradient histogram per (group,
node), histograms are added by key, running sums over bins give all splits, and one split per node reaches the driver. A
node of at most ``SMALL_NODE`` rows is not searched level by level: its rows meet in one task, which finds all splits
below it. A tree takes a job per level with larger nodes and one more. These many small jobs are RDD jobs over binned
blocks: planning each as a query takes longer than running it.

Gradients are integers (multiples of 2^-30), so sums, and with them the trees, are the same however rows are dealt out
and whichever tasks are run again.
"""

from __future__ import annotations

import heapq
import operator
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import value_ranks
from ..functions.reasons import ValidationError
from ..session import reliable_checkpoint

UNIT = 1 << 30  # gradients and hessians are multiples of 1/UNIT
GAIN_DIGITS = 9  # gains equal to so many digits are ties: lower node, feature and bin first
SMALL_NODE = 1 << 16  # rows up to which one task grows all that is below a node
WRITTEN_EVERY = 10  # trees after which the raw scores are written anew


@dataclass(frozen=True)
class Settings:
    trees: int = 250
    rate: float = 0.05
    leaves: int = 15
    min_rows: int = 30
    l2: float = 1.0
    bins: int = 255
    min_hessian: float = 1e-3

    def __post_init__(self):
        if min(self.trees, self.leaves, self.min_rows) < 1 or not 2 <= self.bins <= 255 or self.l2 < 0 or self.rate <= 0:
            raise ValueError("trees, leaves and rows must be positive, bins lie in 2..255, l2 be nonnegative, the rate positive")


class Split(NamedTuple):
    """Best split of one node (by its path: 1 is the root, 2n and 2n + 1 the children of n)."""

    node: int
    feature: int
    bin: int
    gain: float
    left_rows: int
    right_rows: int
    left_value: float
    right_value: float


class Tree(NamedTuple):
    """Nodes as arrays (feature -1: leaf), and the splits in the order they were made."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    path: np.ndarray
    splits: tuple[Split, ...]

    def place(self, bins: np.ndarray) -> np.ndarray:
        """Index of the leaf of every row."""
        at = np.zeros(len(bins), np.int64)
        rows = np.arange(len(bins))
        while len(rows):
            rows = rows[self.feature[at[rows]] >= 0]
            here = at[rows]
            at[rows] = np.where(bins[rows, self.feature[here]] <= self.bin[here], self.left[here], self.right[here])
        return at


@dataclass(frozen=True)
class GroupModel:
    """One group's medians, thresholds per feature, raw score before the first tree, and trees."""

    baseline: float
    medians: np.ndarray
    thresholds: tuple[np.ndarray, ...]
    trees: tuple[Tree, ...] = ()

    def binned(self, values: np.ndarray) -> np.ndarray:
        filled = np.where(np.isnan(values), self.medians, values)
        return np.stack([np.searchsorted(cuts, filled[:, f]) for f, cuts in enumerate(self.thresholds)], 1).astype(np.uint8)

    def probability(self, values: np.ndarray) -> np.ndarray:
        bins = self.binned(values)
        raw = self.baseline + sum((tree.value[tree.place(bins)] for tree in self.trees), np.zeros(len(bins)))
        return _sigmoid(raw)


@dataclass(frozen=True)
class Fitted:
    """Models by the value of the group column; a None column is one group of all rows."""

    features: tuple[str, ...]
    group: str | None
    models: dict


def _sigmoid(raw: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-raw))


def grown(splits: dict[int, Split], limit: int) -> list[Split]:
    """Splits of the best-first tree of ``limit`` leaves among known splits, in order."""
    order, waiting = [], [(-splits[1].gain, 1)] if 1 in splits else []
    while waiting and len(order) < limit - 1:
        chosen = splits[heapq.heappop(waiting)[1]]
        order.append(chosen)
        for child in (2 * chosen.node, 2 * chosen.node + 1):
            if child in splits:
                heapq.heappush(waiting, (-splits[child].gain, child))
    return order


def tree_of(splits: Sequence[Split]) -> Tree:
    """Node arrays from splits in order, parents first."""
    number, feature, bin_, left, right, value, path = {1: 0}, [-1], [0], [0], [0], [0.0], [1]
    for s in splits:
        at = number[s.node]
        feature[at], bin_[at] = s.feature, s.bin
        for child, worth, side in ((2 * s.node, s.left_value, left), (2 * s.node + 1, s.right_value, right)):
            side[at] = number[child] = len(path)
            for column, first in ((feature, -1), (bin_, 0), (left, 0), (right, 0), (value, worth), (path, child)):
                column.append(first)
    whole = [np.array(c) for c in (feature, bin_, left, right, value)]
    return Tree(*whole, np.array(path, np.int64), tuple(splits))


def _long(train: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """group, feature number, value of every finite value."""
    pairs = F.array(*(F.struct(F.lit(i).alias("feature"), F.col(name).cast("double").alias("value")) for i, name in enumerate(features)))
    return train.select(F.col(group).alias("grp"), F.inline(pairs)).where("value IS NOT NULL AND NOT isnan(value)")


def cuts(train: DataFrame, group: str, features: Sequence[str], bins: int) -> DataFrame:
    """grp, feature, threshold, median: at most ``bins`` - 1 thresholds per group and feature.

    Every distinct value is a bin where there are few; else bins hold equal shares of the rows. A threshold lies halfway
    between the values of two neighbouring bins.
    """
    ranked = reliable_checkpoint(value_ranks(_long(train, group, features), ["grp", "feature"], "value"))  # read three times
    shape = ranked.groupBy("grp", "feature").agg(
        F.count("*").alias("distinct"),
        *(F.max(F.when((F.col("below") <= rank) & (rank < F.col("below") + F.col("n")), F.col("value"))).alias(name)
          for name, rank in (("low", F.expr("(total - 1) div 2")), ("high", F.expr("total div 2")))),
    )
    shape = shape.select("grp", "feature", "distinct", ((F.col("low") + F.col("high")) / 2).alias("median"))
    placed = ranked.join(F.broadcast(shape), ["grp", "feature"])  # a row per group and feature
    few = F.col("distinct") <= bins
    order = W.partitionBy("grp", "feature").orderBy("value")
    number = placed.where(few).withColumn("bin", F.row_number().over(order).cast("long"))  # at most ``bins`` values
    share = placed.where(~few).withColumn("bin", F.expr(f"below * {bins} div total"))
    edges = number.unionByName(share).groupBy("grp", "feature", "median", "bin").agg(F.min("value").alias("first"), F.max("value").alias("last"))
    following = F.lead("first").over(W.partitionBy("grp", "feature").orderBy("bin"))  # at most ``bins`` rows
    return edges.select("grp", "feature", "median", ((F.col("last") + following) / 2).alias("threshold"))


def _start(train: DataFrame, group: str, features: Sequence[str], settings: Settings) -> tuple[dict, dict]:
    """(models without trees, row counts) by group: groups x features x bins rows reach the driver."""
    known = train.groupBy(F.col(group).alias("grp")).agg(F.avg(F.col("target").cast("double")).alias("rate"), F.count("*").alias("rows")).collect()
    rates = {r.grp: r.rate for r in known}
    if any(rate is None or not 0 < rate < 1 for rate in rates.values()):
        raise ValidationError("every group needs both classes")
    found: dict = {g: [(0.0, []) for _ in features] for g in rates}
    for r in cuts(train, group, features, settings.bins).collect():
        found[r.grp][r.feature] = (r.median, [*found[r.grp][r.feature][1], *([] if r.threshold is None else [r.threshold])])
    models = {
        g: GroupModel(float(np.log(rate / (1 - rate))), np.array([m for m, _ in found[g]]), tuple(np.sort(np.array(c, float)) for _, c in found[g]))
        for g, rate in rates.items()
    }
    return models, {r.grp: r.rows for r in known}


def _values(batch: pa.RecordBatch, features: Sequence[str]) -> np.ndarray:
    return np.stack([batch.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False) for name in features], 1)


def _block(groups: np.ndarray, target: np.ndarray, bins: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
    arrays = (groups.astype("<i4"), target.astype(np.int8), bins.astype(np.uint8), raw.astype("<f8"))
    return pa.record_batch([pa.array([np.ascontiguousarray(a).tobytes()], pa.binary()) for a in arrays], names=["grp", "target", "bins", "raw"])


BLOCKS = "grp binary, target binary, bins binary, raw binary"  # one row per Arrow batch of rows


def _unpacked(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group number, target, bins, raw score) of the rows of a block."""
    groups = np.frombuffer(block["grp"], "<i4")
    bins = np.frombuffer(block["bins"], np.uint8).reshape(len(groups), -1)
    return groups, np.frombuffer(block["target"], np.int8), bins, np.frombuffer(block["raw"], "<f8").copy()


def _binned(train: DataFrame, group: str, features: Sequence[str], models: dict, number: dict) -> DataFrame:
    names = [f"f{i}" for i in range(len(features))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups = np.array([number[g] for g in batch.column("grp").to_pylist()], np.int32)
            values, bins, raw = _values(batch, names), np.zeros((len(groups), len(names)), np.uint8), np.zeros(len(groups))
            for g, model in models.items():
                mine = groups == number[g]
                if mine.any():
                    bins[mine], raw[mine] = model.binned(values[mine]), model.baseline
            yield _block(groups, batch.column("target").to_numpy(), bins, raw)

    source = train.select(F.col(group).alias("grp"), F.col("target").cast("int").alias("target"), *(F.col(c).cast("double").alias(n) for c, n in zip(features, names, strict=True)))
    return source.mapInArrow(run, BLOCKS)


def _with_trees(groups: np.ndarray, bins: np.ndarray, raw: np.ndarray, pending: Sequence[Sequence[Tree]]) -> np.ndarray:
    """Raw scores with the trees added that they do not hold yet."""
    for g, trees in enumerate(pending):
        mine = np.flatnonzero(groups == g) if trees else ()
        if len(mine):
            raw[mine] += sum(tree.value[tree.place(bins[mine])] for tree in trees)
    return raw


def histograms(blocks: RDD, pending: Sequence[Sequence[Tree]], partial: Sequence[Tree], wanted: Sequence[set], small: Sequence[set] = ()) -> RDD:
    """((group, node), int64 array of rows, gradients and hessians by feature and bin) of the wanted nodes, once per task.

    For nodes in ``small`` the value is a list instead: bins, gradients and hessians of the node's rows.
    """

    def run(rows):
        found: dict[tuple[int, int], np.ndarray | list] = {}
        for block in rows:
            groups, target, bins, raw = _unpacked(block)
            width = bins.shape[1]
            p = _sigmoid(_with_trees(groups, bins, raw, pending))
            g, h = np.rint((p - target) * UNIT), np.rint(p * (1 - p) * UNIT)
            for one, tree in enumerate(partial):
                mine = np.flatnonzero(groups == one) if wanted[one] else ()
                if not len(mine):
                    continue
                node = tree.path[tree.place(bins[mine])]
                for path in wanted[one]:
                    inside = mine[node == path]
                    if len(inside) and small and path in small[one]:
                        found.setdefault((one, path), []).append((bins[inside], g[inside], h[inside]))
                    elif len(inside):
                        total = found.setdefault((one, path), np.zeros((3, width, 256), np.int64))
                        total += histogram(bins[inside], g[inside], h[inside])  # sums of one block are exact in doubles
        return found.items()

    return blocks.mapPartitions(run)


def histogram(bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Rows, gradients and hessians by feature and bin."""
    width = bins.shape[1]
    cell = (bins + 256 * np.arange(width)).ravel()
    sums = (np.bincount(cell, w if w is None else np.repeat(w, width), width * 256) for w in (None, g, h))
    return np.stack([s.astype(np.int64).reshape(width, 256) for s in sums])


def subtree(node: int, rows: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], settings: Settings) -> list[Split]:
    """Best splits of a small node and of the nodes below it that a best-first tree can reach."""
    bins, g, h = (np.concatenate(part) for part in zip(*rows, strict=True))
    whole = histogram(bins, g, h)
    inside, sums, found, waiting = {node: np.arange(len(bins))}, {node: whole}, [], []

    def search(at: int) -> None:
        split = best_split(at, sums[at], settings)
        if split:
            found.append(split)
            heapq.heappush(waiting, (-split.gain, at, split))

    search(node)
    for _ in range(settings.leaves - 2):  # children of the last possible split stay leaves
        if not waiting:
            break
        _, at, split = heapq.heappop(waiting)
        mine, total = inside.pop(at), sums.pop(at)
        goes = bins[mine, split.feature] <= split.bin
        inside[2 * at], inside[2 * at + 1] = mine[goes], mine[~goes]
        less, more = (2 * at, 2 * at + 1) if split.left_rows <= split.right_rows else (2 * at + 1, 2 * at)
        sums[less] = histogram(bins[inside[less]], g[inside[less]], h[inside[less]])
        sums[more] = total - sums[less]
        search(2 * at)
        search(2 * at + 1)
    return found


def best_split(node: int, histogram: np.ndarray, settings: Settings) -> Split | None:
    """The best admissible split of a node, None where nothing gains."""
    left = histogram.cumsum(axis=2)
    whole = left[:, :1, -1:]
    right = whole - left

    def term(side: np.ndarray) -> np.ndarray:
        return (side[1] / UNIT) ** 2 / (side[2] / UNIT + settings.l2)

    open_ = np.logical_and(*((side[0] >= settings.min_rows) & (side[2] >= settings.min_hessian * UNIT) for side in (left, right)))
    open_ &= histogram[0] > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(open_, np.round(term(left) + term(right) - term(whole), GAIN_DIGITS), 0)
    feature, bin_ = np.unravel_index(gain.argmax(), gain.shape)
    if not gain[feature, bin_] > 0:
        return None
    values = [-settings.rate * (side[1, feature, bin_] / UNIT) / (side[2, feature, bin_] / UNIT + settings.l2) for side in (left, right)]
    return Split(node, int(feature), int(bin_), float(gain[feature, bin_]), int(left[0, feature, bin_]), int(right[0, feature, bin_]), *map(float, values))


def _grow(blocks: RDD, pending: list[list[Tree]], sizes: Sequence[int], settings: Settings) -> list[Tree]:
    """The next tree of every group; ``sizes`` are the groups' row counts."""
    groups = range(len(pending))
    known: list[dict[int, Split]] = [{} for _ in groups]
    searched: list[set] = [set() for _ in groups]
    below: list[set] = [set() for _ in groups]  # small nodes: all below them is known
    tasks = max(blocks.getNumPartitions(), min(len(groups), blocks.ctx.defaultParallelism))

    def added(found) -> list[Split]:
        (_, node), value = found
        if isinstance(value, list):
            return subtree(node, value, settings)
        split = best_split(node, value, settings)
        return [split] if split else []

    while True:
        orders = [grown(known[g], settings.leaves) for g in groups]
        # Children of all splits made so far; those of the last possible one stay leaves.
        wanted, small = [], []
        for g in groups:
            made = orders[g][: settings.leaves - 2]
            reach = {1: sizes[g]} if settings.leaves > 1 else {}
            for s in made:
                reach |= {2 * s.node: s.left_rows, 2 * s.node + 1: s.right_rows}
            new = {n for n in reach if n not in searched[g] and not any(n >> up in below[g] for up in range(1, n.bit_length()))}
            wanted.append(new)
            small.append({n for n in new if reach[n] <= SMALL_NODE})
        if not any(wanted):
            return [tree_of(order) for order in orders]
        partial = [tree_of(order) for order in orders]
        # `add` adds histograms and joins the row lists of small nodes
        parts = histograms(blocks, pending, partial, wanted, small).reduceByKey(operator.add, tasks)
        for g, splits in parts.map(lambda x: (x[0][0], added(x))).collect():  # at most two splits per leaf
            known[g] |= {split.node: split for split in splits}
        for g in groups:
            searched[g] |= wanted[g]
            below[g] |= small[g]


def _written(state: DataFrame, pending: list[list[Tree]]) -> DataFrame:
    """``state`` with the pending trees in its raw scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                groups, target, bins, raw = _unpacked(block)
                yield _block(groups, target, bins, _with_trees(groups, bins, raw, pending))

    return reliable_checkpoint(state.mapInArrow(run, BLOCKS))


def fit(train: DataFrame, features: Sequence[str], group: str | None = None, settings: Settings = Settings()) -> Fitted:
    """A model for every value of ``group`` in ``train`` (target 0 or 1); missing values count as the group's median.

    No rows give no models; a group of one class raises.
    """
    column = group or "_group"
    if group is None:
        train = train.withColumn(column, F.lit(0))
    models, rows = _start(train, column, features, settings)
    if not models:
        return Fitted(tuple(features), group, {})
    number = {g: i for i, g in enumerate(sorted(models))}
    state = reliable_checkpoint(_binned(train, column, features, models, number))
    blocks, pending = state.rdd, [[] for _ in number]
    sizes = [rows[g] for g in number]
    trees = [[] for _ in number]
    for done in range(settings.trees):
        if done and done % WRITTEN_EVERY == 0:
            state, pending = _written(state, pending), [[] for _ in number]
            blocks = state.rdd
        for g, tree in enumerate(_grow(blocks, pending, sizes, settings)):
            pending[g].append(tree)
            trees[g].append(tree)
    whole = {g: GroupModel(m.baseline, m.medians, m.thresholds, tuple(trees[number[g]])) for g, m in models.items()}
    return Fitted(tuple(features), group, whole)


def score(fitted: Fitted, rows: DataFrame) -> DataFrame:
    """``rows`` with ``probability`` from the model of their group (NULL where there is none); one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _values(batch, fitted.features)
            groups = np.array(batch.column(fitted.group).to_pylist(), object) if fitted.group else np.zeros(len(values))
            out = np.full(len(groups), np.nan)
            for g, model in fitted.models.items():
                mine = groups == g
                if mine.any():
                    out[mine] = model.probability(values[mine])
            yield pa.record_batch([*batch.columns, pa.array(out, mask=np.isnan(out))], names=[*batch.schema.names, "probability"])

    kept = rows.drop("probability")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields), "probability double"])
    return kept.mapInArrow(run, schema)


def split_table(spark, fitted: Fitted) -> DataFrame:
    """One row per split of all trees: grp (as text), tree, step, node, feature (number), threshold, gain, rows and values of both sides."""
    rows = [
        (str(g), t, k, s.node, s.feature, float(m.thresholds[s.feature][s.bin]), s.gain, s.left_rows, s.right_rows, s.left_value, s.right_value)
        for g, m in fitted.models.items()
        for t, tree in enumerate(m.trees, 1)
        for k, s in enumerate(tree.splits, 1)
    ]
    return spark.createDataFrame(rows, "grp string, tree int, step int, node long, feature int, threshold double, gain double, left_rows long, right_rows long, left_value double, right_value double")
