"""Operator 12: what each filter of a chain removes, in every order of the chain.

Documents are reduced to counts per (part, failure mask) in Spark. The removal step of a mask under an order is a
min-plus product: 0 where the mask holds a filter and infinity elsewhere, plus the filter's position in the order (the
inverse permutation), minimised over the filters. Counts are then scattered to (order, step) by that rank.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
PARTS_AT_ONCE = 64  # parts unfolded together into (order, step) rows


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _times(factor: int, count: Column) -> Column:
    return factor * count.cast("long")


def _few_words(text: Column) -> Column:
    return F.size(_words(text)) < 50


def _repeating(text: Column) -> Column:
    words = _words(text)
    return _times(100, F.size(F.array_distinct(words))) < _times(65, F.size(words))


def _shouting(text: Column) -> Column:
    return _times(100, F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))) > _times(5, F.char_length(text))


def _symbols(text: Column) -> Column:
    return text.rlike("[#$%&*|]")


# Failure conditions on the text, by letter; None: identical to the text of a smaller doc_id.
FILTERS: Mapping[str, Callable[[Column], Column] | None] = {"A": _few_words, "B": _repeating, "C": _shouting, "D": _symbols, "E": None}

COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def positions(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(orders, inverse): all permutations of the filters, and the step (from 1) of each filter in each of them."""
    orders = np.array(list(itertools.permutations(range(size))))
    return orders, np.argsort(orders, axis=1) + 1


def removal_steps(inverse: np.ndarray) -> np.ndarray:
    """Step that removes each mask under each order; one more than there are filters where nothing does."""
    size = inverse.shape[1]
    fails = np.arange(1 << size)[:, None] >> np.arange(size) & 1 == 1
    cost = np.where(fails, 0, size + 1)
    return np.minimum((cost[None] + inverse[:, None]).min(axis=2), size + 1)


def step_counts(size: int, documents: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by (part, order, step) from documents by (part, mask)."""
    orders, inverse = positions(size)
    steps, n_parts, n_orders = removal_steps(inverse), len(documents), len(orders)
    fails = np.arange(1 << size)[:, None] >> np.arange(size) & 1
    slot = (np.arange(n_orders)[:, None] * (size + 1) + steps - 1).ravel()

    def scattered(weights: np.ndarray) -> np.ndarray:
        out = np.zeros((n_orders * (size + 1), n_parts), np.int64)
        np.add.at(out, slot, np.tile(weights.T, (n_orders, 1)))
        return out.T.reshape(n_parts, n_orders, size + 1)[:, :, :size]

    removed = scattered(documents)
    earlier = steps[:, :, None] < inverse[:, None]  # (order, mask, filter)
    redundant = np.einsum("pm,omf->pof", documents, earlier * fails)
    alone = documents[:, 1 << np.arange(size)]
    at_step = np.broadcast_to(orders, (n_parts, *orders.shape))
    own = np.take_along_axis(removed, np.broadcast_to(inverse - 1, at_step.shape), 2).sum(axis=1)
    by_step = lambda by_filter: np.take_along_axis(by_filter, at_step, 2)
    per_order = lambda by_filter: np.broadcast_to(by_filter[:, None], at_step.shape)
    return {
        "kept": documents.sum(axis=1)[:, None, None] - np.cumsum(removed, axis=2),
        "removed": removed,
        "redundant": by_step(redundant),
        "unique_fails": by_step(per_order(alone)),
        "good_lost": scattered(good),
        "toxic_lost": scattered(toxic),
        "shapley": by_step(per_order(own)),
    }


def masks(documents: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column], Column] | None] = FILTERS, part: str = "source") -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters they fail (bit i: the i-th filter).

    Equal documents collapse before every shuffle, so a group of copies or a source may hold any share of the rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mask = sum((F.when(test(text), 1 << i).otherwise(0) for i, test in enumerate(filters.values()) if test), F.lit(0))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        mask.alias("mask"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    rows = rows.groupBy("doc_id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    flag = lambda name: F.coalesce(F.max(F.col(name) == 1), F.lit(False)).alias(name)
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(flag("quality"), flag("toxic"))
    rows = rows.join(marks, "doc_id", "left").na.fill(False, ["quality", "toxic"])
    if None in filters.values():
        # A null doc_id counts as larger than every other one.
        rank = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "n")
        classes = rows.groupBy("digest", "part", "mask", "quality", "toxic").agg(F.sum("n").alias("n"), F.min(rank).alias("first"))
        classes = classes.withColumn("lead", F.struct("first.unknown", "first.doc_id"))
        least = classes.groupBy("digest").agg(F.min("lead").alias("least"))
        originals = F.when(F.col("lead").eqNullSafe(F.col("least")), F.col("first.n")).otherwise(0)
        bit = 1 << list(filters.values()).index(None)
        split = F.array(F.struct(F.col("mask"), originals.alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - originals).alias("n")))
        rows = classes.join(least, "digest").select("part", "quality", "toxic", F.inline(split))
    count = lambda name, where=F.lit(True): F.sum(F.when(where, F.col("n")).otherwise(0)).alias(name)
    return rows.groupBy("part", "mask").agg(count("n"), count("good", F.col("quality")), count("toxic", F.col("toxic"))).where("n > 0")


def audit(documents: DataFrame, labels: DataFrame, filters: Mapping[str, Callable[[Column], Column] | None] = FILTERS, part: str = "source") -> DataFrame:
    """One row per part, filter_order and step (all orders of all filters, zeros included), with ``COUNTS``.

    ``documents`` (doc_id, text, ``part``), ``labels`` (doc_id, quality, toxic); other columns are not read. A null text
    is empty, a null part the empty string. Repeated rows count each; rows of one doc_id are no copies of each other. A
    null doc_id counts as larger than all others and has no label. Labels that repeat a doc_id count once (1 if any is
    1). An empty table has no parts, so no rows.
    """
    size, letters = len(filters), np.array(list(filters))
    names = ["".join(letters[list(order)]) for order in positions(size)[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS_AT_ONCE):
                piece = batch.slice(at, PARTS_AT_ONCE)
                held = np.zeros((3, piece.num_rows, 1 << size), np.int64)
                for i, row in enumerate(piece.column("held").to_pylist()):
                    for one in row:
                        held[:, i, one["mask"]] = one["n"], one["good"], one["toxic"]
                found, per_part = step_counts(size, *held), len(names) * size
                yield pa.record_batch(
                    [
                        pa.array(np.repeat(np.array(piece.column("part").to_pylist(), object), per_part), pa.string()),
                        pa.array(np.tile(np.repeat(np.array(names, object), size), piece.num_rows), pa.string()),
                        pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), piece.num_rows * len(names))),
                        *(pa.array(np.ascontiguousarray(found[name]).ravel()) for name in COUNTS),
                    ],
                    names=["part", "filter_order", "step", *COUNTS],
                )

    held = masks(documents, labels, filters, part).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("held"))
    return held.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{name} long" for name in COUNTS))


AUDIT_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
first AS (SELECT text, min(doc_id) AS least FROM texts GROUP BY text),
judged AS (
  SELECT part, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
         100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 5 * length(t.text) AS c,
         regexp_matches(t.text, '[#$%&*|]') AS d, doc_id > least AS e,
         coalesce(quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS bad
  FROM texts t JOIN first USING (text) LEFT JOIN labels l USING (doc_id)),
masks AS (
  SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad
  FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT p.f || q.f || r.f || s.f || t.f AS filter_order, [p.i, q.i, r.i, s.i, t.i] AS chain
  FROM letters p, letters q, letters r, letters s, letters t
  WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
removals AS (
  SELECT part, filter_order, chain, fails, n, good, bad,
         coalesce(list_position(list_transform(chain, lambda f: fails[f]), true), 6) AS gone
  FROM masks, orders),
steps AS (
  SELECT part, filter_order, step, chain[step] AS f,
         sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN gone < step AND fails[chain[step]] THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails[chain[step]] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN gone = step THEN bad ELSE 0 END) AS toxic_lost
  FROM removals, range(1, 6) r(step) GROUP BY ALL)
SELECT part, filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM steps
"""
