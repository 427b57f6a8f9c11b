"""Operator 1: exact Jaccard self-join of word n-gram sets, and the groups its links form.

Prefix filtering: if two sets are similar enough, the first few of their n-grams in any fixed order have one in common.
The order is rare-first, so those n-grams are shared by few documents.

1. Every text becomes a set of 64-bit n-gram hashes. Equal sets are one set from here on.
2. Sets that link to nothing are found without an exchange of all n-grams: those in the lowest ``SLICE`` of the hash
   space are put first in the order, rarest first, so a set with a prefix' length of n-grams of its own there is done.
3. For the other sets, frequencies of all their n-grams give the order, the prefixes and the positions in it.
4. Rounds over one prefix n-gram per set compare a set with its neighbours in parts of bounded size. They join most of
   a large group of near copies with a number of comparisons that grows with its members, not with their pairs.
5. The complete round: all pairs that share a prefix n-gram and are not yet in one group, by length, positional,
   bitmap and suffix filter, each verified once. After it no link between groups can be missing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bloom
from . import textarrays as ta
from .components import components
from .storage import release_shuffles, small_batches, stored

SLICE = 1 / 4  # of the hash space; frequencies there decide which sets can have links
STRATA = 16  # equal parts of the hash space whose counts the suffix filter compares
BITMAP = 256  # bits of a set's bitmap: each n-gram flips one, so two sets differ in at least as many n-grams as bits
PART = 2048  # sets compared in one run of a round
TRIES = 12  # comparisons without a link after which a round leaves a set to the next
HELD = 128  # sets of a block that others are compared with
ROUNDS = 6  # at most; two are enough where no n-gram has more than PART sets
_BITMAP = [f"b{i}" for i in range(BITMAP // 64)]
_U = np.uint64


def text_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of every text, ascending within a text, and their offsets.

    Words are lower-cased (A-Z). A text of fewer words than ``size`` has one n-gram of all of them, one without words none.
    """
    data = ta.LOWER[data]
    starts, ends, first = ta.words(data, offsets)
    words = ta.mix(ta.PrefixHash(data).pieces(starts, ends))
    row, count = ta.rows_of(first), np.diff(first)
    grams = ta.window_hashes(words, size)
    whole = row[: len(grams)] == row[size - 1 :] if len(grams) else np.zeros(0, bool)
    grams, owner = grams[whole], row[: len(grams)][whole]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        extra = np.array([ta.mix(np.add.reduce(words[first[i] : first[i + 1]] * ta.powers(ta.BASE, size)[1 : count[i] + 1], keepdims=True) + _U(count[i]))[0] for i in short], _U)
        grams, owner = np.concatenate([grams, extra]), np.concatenate([owner, short])
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[fresh], owner[fresh]
    return grams, np.searchsorted(owner, np.arange(len(offsets)))


def needed(n: Column, percent: int) -> Column:
    """Fewest common n-grams that a set of n has with any set it links to."""
    return F.floor((F.lit(percent) * n + 99) / 100)


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, for sorted distinct arrays."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def _source(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _set_rows(df: DataFrame, size: int) -> DataFrame:
    """doc_id, key (hash of the set), n, and the n-grams in the slice."""
    limit = _U(int(SLICE * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in ta.blocks(batches):
            grams, at = text_sets(data, offsets, size)
            n = np.diff(at)
            key = _keys(grams, at)
            low = grams < limit
            kept = np.concatenate([[0], np.cumsum(low)])[at]
            yield pa.record_batch([part.column("doc_id"), pa.array(key.view(np.int64)), pa.array(n), _lists(grams[low].view(np.int64), kept)], names=["doc_id", "key", "n", "slice"])

    return _source(df).mapInArrow(run, "doc_id long, key long, n long, slice array<long>")


def _keys(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, _U), np.cumsum(ta.mix(grams), dtype=_U)])
    return ta.mix(total[at[1:]] - total[at[:-1]] + ta.mix(np.diff(at)))


def _full_sets(df: DataFrame, size: int, bits: bytes) -> DataFrame:
    """key, n, grams (ascending as unsigned), strata and bitmap (b0, b1, ...) of the rows whose doc_id the filter lets pass."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bloom.may_have(bits, np.asarray(batch.column("doc_id").fill_null(0)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in ta.blocks(possible(batches)):
            grams, at = text_sets(data, offsets, size)
            n = np.diff(at)
            row = np.repeat(np.arange(len(n)), n)
            cell = row * STRATA + (grams >> _U(64 - STRATA.bit_length() + 1)).astype(np.int64)
            strata = np.bincount(cell, minlength=len(n) * STRATA).astype(np.int32)
            flips = np.bincount(row * BITMAP + (grams >> _U(20)).astype(np.int64) % BITMAP, minlength=len(n) * BITMAP) & 1
            bitmap = np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64).reshape(len(n), -1)
            yield pa.record_batch(
                [pa.array(_keys(grams, at).view(np.int64)), pa.array(n), _lists(grams.view(np.int64), at), _lists(strata, np.arange(len(n) + 1) * STRATA), *map(pa.array, bitmap.T.copy())],
                names=["key", "n", "grams", "strata", *_BITMAP],
            )

    return _source(df).mapInArrow(run, f"key long, n long, grams array<long>, strata array<int>, {', '.join(f'{b} long' for b in _BITMAP)}")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """gram, key, n, pos of every n-gram of a prefix that another set has too; pos counts from 0 in rare-first order."""
    rows = sets.select("key", "n", F.explode("grams").alias("gram"))
    shared = stored(rows.groupBy("gram").agg(F.count("*").cast("int").alias("df")).where("df > 1"), "shared")
    release_shuffles(sets.sparkSession)
    own = rows.join(shared.hint("merge"), "gram")
    by_set = Window.partitionBy("key")
    # n-grams no other set has come first
    pos = F.col("n") - F.count("*").over(by_set) + F.row_number().over(by_set.orderBy("df", "gram")) - 1
    placed = own.withColumn("pos", pos)
    return placed.where(F.col("pos") < F.col("n") - needed(F.col("n"), percent) + 1).select("gram", "key", "n", "pos")


def _round(prefixes: DataFrame, sets: DataFrame, labels: DataFrame | None, percent: int, number: int) -> tuple[DataFrame, bool]:
    """Compared pairs (a, b, linked): each set with neighbours that share one of its prefix n-grams.

    Also whether the sets of some n-gram were dealt to several parts, whose members another round may bring together.
    """
    chosen = prefixes.groupBy("key").agg(F.min_by("gram", F.xxhash64("gram", F.lit(number))).alias("gram"))
    chosen = stored(chosen, "chosen")
    counts = stored(chosen.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1"), "counts")
    largest = counts.agg(F.max("m")).first()[0] or 0
    parts = F.pmod(F.xxhash64("key", F.lit(number)), F.ceil(F.col("m") / PART))
    dealt = chosen.join(counts.hint("merge"), "gram").select("key", "gram", parts.alias("part"))
    if labels is None:
        named = dealt.withColumn("label", F.col("key"))
    else:
        named = dealt.join(labels.hint("merge"), dealt["key"] == labels["node"], "left").select("key", "gram", "part", F.coalesce("label", "key").alias("label"))
    rows = named.join(sets.select("key", "n", "grams"), "key")
    runs = rows.repartition("gram", "part").sortWithinPartitions("gram", "part", "n", "key")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, members, root = None, [], {}

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            out: list[tuple[int, int, bool]] = []
            columns = [batch.column(c).to_pylist() for c in ("gram", "part", "key", "label", "n")]
            lists = batch.column("grams")
            for i, (gram, part, key, label, n) in enumerate(zip(*columns, strict=True)):
                if (gram, part) != at:
                    at, members, root = (gram, part), [], {}
                own = lists[i].values.to_numpy().view(np.uint64)
                root.setdefault(label, label)
                failed = 0
                for other, other_label, other_set in reversed(members):
                    if 100 * len(other_set) < percent * n or failed >= TRIES:
                        break
                    if find(other_label) == find(label):
                        continue
                    linked = links(other_set, own, percent)
                    out.append((min(key, other), max(key, other), linked))
                    if linked:
                        root[find(other_label)] = find(label)
                    else:
                        failed += 1
                members.append((key, label, own))
            yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "linked"])

    pairs = runs.select("gram", "part", "key", "label", "n", "grams").mapInArrow(compare, "a long, b long, linked boolean")
    return pairs, largest > PART


def _open_members(prefixes: DataFrame, labels: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefix rows with their group and bitmap, and those outside the largest group of their n-gram."""
    named = prefixes.join(labels.hint("merge"), prefixes["key"] == labels["node"], "left").join(sets.select("key", *_BITMAP).hint("merge"), "key")
    named = named.select("gram", "key", "n", "pos", F.coalesce("label", "key").alias("label"), *_BITMAP)
    sizes = named.groupBy("gram", "label").agg(F.count("*").alias("c"))
    main = sizes.groupBy("gram").agg(F.max(F.struct("c", "label")).alias("top"), F.sum("c").alias("m"), F.count("*").alias("k")).where("k > 1")
    marked = named.join(main.select("gram", F.col("top.label").alias("main"), "m").hint("merge"), "gram")
    return marked, marked.where("label <> main")


def _complete(marked: DataFrame, minor: DataFrame, sets: DataFrame, compared: DataFrame, percent: int) -> DataFrame:
    """All pairs that share a prefix n-gram across groups, filtered, verified once: (a, b, linked)."""
    x = minor.select("gram", F.col("key").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"), F.col("label").alias("lx"), *[F.col(b).alias(f"x{b}") for b in _BITMAP])
    y = marked.select("gram", F.col("key").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"), F.col("label").alias("ly"), (F.col("label") == F.col("main")).alias("in_main"), *[F.col(b).alias(f"y{b}") for b in _BITMAP])
    # length filter, and positional filter at this n-gram: a pair that links passes it at its first common one;
    # pairs of two minor members are found from both sides and taken from one
    fits = (F.col("lx") != F.col("ly")) & (F.col("in_main") | (F.col("x") < F.col("y")))
    fits &= (100 * F.col("nx") >= percent * F.col("ny")) & (100 * F.col("ny") >= percent * F.col("nx"))
    least_common = F.ceil(F.lit(percent) * (F.col("nx") + F.col("ny")) / (100 + percent))
    fits &= (F.col("nx") - F.col("px") >= least_common) & (F.col("ny") - F.col("py") >= least_common)
    # bitmap filter: a pair differs in as many n-grams as bits at least; in a large group of near copies few others pass
    flipped = sum((F.bit_count(F.col(f"x{b}").bitwiseXOR(F.col(f"y{b}"))) for b in _BITMAP), F.lit(0))
    fits &= flipped <= F.col("nx") + F.col("ny") - 2 * least_common
    met = x.join(y.hint("merge"), (x["gram"] == y["gram"]) & fits)
    a_first = F.col("x") < F.col("y")
    pick = lambda p, q: F.when(a_first, F.col(p)).otherwise(F.col(q))
    # the side of the largest group is the one that many others are compared with
    role = F.struct("in_main", F.col("ly").alias("target"), F.col("y").alias("y"))
    pairs = met.select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), pick("nx", "ny").alias("na"), pick("ny", "nx").alias("nb"),
        F.struct(pick("px", "py").alias("pa"), pick("py", "px").alias("pb")).alias("p"), role.alias("role"),
    )
    # the same at the first common n-gram, now that it is known
    first = pairs.groupBy("a", "b", "na", "nb").agg(F.min("p").alias("p"), F.max("role").alias("role"))
    common = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    near = first.where(F.least(F.col("na") - F.col("p.pa"), F.col("nb") - F.col("p.pb")) >= common)
    near = near.join(compared.select("a", "b").distinct().hint("merge"), ["a", "b"], "left_anti")
    y = F.col("role.y")
    return _verified(near.select(F.col("role.target").alias("target"), F.when(y == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("x"), y.alias("y")), sets, percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of pairs (x, y), with the sets sent once per block of pairs and not once per pair.

    A block holds at most about HELD sets x of one target group; the sets y, each after its pairs, pass by.
    """
    pairs = stored(pairs, "pairs")
    dealt = pairs.groupBy("target").agg(F.ceil(F.count_distinct("x") / HELD).alias("blocks"))
    blocks = F.pmod(F.xxhash64("x"), F.col("blocks")).alias("block")
    placed = stored(pairs.join(dealt.hint("merge"), "target").select("target", blocks, "x", "y"), "placed")
    own = sets.select("key", "grams", "strata")
    nothing = [F.lit(None).cast("array<long>").alias("grams"), F.lit(None).cast("array<int>").alias("strata")]
    held = placed.select("target", "block", F.col("x").alias("key")).distinct().join(own, "key").select("target", "block", F.lit(-(1 << 63)).alias("y"), F.lit(0).alias("kind"), "key", "grams", "strata")
    asked = placed.select("target", "block", "y", F.lit(1).alias("kind"), F.col("x").alias("key"), *nothing)
    passing = placed.select("target", "block", F.col("y").alias("key")).distinct().join(own, "key").select("target", "block", F.col("key").alias("y"), F.lit(2).alias("kind"), "key", "grams", "strata")
    rows = held.unionByName(asked).unionByName(passing).repartition("target", "block").sortWithinPartitions("target", "block", "y", "kind", "key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, known, wanted = None, {}, []
        for batch in batches:
            out: list[tuple[int, int, bool]] = []
            columns = [batch.column(c).to_pylist() for c in ("target", "block", "kind", "key")]
            grams, strata = batch.column("grams"), batch.column("strata")
            for i, (target, block, kind, key) in enumerate(zip(*columns, strict=True)):
                if (target, block) != at:
                    at, known, wanted = (target, block), {}, []
                if kind == 1:
                    wanted.append(key)
                    continue
                own = grams[i].values.to_numpy().view(np.uint64), strata[i].values.to_numpy()
                if kind == 0:
                    known[key] = own
                    continue
                for x in wanted:
                    other = known[x]
                    size = len(own[0]) + len(other[0])
                    common = -(-percent * size // (100 + percent))
                    # suffix filter: the counts of equal hash ranges differ by no more than the sets may
                    linked = bool(np.abs(own[1] - other[1]).sum() <= size - 2 * common) and links(own[0], other[0], percent)
                    out.append((min(x, key), max(x, key), linked))
                wanted = []
            yield pa.record_batch([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["a", "b", "linked"])

    return rows.select("target", "block", "kind", "key", "grams", "strata").mapInArrow(verify, "a long, b long, linked boolean")


def groups(df: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, key, label and component_id of every row of (doc_id, text); other columns are not read.

    Two documents link when 100 * intersection >= percent * union of their n-gram sets; component_id is the smallest
    doc_id that links reach. Texts without words (null too) have an empty set and link to nothing. Null doc_ids stay and are
    never the smallest unless a group has no other. Repeated rows are copies like any others. n-grams are compared by
    64-bit hashes, sets of a pair by all their n-grams. key stands for the set, label for the group.
    """
    spark = df.sparkSession
    small_batches(spark)
    # The text is read again for the slices: writing them would take more disk than reading it takes time.
    documents = stored(_set_rows(df, size).select("doc_id", "key", "n"), "sets")
    alone = (
        _set_rows(df, size).select("key", F.explode("slice").alias("gram"))
        .groupBy("gram").agg(F.min("key").alias("low"), F.max("key").alias("high"))
        .where("low = high").groupBy(F.col("low").alias("key")).agg(F.count("*").alias("own"))
    )
    unique = documents.where("n > 0").groupBy("key", "n").agg(F.min("doc_id").alias("doc_id"))
    prefix = F.col("n") - needed(F.col("n"), percent).cast("long") + 1
    alive = stored(unique.join(alone, "key", "left").where(F.coalesce("own", F.lit(0)) < prefix).select("key", "doc_id"), "alive")
    release_shuffles(spark)
    # texts are not shuffled: the filter leaves out most, and the join on the set's key the rest
    bits = bloom.build(alive.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id")), "doc_id")
    numbered = _full_sets(df, size, bits).join(alive.select("key"), "key", "left_semi").dropDuplicates(["key"]).withColumn("number", F.monotonically_increasing_id())
    numbered = stored(numbered, "alive-sets")
    # from here on a set goes by its number, which shuffles in fewer bytes than its hash
    sets = numbered.select(F.col("number").alias("key"), F.col("n").cast("int").alias("n"), "grams", "strata", *_BITMAP)
    release_shuffles(spark)
    prefixes = stored(_prefixes(sets, percent), "prefixes")
    release_shuffles(spark)

    compared, labels, open_before = [], None, None
    for number in range(ROUNDS):
        found, split = _round(prefixes, sets, labels, percent, number)
        compared.append(stored(found, "compared"))
        labels = stored(components(_union(compared).where("linked")), "labels")
        marked, minor = _open_members(prefixes, labels, sets)
        release_shuffles(spark)
        if number and not split:
            break
        left = minor.agg(F.sum("m")).first()[0] or 0
        if open_before is not None and left > open_before / 2:
            break
        open_before = left
    compared.append(stored(_complete(marked, minor, sets, _union(compared), percent), "compared"))
    release_shuffles(spark)
    found = components(_union(compared).where("linked"))
    labels = numbered.select("number", F.col("key").alias("node")).join(found.withColumnRenamed("node", "number"), "number").select("node", F.xxhash64("label").alias("label"))
    named = documents.join(labels.hint("merge"), documents["key"] == labels["node"], "left")
    named = stored(named.select("doc_id", "n", "key", F.coalesce("label", "key").alias("label")), "named")
    lowest = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    joined = named.join(lowest.hint("merge"), "label")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), "key", "label", own.alias("component_id"))


def representatives(df: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` with all columns, but of each group only one: that of the smallest doc_id (any of equal rows).

    Texts without words stay. Only documents that may have to go are shuffled. A group without a doc_id keeps one row.
    """
    found = stored(groups(df, size, percent), "groups")
    names = df.columns
    key = next(name for k in range(len(names) + 1) if (name := f"_key{k}") not in names)
    second = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.max(F.coalesce(F.col("doc_id") != F.col("component_id"), F.lit(False))).alias("goes"))
    bits = bloom.build(second.where("rows > 1 OR goes OR doc_id IS NULL").select(F.coalesce("doc_id", F.lit(0)).alias("doc_id")), "doc_id")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in ta.blocks(batches):
            unsure = bloom.may_have(bits, np.asarray(part.column("doc_id").cast(pa.int64()).fill_null(0)))
            grams, at = text_sets(data, offsets, size)
            yield part.append_column(key, pa.array(_keys(grams, at).view(np.int64), mask=~unsure))

    marked = df.mapInArrow(mark, T.StructType([*df.schema.fields, T.StructField(key, T.LongType())]))
    groups_of = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_set"), F.col("n_shingles").alias("_n"), "label", "component_id").distinct()
    same = (F.col(key) == F.col("_set")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_id"))
    unsure = marked.where(F.col(key).isNotNull()).select(F.struct(*names).alias("_row"), F.col("doc_id"), key).join(groups_of.hint("merge"), same)
    empty = unsure.where("_n = 0")
    best = Window.partitionBy("label").orderBy(F.col("_id").asc_nulls_last(), "_row.text")
    first = unsure.where("_n > 0 AND _id <=> component_id").withColumn("_rank", F.row_number().over(best)).where("_rank = 1")
    kept = marked.where(F.col(key).isNull()).select(*names)
    for rows in (empty, first):
        kept = kept.unionByName(rows.select("_row.*").select(*names))
    return kept


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


GROUPS_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [ws]
    ELSE list_transform(range(1, CAST(len(ws) - 2 AS BIGINT)), lambda i: ws[i:i + 3]) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(w.doc_id, coalesce(min(reach.y), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN reach ON reach.x = w.doc_id GROUP BY w.doc_id
"""
