"""Hard negatives by Fagin's threshold algorithm over blocks of integer vectors.

Rows of equal integer vector and label form a class; a class keeps its few smallest ids, as
nothing else can appear in a list of that length. Classes are dealt into blocks of bounded
size, ordered by label. A task holds one block with a list per dimension sorted by component,
and lets the anchors stream past. For an anchor, the lists are read from the end that its sign
favours, all to the same depth; each row met is scored once by random access. No row that was
not met can score more than the threshold, the sum of the anchor's components times the
components at that depth. A window is done when the threshold falls strictly below its k-th
score (equal scores are settled by id, so they are all met) or below its lower end.

First the anchors look for positives in the blocks of their own label, then, with the windows
that the positives' scores define, for negatives in all blocks.

NULL labels, NULL vectors, and vectors with a NULL or non-finite component take no part; nor
do vectors whose product with themselves exceeds 64 bits. An empty vector scores 0; a missing
component of a shorter vector is 0. Rows without an id can be negatives or positives, after all
ids, but no anchors. A repeated anchor row gives its rows again. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskengine.session import materialise

SCALE = 256
BLOCK_VALUES = 1 << 21  # components of a block, held by one task
DEPTH = 32              # first depth of sorted access; doubles while a window is open
EXACT = float(1 << 53)


@dataclass(frozen=True)
class Mining:
    """Positives of an anchor, negatives of a positive, and the window of negative scores as shares of the positive's."""
    positives: int = 5
    negatives: int = 5
    low: tuple[int, int] = (80, 100)


def integers(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label") -> DataFrame:
    """(id, label, v, name): the rows that take part; ``name`` stands for vector and label."""
    scaled = lambda x: F.lit(float(SCALE)) * x.cast("double")
    rows = df.select(F.col(key).cast("long").alias("id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
                     F.col(vector).alias("e")).where("label is not null and e is not null")
    rows = rows.where(F.forall("e", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))))
    # the sum bounds every product of two such vectors, by Cauchy-Schwarz
    rows = rows.where(F.aggregate("e", F.lit(0.0), lambda a, x: a + F.pow(F.abs(scaled(x)) + 1, F.lit(2))) < float(1 << 62))
    rows = rows.withColumn("v", F.transform("e", lambda x: F.floor(scaled(x)).cast("int"))).drop("e")
    return rows.withColumn("name", F.md5(F.concat_ws(":", F.col("label"), F.array_join(F.col("v").cast("array<string>"), ","))))


def classes(rows: DataFrame, most: int) -> DataFrame:
    """(name, label, v, ids): one row per vector and label, with its ``most`` smallest ids (NULL last)."""
    order = Window.partitionBy("name").orderBy(F.col("id").asc_nulls_last())
    few = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"])
    return few.groupBy("name").agg(F.first("label").alias("label"), F.first("v").alias("v"), ids.alias("ids"))


class Block:
    """Vectors of one block, with a list per dimension sorted by component."""

    def __init__(self, names: list, labels: np.ndarray, ids: list, vectors: list[np.ndarray]):
        rank = sorted(range(len(ids)), key=lambda i: (ids[i][0] is None, ids[i][0] or 0))  # ties go by the smallest id
        self.names, self.ids, self.labels = [names[i] for i in rank], [ids[i] for i in rank], labels[rank]
        self.whole = np.zeros((len(rank), max(len(v) for v in vectors)), np.int64)
        for r, i in enumerate(rank):
            self.whole[r, :len(vectors[i])] = vectors[i]
        self.floats = self.whole.astype(np.float64)
        self.largest = float(np.abs(self.floats).max(initial=0))
        self.lists = np.ascontiguousarray(np.argsort(self.whole, axis=0, kind="stable").T.astype(np.int32))

    def search(self, anchor: np.ndarray, usable: np.ndarray, windows: list[tuple], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window (lowest, highest score; None is open) the first k usable rows: (rows, scores)."""
        n = len(self.whole)
        a = np.zeros(self.whole.shape[1], np.int64)
        a[:min(len(a), len(anchor))] = anchor[:len(a)]
        exact = self.largest * float(np.abs(a).max(initial=0)) * len(a) < EXACT
        table, weights = (self.floats, a.astype(np.float64)) if exact else (self.whole, a)
        up, down = np.flatnonzero(a > 0), np.flatnonzero(a < 0)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in windows]
        open_ = set(range(len(windows)))
        seen = np.zeros(n, dtype=bool)
        depth, until = 0, DEPTH if len(up) + len(down) else n
        while open_:
            until = min(until, n)
            met = np.zeros(n, dtype=bool)
            if until == n:
                met[:] = True
            else:
                met[self.lists[up, n - until:n - depth]] = True
                met[self.lists[down, depth:until]] = True
            met &= ~seen
            seen |= met
            rows = np.flatnonzero(met & usable)
            scores = (table[rows] @ weights).astype(np.int64)
            for i in open_:
                low, high = windows[i]
                inside = np.ones(len(rows), dtype=bool)
                if low is not None:
                    inside &= scores >= low
                if high is not None:
                    inside &= scores <= high
                r, s = np.concatenate([best[i][0], rows[inside]]), np.concatenate([best[i][1], scores[inside]])
                if len(r) > 4 * k:  # a cut at the k-th score, ties included, before sorting
                    keep = s >= np.partition(s, len(s) - k)[len(s) - k]
                    r, s = r[keep], s[keep]
                first = np.lexsort((r, -s))[:k]
                best[i] = r[first], s[first]
            if until == n or seen.all():
                break
            edges = (np.concatenate([self.lists[up, n - until], self.lists[down, until - 1]]), np.concatenate([up, down]))
            parts = self.floats[edges] * a[edges[1]].astype(np.float64)
            threshold = parts.sum() if exact else parts.sum() + 1e-9 * np.abs(parts).sum() + 1
            open_ = {i for i in open_ if not (
                (len(best[i][1]) == k and threshold < best[i][1][-1]) or (windows[i][0] is not None and threshold < windows[i][0]))}
            depth, until = until, 2 * until
        return best


FOUND = "name string, window long, score long, other string, ids array<bigint>"


def scan(blocks: DataFrame, anchors: DataFrame, n_blocks: int, same: bool, k: int, low: tuple[int, int]) -> DataFrame:
    """Each anchor's best classes in each block it was sent to.

    ``blocks``: (block, name, label, v, ids); ``anchors``: (block, name, label, v, windows).
    """
    left = blocks.select("block", F.lit(0).alias("kind"), "name", "label", "v", "ids")
    right = anchors.select("block", F.lit(1).alias("kind"), "name", "label", "v", F.col("windows").alias("ids"))
    cells = left.unionByName(right).repartition(max(1, n_blocks), "block").sortWithinPartitions("block", "kind")

    def lists(column: pa.Array) -> list[np.ndarray]:
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        at = column.offsets.to_numpy()
        flat = column.values.to_numpy(zero_copy_only=False)
        return [flat[i:j] for i, j in zip(at[:-1], at[1:])]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, block, waiting = None, None, ([], [], [], [])
        for batch in batches:
            numbers, kinds, names, labels, _, ids = (c.to_pylist() for c in batch.columns)
            out = []
            for i, v in enumerate(lists(batch.column(4))):
                if kinds[i] == 0:
                    if numbers[i] != current:
                        current, block, waiting = numbers[i], None, ([], [], [], [])
                    for store, x in zip(waiting, (names[i], labels[i], ids[i], v)):
                        store.append(x)
                    continue
                if numbers[i] != current or not waiting[0]:
                    continue  # a block without rows
                if block is None:
                    block = Block(waiting[0], np.array(waiting[1], np.int64), *waiting[2:])
                usable = block.labels == labels[i] if same else block.labels != labels[i]
                windows = [(None, None)] if same else [(-(-low[0] * p // low[1]), p) for p in ids[i]]
                if not usable.any():
                    continue
                for p, (rows, scores) in zip([0] if same else ids[i], block.search(v, usable, windows, k)):
                    out += [(names[i], p, int(s), block.names[r], block.ids[r]) for r, s in zip(rows, scores)]
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
                                                  pa.array(columns[3], pa.string()), pa.array(columns[4], pa.list_(pa.int64()))],
                                                 names=["name", "window", "score", "other", "ids"])
    return cells.mapInArrow(search, FOUND)


def first_of(found: DataFrame, k: int) -> DataFrame:
    """(name, window, n, id, score, own) for n = 1..k: the first rows of all blocks' findings."""
    rows = found.select("name", "window", "score", (F.col("name") == F.col("other")).alias("own"), F.explode("ids").alias("id"))
    order = Window.partitionBy("name", "window").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def mine(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: Column | str = "label",
         anchor: Column | None = None, mining: Mining = Mining(), block_values: int = BLOCK_VALUES) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchor`` says of the column ``id`` which rows are anchors (all if None).
    """
    rows = integers(df, key, vector, label)
    most = max(mining.positives + 1, mining.negatives)
    base = materialise(classes(rows, most), "negative-classes")
    size = base.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    n_blocks = max(1, -(-size.n * max(1, size.d or 1) // block_values))
    blocks = materialise(base.repartitionByRange(n_blocks, "label", "name").withColumn("block", F.spark_partition_id()), "negative-blocks")

    wanted = rows.select("id", "name").where("id is not null")
    wanted = materialise(wanted if anchor is None else wanted.where(anchor), "negative-anchors")
    asking = materialise(base.drop("ids").join(wanted.select("name").distinct(), "name"), "negative-asking")

    places = blocks.select("block", "label").distinct()
    home = asking.join(places, "label").withColumn("windows", F.array().cast("array<bigint>"))
    near = materialise(first_of(scan(blocks, home, n_blocks, True, mining.positives + 1, mining.low), mining.positives + 1), "negative-positives")

    windows = near.groupBy("name").agg(F.array_sort(F.collect_set("score")).alias("windows"))  # at most positives + 1 each
    used = int(blocks.agg(F.max("block")).first()[0] or 0) + 1
    abroad = asking.join(windows, "name").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(used - 1))))
    far = materialise(first_of(scan(blocks, abroad, n_blocks, False, mining.negatives, mining.low), mining.negatives), "negative-found")

    # all that an anchor needs in one row per class of anchors
    negatives = far.groupBy("name", F.col("window").alias("score")).agg(
        F.array_sort(F.collect_list(F.struct("n", "id", "score"))).alias("negatives"))
    lists = near.join(negatives, ["name", "score"], "left").groupBy("name").agg(
        F.array_sort(F.collect_list(F.struct("n", "id", "score", "own", "negatives"))).alias("positives"))
    # one entry is the anchor itself: the first of its class with its id
    own = wanted.join(lists, "name").withColumn("self", F.expr(
        "array_min(transform(filter(positives, x -> x.own and x.id <=> id), x -> x.n))"))
    others = F.slice(F.filter("positives", lambda x: ~x["n"].eqNullSafe(F.col("self"))), 1, mining.positives)
    one = own.select(F.col("id").alias("anchor_id"), F.explode(others).alias("p")).select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score"), F.explode("p.negatives").alias("q"))
    return one.select("anchor_id", "positive_id", F.col("q.n").cast("int").alias("rank"), F.col("q.id").alias("negative_id"),
                      "positive_score", F.col("q.score").alias("negative_score"))
