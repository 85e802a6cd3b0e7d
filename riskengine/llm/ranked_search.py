"""Ranked search of all documents for each item, with bags scored once.

A document matters to a set of items only through its counts of the items' terms and through
its length, which enters as the integer m. So documents are restricted to the items' vocabulary
and grouped into classes of equal counts and equal m: by a hash first, then by the counts
themselves. A class is scored once, and its members follow in ascending order of their ids, of
which it keeps as many as a result list can hold.

Items are taken in blocks of about ``BLOCK_WORDS`` words, so that what is sent to the tasks and
held by them (vocabulary, postings, one result list per item) is bounded however many items
there are; each block is searched against all documents.

All sums are integers. A NULL text has no terms. Documents without an id come after all ids;
items without terms find nothing; repeated rows count and appear each by itself. Other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from riskengine.llm.shingles import pieces, word_hashes, word_places
from riskengine.llm.text import ascii_lower, small_batches, whole
from riskengine.session import materialise

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 20
BLOCK_WORDS = 1 << 20  # words of the items searched at a time
CELLS = 1 << 22        # numbers of a task's working arrays
EXACT = 1 << 53

_TERM = np.ones(256, dtype=bool)
for _low, _high in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _TERM[_low:_high + 1] = False


def terms(text: Column | str) -> Column:
    return F.regexp_extract_all(ascii_lower(whole(text)), F.lit(TERM), F.lit(0))


class Vocabulary:
    """The terms of a block of items: numbers by hash, and postings (item, repeats) by term."""

    def __init__(self, items: list[Row]):
        words = sorted({t for r in items for t in r.terms})
        raw = pa.array(words, pa.large_string())
        own = np.concatenate([word_hashes(*word_places(p, _TERM)[:3]) for p in pieces(raw)]) if words else np.zeros(0, np.uint64)
        order = np.argsort(own, kind="stable")
        self.hashes, self.words = own[order], [words[i].encode() for i in order]
        number = {w: i for i, w in enumerate(self.words)}
        found = sorted((number[t.encode()], i) for i, r in enumerate(items) for t in r.terms)
        pairs, repeats = np.unique(np.array(found, np.int64).reshape(-1, 2), axis=0, return_counts=True)
        self.item, self.repeats = pairs[:, 1], repeats
        self.start = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
        self.ids = [r.item for r in items]
        self.longest = max((len(r.terms) for r in items), default=0)

    def number(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Each word's number, -1 if it is none of the vocabulary."""
        if not len(self.hashes) or not len(starts):
            return np.full(len(starts), -1)
        h = word_hashes(data, starts, ends)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        at[self.hashes[at] != h] = -1
        return at


def counted(docs: DataFrame, vocabulary, key: str, text: str) -> DataFrame:
    """(id, n, body): documents with terms; ``body`` holds the vocabulary's terms and their counts, each as 32-bit numbers."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            n, bodies = [], []
            for part in pieces(batch.column(1)):
                data, starts, ends, at = word_places(part, _TERM)
                number = known.number(data, starts, ends)
                hit = np.flatnonzero(number >= 0)
                doc = np.searchsorted(at, hit, side="right") - 1
                pair, counts = np.unique(doc * (len(known.words) + 1) + number[hit], return_counts=True)
                doc, term = np.divmod(pair, len(known.words) + 1)
                cut = np.searchsorted(doc, np.arange(len(part) + 1))
                n.append(np.diff(at))
                bodies += [term[a:b].astype("<u4").tobytes() + counts[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:])]
            if n:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n).astype(np.int64)), pa.array(bodies, pa.binary())], names=["id", "n", "body"])
    rows = docs.select(F.col(key).cast("long").alias("id"), whole(text).alias("text"))
    return rows.mapInArrow(run, "id long, n long, body binary").where("n > 0")


def unpacked(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of all bodies, row by row."""
    parts = [np.frombuffer(b.as_buffer(), "<u4").reshape(2, -1) for b in bodies]
    flat = np.concatenate(parts, axis=1).astype(np.int64) if parts else np.zeros((2, 0), np.int64)
    return np.repeat(np.arange(len(parts)), [p.shape[1] for p in parts]), flat[0], flat[1]


def document_counts(vectors: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary: sums over all rows, added up per task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(unpacked(batch.column(0))[1], minlength=size)
        held = np.flatnonzero(total)
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["term", "df"])
    out = np.zeros(size, np.int64)
    for r in vectors.select("body").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r.term] = r.df  # as many rows as the block has terms
    return out


def bags(vectors: DataFrame, documents: int, length: int, top: int) -> DataFrame:
    """(m, body, ids): classes of equal counts and m, with their first ids."""
    m = F.expr(f"cast(75 + (cast(25 * n as decimal(38, 0)) * cast({documents} as decimal(19, 0))) div {length} as bigint)")
    rows = vectors.where("length(body) > 0").select("id", m.alias("m"), "body").withColumn("hash", F.xxhash64("body", "m"))
    same = ["hash", "m", "body"]
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*same).orderBy(F.col("id").asc_nulls_last()))).where(F.col("_n") <= top)
    return few.groupBy(*same).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"]).alias("ids")).select("m", "body", "ids")


class Best:
    """The first ``top`` classes of each item by score, then by their first member."""

    def __init__(self, items: int, top: int):
        self.top, self.least = top, np.ones(items, np.int64)  # scores below ``least`` cannot enter
        self.item, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids: list = []

    def add(self, scores: np.ndarray, ids: list) -> None:
        """``scores``: classes x items; ``ids``: the members of each class."""
        row, item = np.nonzero(scores >= self.least)
        if not len(row):
            return
        score, members = np.concatenate([self.score, scores[row, item]]), self.ids + [ids[i] for i in row]
        item = np.concatenate([self.item, item])
        unnamed = np.array([m[0] is None for m in members])
        first = np.array([m[0] or 0 for m in members], np.int64)
        order = np.lexsort((first, unnamed, -score, item))
        sorted_item = item[order]
        place = np.arange(len(order)) - np.searchsorted(sorted_item, sorted_item)
        order = order[place < self.top]
        self.item, self.score, self.ids = item[order], score[order], [members[i] for i in order]
        full = place[place < self.top] == self.top - 1
        self.least[self.item[full]] = self.score[full]


def ranked(classes: DataFrame, vocabulary, weights: np.ndarray, top: int) -> DataFrame:
    """(item, item_id, score, ids): what each task's classes can add to the result lists."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        items, fan = len(v.ids), np.diff(v.start)
        exact = int(weights.max(initial=0)) * 1_000_000 * v.longest < EXACT
        best = Best(items, top)
        for batch in batches:
            m = batch.column(0).to_numpy()
            row, term, tf = unpacked(batch.column(1))
            ids = batch.column(2).to_pylist()
            value = weights[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[row]))
            ends = np.searchsorted(row, np.arange(len(m)), side="right")
            load = np.concatenate([[0], np.cumsum(fan[term])])[ends] + np.arange(1, len(m) + 1) * items
            a = 0
            while a < len(m):  # as many classes at a time as the working arrays may hold
                b = max(a + 1, int(np.searchsorted(load, (load[a - 1] if a else 0) + CELLS, side="right")))
                lo, hi = (int(ends[a - 1]) if a else 0), int(ends[b - 1])
                each = fan[term[lo:hi]]
                place = np.repeat(v.start[:-1][term[lo:hi]] - np.concatenate([[0], np.cumsum(each)[:-1]]), each) + np.arange(each.sum()) if hi > lo else np.zeros(0, np.int64)
                cell = np.repeat((row[lo:hi] - a) * items, each) + v.item[place]
                worth = np.repeat(value[lo:hi], each) * v.repeats[place]
                total = lambda x: np.bincount(cell, weights=x, minlength=(b - a) * items).astype(np.int64)
                scores = total(worth) if exact else (total(worth >> 24) << 24) + total(worth & 0xFFFFFF)
                best.add(scores.reshape(b - a, items), ids[a:b])
                a = b
        if len(best.item):
            yield pa.RecordBatch.from_arrays([
                pa.array(best.item), pa.array([v.ids[i] for i in best.item], pa.int64()), pa.array(best.score), pa.array(best.ids, pa.list_(pa.int64()))],
                names=["item", "item_id", "score", "ids"])
    return classes.mapInArrow(run, "item long, item_id long, score long, ids array<bigint>")


def block_search(docs: DataFrame, items: list[Row], key: str, text: str, top: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(Vocabulary(items))
    vectors = materialise(counted(docs, vocabulary, key, text), "search-vectors")
    total = vectors.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("l")).first()
    df = document_counts(vectors, len(vocabulary.value.words))
    weights = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    found = ranked(bags(vectors, total.n, max(1, total.l), top), vocabulary, weights, top)
    rows = found.select("item", "item_id", "score", F.explode("ids").alias("doc_id"))
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "item_id", "rank", F.col("doc_id").alias(key), "score")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
           top: int = TOP, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Rows (item_id, rank, ``key``, score): the ``top`` documents of each item with a score above 0."""
    asked = materialise(items.select(F.col(item_key).cast("long").alias("item"), terms(item_text).alias("terms")).where(F.size("terms") > 0), "search-items")
    words = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-words // block_words))
    dealt = asked.withColumn("block", F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)))
    parts = [dealt.where(F.col("block") == b).drop("block").collect() for b in range(blocks)]  # about block_words words each
    return reduce(DataFrame.unionByName, [block_search(docs, p, key, text, top) for p in parts])
