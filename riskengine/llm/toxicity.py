"""Toxic passages by maximum-scoring segments over token log-odds.

1. Tokens are runs of letters, digits and non-ASCII bytes in lower case. Over the labelled
   documents, hashed counts of each word and of its first four and five bytes in toxic and
   other documents give log-odds with Dirichlet priors in a chain: the prior of a word is
   the estimate of its five bytes, theirs that of four, theirs the share of all tokens.
2. A linear scan finds every maximal scoring segment of a text (of log-odds less a drift).
3. Extreme-value calibration: lambda solves E[exp(lambda s)] = 1 over tokens of clean
   documents; K makes K n exp(-lambda S) the number of clean documents that reach S.
   A document's evidence is the excess of its best segment over what chance gives a
   text of its length; a logistic curve turns it into a probability.

Calibration sees texts that its counts have not seen: counts come from two thirds of the
labelled rows that may be learnt from, calibration from the other third, whose counts are
added afterwards. All models are sums over all these rows, of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from riskengine.llm import shingles
from riskengine.llm.text import maybe_in, small_batches, tidy, whole
from riskengine.session import materialise

BITS = 19                      # buckets of the hashed counts
CHUNKS = 64
MASSES = (4.0, 4.0, 10.0)      # prior mass of four bytes, five bytes, whole word
DRIFT = 2.0
THRESHOLD = 0.3
STEP = 0.25                    # of binned segment scores
BINS = 1024
TOKEN_BIN = 1 / 16
LOW, HIGH = -10.0, 14.0
LENGTHS = 64                   # half octaves of text length

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SALTS = tuple(np.uint64(x) for x in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35, 0))


@dataclass
class Model:
    odds: tuple[np.ndarray, np.ndarray]  # counts in toxic documents and in all, per bucket
    share: float                         # of all tokens that lie in toxic documents
    rate: float = 1.0                    # lambda
    scale: float = 0.1                   # K
    slope: float = 0.0
    offset: float = -2.0

    def evidence(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.maximum(0.0, self.rate * best - np.log(np.maximum(self.scale * n, 1e-9))) * (best > 0)

    def probability(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.minimum(self.evidence(best, n), 60.0) + self.offset, -40, 40)))


def buckets(part: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Per token its bucket by four bytes, by five and by the word; and where texts start."""
    data, starts, ends, at = shingles.word_places(part, _TOKEN)
    out = []
    for salt, end in zip(_SALTS, (np.minimum(ends, starts + 4), np.minimum(ends, starts + 5), ends)):
        out.append((shingles.mix(shingles.word_hashes(data, starts, end) ^ salt) >> np.uint64(64 - BITS)).astype(np.int64))
    return out, at


def token_scores(model: Model, ids: list[np.ndarray]) -> np.ndarray:
    toxic, every = model.odds
    estimate = np.full(len(ids[0]), model.share)
    for own, mass in zip(ids, MASSES):
        estimate = (toxic[own] + mass * estimate) / (every[own] + mass)
    estimate = np.clip(estimate, 1e-6, 1 - 1e-6)
    return np.log(estimate / (1 - estimate)) - math.log(model.share / (1 - model.share)) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) with their scores, in order, in linear time.

    A new positive score looks back for the nearest kept segment that starts lower; if
    that one ends lower too, both and all between become one, which looks back again.
    """
    total = np.concatenate([[0.0], np.cumsum(scores)])
    start, left, right, end, back = [], [], [], [], []
    for i in np.flatnonzero(scores > 0):
        s, lo, hi = int(i), float(total[i]), float(total[i + 1])
        j = len(start) - 1
        while True:
            while j >= 0 and left[j] >= lo:
                j = back[j]
            if j < 0 or right[j] >= hi:
                break
            s, lo = start[j], left[j]
            del start[j:], left[j:], right[j:], end[j:], back[j + 1:]
            j = back.pop()
        start.append(s), left.append(lo), right.append(hi), end.append(int(i) + 1), back.append(j)
    return [(a, b, hi - lo) for a, b, hi, lo in zip(start, end, right, left)]


def each_text(model: Model, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray]]:
    """(number of tokens, segments, token scores) of each text."""
    for part in shingles.pieces(column.fill_null("")):
        ids, at = buckets(part)
        scores = token_scores(model, ids)
        for a, b in zip(at[:-1], at[1:]):
            yield int(b - a), segments(scores[a:b]), scores[a:b]


def held_out(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str) -> DataFrame:
    """Texts with their label and use (0 counts, 1 calibration) of the rows that may be learnt from."""
    fold = F.crc32(F.col("_key").cast("string").cast("binary")) % 4
    known = labels.select(F.col(key).alias("_key"), F.col("toxic").cast("int").alias("_toxic")).where(
        "_key is not null and _toxic is not null").where(fold != 2).withColumn("_use", (fold == 3).cast("int"))
    number = known.select(F.xxhash64("_key").alias("_n"))
    texts = docs.select(F.col(key).alias("_key"), whole(text).alias("_text")).withColumn("_n", F.xxhash64("_key"))
    return maybe_in(texts, "_n", number).where("_may").select("_key", "_text").join(known, "_key").select("_text", "_toxic", "_use")


def summed(rows: DataFrame, make, kinds: int) -> list[np.ndarray]:
    """Sums of count arrays that ``make`` fills from Arrow batches: per task, then per chunk, then here."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = make(batches)
        rows = [(k, c, part.astype(np.uint32).tobytes()) for k, a in enumerate(arrays) for c, part in enumerate(np.split(a, CHUNKS)) if part.any()]
        if rows:
            kind, chunk, raw = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(chunk, pa.int32()), pa.array(raw, pa.binary())],
                                             names=["kind", "chunk", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for kind, chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                total[kind, chunk] = total.get((kind, chunk), 0) + np.frombuffer(raw.as_buffer(), np.uint32).astype(np.int64)
        for (kind, chunk), a in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([chunk], pa.int32()), pa.array([a.tobytes()], pa.binary())],
                                             names=["kind", "chunk", "counts"])
    schema = "kind int, chunk int, counts binary"
    parts = (rows.mapInArrow(tidy(count), schema).repartition(CHUNKS, "chunk").mapInArrow(tidy(add), schema).collect())
    out: list = [{} for _ in range(kinds)]
    for p in parts:  # bounded: kinds x chunks
        out[p.kind][p.chunk] = out[p.kind].get(p.chunk, 0) + np.frombuffer(p.counts, np.int64)
    return out


def joined(chunks: dict[int, np.ndarray], size: int) -> np.ndarray:
    total = np.zeros((CHUNKS, size // CHUNKS), np.int64)
    for c, a in chunks.items():
        total[c] = a
    return total.reshape(-1)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Learn from the labelled rows outside the held-out quarter. Without labels every score is the prior, 0.1."""
    small_batches(docs.sparkSession)
    rows = materialise(labelled(docs, labels, key, text), "toxicity-labelled")
    size = 1 << BITS

    def tokens(batches):
        toxic, every = np.zeros(size, np.int64), np.zeros(size, np.int64)
        extra = np.zeros(CHUNKS, np.int64)  # tokens in toxic documents, tokens
        for batch in batches:
            label = iter(batch.column(1).to_pylist())
            for part in shingles.pieces(batch.column(0)):
                ids, at = buckets(part)
                y = np.repeat(np.array([next(label) for _ in range(len(part))], dtype=bool), np.diff(at))
                for own in ids:
                    every += np.bincount(own, minlength=size)
                    toxic += np.bincount(own[y], minlength=size)
                extra[:2] += [int(y.sum()), len(y)]
        return toxic, every, extra

    learnt = summed(rows.where("_use = 0").select("_text", "_toxic"), tokens, 3)
    hit, n = joined(learnt[2], CHUNKS)[:2]
    model = Model((joined(learnt[0], size).astype(np.float32), joined(learnt[1], size).astype(np.float32)), float((hit + 1) / (n + 20)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def calibration(batches):
        clean = np.zeros(int((HIGH - LOW) / TOKEN_BIN), np.int64)
        best = np.zeros((2, LENGTHS, BINS), np.int64)
        for batch in batches:
            for y, (n, found, scores) in zip(batch.column(1).to_pylist(), each_text(shared.value, batch.column(0))):
                top = max((s for *_, s in found), default=0.0)
                best[int(bool(y)), length_bin(n), min(BINS - 1, math.ceil(top / STEP))] += 1
                if not y:
                    np.add.at(clean, ((scores - LOW) / TOKEN_BIN).astype(int).clip(0, len(clean) - 1), 1)
        return clean, best[0].reshape(-1), best[1].reshape(-1)

    seen = summed(rows.where("_use = 1").select("_text", "_toxic"), calibration, 3)
    clean = joined(seen[0], int((HIGH - LOW) / TOKEN_BIN))
    calm, toxic = (joined(seen[i], LENGTHS * BINS).reshape(LENGTHS, BINS) for i in (1, 2))
    rest = summed(rows.where("_use = 1").select("_text", "_toxic"), tokens, 3)
    more = joined(rest[2], CHUNKS)[:2]
    every = Model(tuple((joined(learnt[i], size) + joined(rest[i], size)).astype(np.float32) for i in (0, 1)),
                  float((hit + more[0] + 1) / (n + more[1] + 20)))
    return calibrated(every, clean, calm, toxic)


def length_bin(n: int) -> int:
    return min(LENGTHS - 1, int(2 * math.log2(n + 1)))


def calibrated(model: Model, clean: np.ndarray, calm: np.ndarray, toxic: np.ndarray) -> Model:
    """Lambda and K from clean texts, then the logistic curve from both; all from binned counts."""
    s = LOW + (np.arange(len(clean)) + 0.5) * TOKEN_BIN
    p = clean / max(1, clean.sum())
    if (p[s > 0] > 0).any() and (p * s).sum() < 0:
        lo, hi = 0.0, 1.0
        while (p * np.exp(hi * s)).sum() < 1 and hi < 64:
            lo, hi = hi, 2 * hi
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if (p * np.exp(mid * s)).sum() < 1 else (lo, mid)
        model.rate = max(hi, 1e-3)
    score = np.arange(BINS) * STEP
    length = 2.0 ** (np.arange(LENGTHS) / 2 + 0.25)
    reach = calm.sum(axis=0)[::-1].cumsum()[::-1]  # clean texts whose best segment has this score or more
    tail = int(np.argmax(reach <= max(1, 0.05 * calm.sum()))) if calm.sum() else 0
    expected = (calm.sum(axis=1) * length).sum() * math.exp(-model.rate * score[tail])
    if reach[tail] and expected:
        model.scale = float(reach[tail] / expected)
    x = np.minimum(model.evidence(np.broadcast_to(score, calm.shape), length[:, None]), 60.0).reshape(-1)
    w0, w1 = calm.reshape(-1).astype(float), toxic.reshape(-1).astype(float)
    a, b = 0.0, math.log((w1.sum() + 0.1) / (w0.sum() + 0.9))
    for _ in range(100):  # Newton steps with a small ridge
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -40, 40)))
        g = w1 - (w0 + w1) * q
        h = (w0 + w1) * q * (1 - q)
        m = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-2]])
        step = np.linalg.solve(m, np.array([(g * x).sum() - 1e-2 * a, g.sum()]))
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -2, 2))
    model.slope, model.offset = a, b
    return model


def passages(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep``, ``_score`` in 0..1 and ``_segments``: significant passages as tokens
    [start, end) with their score and expected number by chance (below 0.05). NULL is the empty text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, whole(text).alias("_text"))
    kind = "array<struct<start:int,end:int,score:double,by_chance:double>>"
    schema = rows.select(*keep, F.lit(0.0).alias("_score"), F.lit(None).cast(kind).alias("_segments")).schema

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        segment = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("by_chance", pa.float64())]))
        for batch in batches:
            best, count, found = [], [], []
            for n, own, _ in each_text(m, batch.column(batch.num_columns - 1)):
                best.append(max((s for *_, s in own), default=0.0))
                count.append(n)
                chance = [m.scale * n * math.exp(-m.rate * s) for *_, s in own]
                found.append([{"start": a, "end": b, "score": s, "by_chance": e} for (a, b, s), e in zip(own, chance) if e < 0.05])
            p = m.probability(np.array(best), np.array(count, float))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p, pa.float64()), pa.array(found, segment)],
                                             names=[*batch.schema.names[:-1], "_score", "_segments"])
    return rows.mapInArrow(tidy(score), schema)


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    p = passages(docs, fit(docs, labels, key, text), (key,), text)
    return p.select(key, held_out(F.col(key)).alias("held_out"), F.col("_score").alias("score"),
                    (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"), F.col("_segments").alias("segments"))


def clean(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    p = passages(docs.withColumn("_scored", F.col(text)), fit(docs, labels, key, text), tuple(docs.columns), "_scored")
    return p.where(F.col("_score") < THRESHOLD).select(*docs.columns)
