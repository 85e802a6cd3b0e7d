"""Near duplicates by SimHash: exact links at a few differing bits, with pivot distance tables.

1. Fingerprints of 64 bits from three-word shingles, repeats included. Equal fingerprints form
   one class; only classes are paired.
2. A table holds the Hamming distances of each class to ``PIVOTS`` fixed reference fingerprints.
   Distances to one reference differ by no more than the distance of the pair, so a pair whose
   largest difference exceeds the radius is discarded without being compared.
3. Classes meet where the table is worth comparing. With r + 1 parts of the bits, a pair at r or
   fewer differing bits agrees in one part, so it meets in the bucket of that part. A bucket of
   more than ``MOST`` classes is dealt again by the parts of its other bits, for which the same
   holds, until all buckets are small: nothing is lost, whatever the size of a bucket.
4. In a bucket, sorted by the first distance, a class is tried with the following ones while
   that distance allows, then against the other references, then by its bits. Classes already
   connected within the bucket are not tried again, so a dense bucket gives about as many links
   as it has classes.

The links returned connect what the full set of links connects.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from riskengine.llm import components
from riskengine.llm.shingles import mix, pieces, word_places, _LOWER, _WORD
from riskengine.llm.text import small_batches, whole
from riskengine.session import materialise

WORDS, SEED, BITS, RADIUS = 3, 42, 64, 3
PIVOTS = 24     # reference fingerprints
MOST = 4096     # classes of a bucket that are compared in one place
HOT = 1000      # fingerprints with more than one in HOT rows: fewer than HOT of them
GROUP = 1 << 16  # shingles whose bits are counted at a time


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    """For each text the XXH64 of its shingles (words joined by one space, A-Z in lower case)."""
    # The words of all texts written one after another with one space behind each: a shingle is a slice.
    size = ends - starts
    new_start = np.concatenate([[0], np.cumsum(size + 1)])
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] = 1
    inside[ends] -= 1
    word = np.cumsum(inside[:-1]).astype(bool)
    text = np.full(int(new_start[-1]), 32, np.uint8)
    keep = np.ones(len(text), dtype=bool)
    keep[new_start[1:] - 1] = False
    text[keep] = _LOWER[data[word]]
    view, h = memoryview(text.tobytes()), xxhash.xxh64_intdigest
    lo, hi = new_start[:-1].tolist(), (new_start[1:] - 1).tolist()
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= WORDS:
            yield np.array([h(view[x:y], SEED) for x, y in zip(lo[a:b - WORDS + 1], hi[a + WORDS - 1:b])], np.uint64)
        elif b > a:
            yield np.array([h(view[lo[a]:hi[b - 1]], SEED)], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits set in over half of the numbers, as a signed number."""
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(h), GROUP):
        bits = np.unpackbits(h[i:i + GROUP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def fingerprinted(df: DataFrame, text: str = "text", name: str = "_fp") -> DataFrame:
    """The columns of ``df`` other than the text, and the fingerprint as a long. NULL is the empty text."""
    small_batches(df.sparkSession)
    rest = [c for c in df.columns if c != text]
    rows = df.select(*rest, whole(text).alias(text))
    schema = df.select(*rest).withColumn(name, F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [majority(h) for part in pieces(batch.column(batch.num_columns - 1)) for h in hashes(*word_places(part))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp, pa.int64())], names=[*batch.schema.names[:-1], name])
    return rows.mapInArrow(run, schema)


def references(n: int = PIVOTS) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def distances(fp: Column, pivots: int = PIVOTS) -> Column:
    """A fingerprint's row of the pivot table: one byte per reference."""
    return F.unhex(F.concat(*[F.lpad(F.hex(F.bit_count(fp.bitwiseXOR(F.lit(int(p.view(np.int64)))))), 2, "0") for p in references(pivots)]))


def signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def parts(free: np.ndarray, n: int) -> np.ndarray:
    """Each set of bits cut into n sets of nearly equal size: an array of n rows."""
    bits = np.unpackbits(free.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    place = (np.cumsum(bits, axis=1, dtype=np.int64) - 1) * n // np.maximum(1, bits.sum(axis=1, dtype=np.int64))[:, None]
    return np.stack([np.packbits(bits & (place == k), axis=1, bitorder="little").view(np.uint64)[:, 0] for k in range(n)])


def buckets(table: DataFrame, radius: int, most: int) -> DataFrame:
    """(key, fp, d): every two rows at ``radius`` or fewer differing bits share a key; no key has more than ``most`` rows."""
    most = max(most, 1 << radius)  # fewer rows than that cannot be split by radius + 1 parts

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, free, fp = (c.to_numpy().view(np.uint64) for c in batch.columns[:3])
            for part in parts(free, radius + 1):
                new = mix(mix(mix(key + np.uint64(1)) ^ part) ^ (fp & part))
                yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array((free & ~part).view(np.int64)), *batch.columns[2:]],
                                                 names=["key", "free", "fp", "d"])

    done = None
    rows = table.select(F.lit(0).cast("long").alias("key"), F.lit(-1).cast("long").alias("free"), "fp", "d")
    while True:
        dealt = materialise(rows.mapInArrow(deal, rows.schema), "simhash-buckets")
        # b free bits make 2^b fingerprints, so a bucket that is too large has bits left to split it by
        split = (F.col("count") > most) & (F.col("bits") > radius)
        counts = materialise(dealt.groupBy("key").agg(F.count("*").alias("count"), F.max(F.bit_count("free")).alias("bits")).where("count > 1"), "simhash-counts")
        small = dealt.join(counts.where(~split).select("key"), "key", "left_semi").select("key", "fp", "d")
        done = small if done is None else done.unionByName(small)
        large = counts.where(split).select("key")
        if large.isEmpty():
            return done
        rows = dealt.join(large, "key", "left_semi").select("key", "free", "fp", "d")


def links(table: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """(a, b): links of the fingerprints of ``table`` (fp, d) that connect all that are linked."""
    met = buckets(table, radius, most)
    # equal keys stay together; the first distance orders a bucket
    dealt = met.withColumn("first", F.conv(F.hex(F.substring("d", 1, 1)), 16, 10).cast("int")).repartition("key").sortWithinPartitions("key", "first", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64),
                    np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.int8))
            if held is not None:
                rows = tuple(np.concatenate(x) for x in zip(held, rows))
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0] == rows[0][-1], True))  # the last bucket may go on in the next batch
            held = tuple(x[cut:] for x in rows)
            yield from near(*(x[:cut] for x in rows), radius)
        if held is not None:
            yield from near(*held, radius)
    return dealt.select("key", "fp", "d").mapInArrow(run, "a long, b long")


def near(key: np.ndarray, fp: np.ndarray, d: np.ndarray, radius: int) -> Iterator[pa.RecordBatch]:
    """Links within the buckets of sorted rows: each row with the s-th after it, for s = 1, 2, ..."""
    n = len(key)
    top = np.arange(n)  # a row of the same component; the component's first row points at itself
    i, s = np.arange(n), 0
    found: list[np.ndarray] = []
    while True:
        s += 1
        i = i[i < n - s]
        i = i[(key[i + s] == key[i]) & (d[i + s, 0] - d[i, 0] <= radius)]
        if not len(i):
            break
        a = i[top[i] != top[i + s]]
        for c in range(1, d.shape[1]):
            if not len(a):
                break
            a = a[np.abs(d[a, c] - d[a + s, c]) <= radius]
        a = a[np.bitwise_count(fp[a] ^ fp[a + s]) <= radius]
        if len(a):
            found.append(np.stack([a, a + s]))
            joined(top, a, a + s)
    if found:
        pairs = fp[np.concatenate(found, axis=1)].view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])


def joined(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the components of a and b; afterwards every row points at its component's first row."""
    while True:
        x, y = top[a], top[b]
        if np.array_equal(x, y):
            break
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while True:
            jump = top[top]
            if np.array_equal(jump, top):
                break
            top[:] = jump


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Each row's ``key``, ``fingerprint`` (16 hexadecimal digits) and ``component_id``: the smallest key that links reach.

    NULL and empty texts and texts of white space have the fingerprint zero. A NULL key names a
    component only if it has no other. Repeated rows stay; other columns are not read.
    """
    docs = materialise(fingerprinted(df.select(F.col(key).alias("_key"), F.col(text).alias("_text_in")), "_text_in"), "simhash-documents")
    # one row per fingerprint; the rows of a frequent one are combined before they are dealt
    named = materialise(docs.groupBy(F.col("_fp").alias("fp")).agg(F.min("_key").alias("least"), F.count("*").alias("rows")), "simhash-classes")
    table = materialise(named.select("fp", distances(F.col("fp")).alias("d")), "simhash-pivots")
    part = components.connected(materialise(links(table, radius, most), "simhash-links"), None).select(
        F.col("node").alias("fp"), F.col("component").alias("part"))
    placed = named.join(part, "fp", "left").withColumn("part", F.coalesce("part", "fp"))
    names = placed.groupBy("part").agg(F.min("least").alias("component_id"))
    final = materialise(placed.join(names, "part").select(F.col("fp").alias("_fp"), "rows", "component_id"), "simhash-components")
    # fewer than HOT fingerprints hold more than one in HOT rows: their documents need no shuffle
    total = docs.count()
    hot = final.where(F.col("rows") * HOT > total).select("_fp", F.struct("component_id").alias("_hot"))
    rest = final.where(F.col("rows") * HOT <= total).select("_fp", "component_id")
    flagged = docs.join(F.broadcast(hot), "_fp", "left")
    out = flagged.where("_hot is not null").select("_key", "_fp", F.col("_hot.component_id").alias("component_id")).unionByName(
        flagged.where("_hot is null").drop("_hot").join(rest, "_fp").select("_key", "_fp", "component_id"))
    return out.select(F.col("_key").alias(key), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
