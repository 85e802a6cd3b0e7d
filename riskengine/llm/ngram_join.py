"""Near duplicates by an exact Jaccard self-join on five-word shingles, with adaptive multi-match prefixes.

Texts with equal sets form one class; only classes are joined.

1. A count sketch over all documents orders shingles from rare to frequent. The order
   only steers the cost; any order gives the same links.
2. With sets of n shingles and similarity t, two linked sets share at least ceil(t n)
   of the shingles of either. So their first n - ceil(t n) + k shingles share at least
   k. Each class picks its own k: a longer prefix reads more postings, but a partner
   has to be met k times before it is verified. k minimises estimated postings plus
   estimated candidates times the cost of a verification. A pair needs min(k, k') meetings.
3. Postings are dealt and sorted by shingle; a shingle of one class is dropped on the
   fly, so whatever its length, no list is ever held in memory.
4. Links in two passes. First each shingle's classes are verified against its most
   central class only (as many pairs as postings), and links give components. Then the
   shingles whose classes still lie in different components give the remaining pairs,
   only across components. Large groups of near copies thus never become all pairs,
   and no link between components is lost.
5. Verification intersects the two whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskengine.llm import components, shingles
from riskengine.llm.text import key_of, maybe_in, small_batches, tidy, whole, without
from riskengine.session import materialise

SIMILARITY = (3, 4)   # as a fraction, so that comparisons are exact
SKETCH_BITS = 20      # counters of the sketch: 4 MB a task, 1 MB of classes sent to the tasks
CHUNKS = 64
FILTER_BITS = 24      # bits of the filter on texts: 2 MB sent to the tasks
LONGEST = 6           # largest k considered


def sketch(texts: DataFrame, bits: int = SKETCH_BITS) -> np.ndarray:
    """How many sets hold a shingle of each bucket: exact sums over all rows, 2^bits counters."""
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for s in shingles.sets(batch.column(0)):
                np.add.at(total, (s >> np.uint64(64 - bits)).astype(np.int64), 1)
        if total.any():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(range(CHUNKS), pa.int32()), "counts": pa.array(
                [c.astype(np.uint32).tobytes() for c in np.split(total, CHUNKS)], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = np.frombuffer(raw.as_buffer(), np.uint32)
                total[chunk] = total.get(chunk, 0) + c.astype(np.int64)
        for chunk, c in total.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([c.tobytes()], pa.binary())})

    schema = "chunk int, counts binary"
    parts = texts.mapInArrow(tidy(count), schema).repartition(CHUNKS, "chunk").mapInArrow(tidy(add), schema).collect()
    out = np.zeros((CHUNKS, size // CHUNKS), np.int64)
    for p in parts:  # CHUNKS rows of bounded size
        out[p.chunk] += np.frombuffer(p.counts, np.int64)
    return out.reshape(-1)


def classes(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte per bucket: the counter's size class; and per class the estimated number of other sets.

    A bucket holds the noise of the shingles that share it; their mean is taken off.
    """
    noise = counts.sum() / len(counts)
    kind = np.floor(4 * np.log2(1 + counts)).clip(0, 255).astype(np.uint8)
    middle = 2.0 ** ((np.arange(256) + 0.5) / 4)
    return kind, np.maximum(middle - noise - 3 * math.sqrt(noise), 0) + noise / (noise + 8)


def least_overlap(n: int, similarity: tuple[int, int] = SIMILARITY) -> int:
    return -(-n * similarity[0] // similarity[1])


def prefix(s: np.ndarray, kind: np.ndarray, others: np.ndarray, bits: int = SKETCH_BITS,
           similarity: tuple[int, int] = SIMILARITY) -> tuple[np.ndarray, int]:
    """The prefix of a set under the global order, and its k."""
    n = len(s)
    own = kind[(s >> np.uint64(64 - bits)).astype(np.int64)].astype(np.uint64)
    key = np.sort((own << np.uint64(56)) | (s & np.uint64((1 << 56) - 1)))
    shortest = n - least_overlap(n, similarity)
    most = min(LONGEST, n - shortest)
    reads = np.cumsum(others[(key[:shortest + most] >> np.uint64(56)).astype(np.int64)])[shortest:]
    k = np.arange(1, most + 1)
    cost = reads + reads / k ** 2 * (1 + n / 64)
    best = int(k[np.argmin(cost)])
    return key[:shortest + best], best


def graph(df: DataFrame, text: str = "text", similarity: tuple[int, int] = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(documents, links): each row of ``df`` with ``_sig``, ``n_shingles`` and its columns other
    than the text; verified links between classes (a, b), a set that connects what the full
    set of links connects.

    NULL texts are empty; empty sets have ``_sig`` 0 and link with nothing. Repeated rows
    share a class.
    """
    spark = df.sparkSession
    small_batches(spark)
    texts = df.select(whole(text).alias("text"))
    bits = SKETCH_BITS
    kind, others = classes(sketch(texts, bits))
    shared = spark.sparkContext.broadcast((kind, others))

    others_cols = [c for c in df.columns if c != text]
    named = df.select(*others_cols, F.xxhash64(whole(text)).alias("_text_hash"), whole(text).alias("_text"))
    out_schema = named.drop("_text").schema.add("_sig", "long").add("n_shingles", "long").add("_k", "integer")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, others = shared.value
        for batch in batches:
            sig, n, k = [], [], []
            for s in shingles.sets(batch.column(batch.num_columns - 1)):
                sig.append(shingles.signature(s))
                n.append(len(s))
                k.append(prefix(s, kind, others, bits, similarity)[1] if len(s) else 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sig, pa.int64()), pa.array(n, pa.int64()), pa.array(k, pa.int32())],
                                             names=[*batch.schema.names[:-1], "_sig", "n_shingles", "_k"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, others = shared.value
        seen: set[int] = set()
        for piece in (p for batch in batches for p in shingles.pieces(batch.column(0))):
            keys, sigs = [], []
            for s in shingles.sets(piece):
                sig = shingles.signature(s)
                if sig and sig not in seen:  # a class posts once a task
                    seen.add(sig)
                    p = prefix(s, kind, others, bits, similarity)[0]
                    keys.append(p)
                    sigs.append(np.full(len(p), sig, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(sigs))], names=["key", "sig"])

    docs = materialise(named.mapInArrow(tidy(describe), out_schema), "ngram-documents")
    sorted_posts = texts.mapInArrow(tidy(post), "key long, sig long").repartition("key").sortWithinPartitions("key", "sig")
    posts = materialise(sorted_posts.mapInArrow(tidy(shared_only), "key long, sig long"), "ngram-postings")

    met = posts.groupBy("sig").agg(F.count("*").alias("met"))
    nodes = docs.where("_sig <> 0").groupBy(F.col("_sig").alias("sig")).agg(
        F.min("n_shingles").alias("n"), F.min("_k").alias("k"), F.min("_text_hash").alias("text_hash"))
    nodes = materialise(nodes.join(met, "sig").withColumn(
        "central", F.col("met") / (F.col("n") - F.ceil(F.col("n") * similarity[0] / similarity[1]) + F.col("k"))), "ngram-classes")

    info = materialise(posts.join(nodes.select("sig", "n", "k", "central"), "sig"), "ngram-postings")
    hubs = info.groupBy("key").agg(F.max(F.struct("central", -F.col("n"), "sig", "k")).alias("hub")).select(
        "key", F.col("hub.sig").alias("a"), (-F.col("hub.col2")).alias("n_a"), F.col("hub.k").alias("k_a"))
    size = {r: F.col(f"n_{r}") for r in "ab"}
    near = (F.least(*size.values()) * similarity[1] >= F.greatest(*size.values()) * similarity[0])
    enough = least_meetings(similarity)
    # each class is tried with the hub it meets most often; what that misses is left to the second pass
    star = (info.select("key", F.col("sig").alias("b"), F.col("n").alias("n_b"), F.col("k").alias("k_b")).join(hubs, "key")
            .where((F.col("a") != F.col("b")) & near).groupBy("b", "a").agg(
                F.count("*").alias("met"), *[F.min(c).alias(c) for c in ("n_a", "n_b", "k_a", "k_b")])
            .where(F.col("met") * 2 >= enough).groupBy("b").agg(F.max(F.struct("met", "a")).alias("m")).select(F.col("m.a").alias("a"), "b"))
    first = materialise(verified(star, nodes, named, similarity), "ngram-links")

    part = components.connected(first, info.select("sig").distinct())
    placed = info.drop("central").join(part.withColumnsRenamed({"node": "sig", "component": "part"}), "sig")
    mixed = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    # Of the m such shingles of a set, in one order for all sets, the first one that a pair shares is
    # followed in both sets by as many as the pair has to share: later ranks need no pair.
    whole_set = Window.partitionBy("sig")
    open_posts = materialise(placed.join(mixed, "key", "left_semi").withColumns({
        "rank": F.row_number().over(whole_set.orderBy("key")), "m": F.count("*").over(whole_set)}), "ngram-open")
    main = (open_posts.groupBy("key", "part").count().groupBy("key").agg(F.max(F.struct("count", "part")).alias("m"))
            .select("key", F.col("m.part").alias("main")))
    sides = {r: open_posts.select("key", *[F.col(c).alias(f"{c}_{r}") for c in ("sig", "n", "k", "part", "rank", "m")]) for r in "ab"}
    small = sides["a"].join(main, "key").where("part_a <> main")
    pairs = small.join(sides["b"], "key").where(
        (F.col("part_a") != F.col("part_b")) & near & (F.col("rank_a") <= F.col("m_a") - enough + 1) & (
            F.col("rank_b") <= F.col("m_b") - enough + 1) & ((F.col("part_b") == F.col("main")) | (F.col("sig_a") < F.col("sig_b"))))
    # the pair (a, b) of a key with its smaller sig first
    flip = F.col("sig_a") > F.col("sig_b")
    ordered = pairs.select(*[F.when(flip, F.col(f"{c}_{y}")).otherwise(F.col(f"{c}_{x}")).alias(f"{c}_{x}")
                             for c in ("sig", "n", "k") for x, y in ("ab", "ba")])
    prefixes = open_posts.groupBy("sig").agg(F.collect_list("key").alias("keys"))  # at most one prefix each
    one = {r: prefixes.select(F.col("sig").alias(f"sig_{r}"), F.col("keys").alias(f"keys_{r}")) for r in "ab"}
    wanted = ordered.distinct().join(one["a"], "sig_a").join(one["b"], "sig_b").where(
        F.size(F.array_intersect("keys_a", "keys_b")) >= enough).select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b"))
    second = materialise(verified(wanted, nodes, named, similarity), "ngram-links")
    return docs, first.unionByName(second)


def shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (key, sig) rows in order: the distinct ones of keys with two sigs or more."""
    held_key, held_sig, held_sent = None, None, False  # the last distinct row so far

    def out(keys, sigs):
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sigs, pa.int64())], names=["key", "sig"])

    for batch in batches:
        key, sig = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if not len(key):
            continue
        if held_key is not None:
            key, sig = np.concatenate([[held_key], key]), np.concatenate([[held_sig], sig])
        new = np.ones(len(key), dtype=bool)
        new[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
        key, sig = key[new], sig[new]
        same = key[1:] == key[:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        send = keep.copy()
        if held_key is not None and held_sent:
            send[0] = False
        if held_key is not None and held_sent and len(key) == 1:
            keep[0] = True
        held_key, held_sig, held_sent = key[-1], sig[-1], bool(keep[-1])
        if send.any():
            yield out(key[send], sig[send])


def least_meetings(similarity: tuple[int, int]) -> Column:
    """How many prefix shingles a pair (n_a, k_a, n_b, k_b) has to share to be similar enough.

    Let x be the set whose prefix ends first. All that both share up to there has been met; of
    the rest, x holds ceil(t n_x) - k_x. With the o shared shingles that the pair needs, it has to
    meet o - ceil(t n_x) + k_x. Never less than min(k_a, k_b), and far more for sets of like size.
    """
    p, q = similarity
    need = F.ceil((F.col("n_a") + F.col("n_b")) * p / (p + q))
    return F.least(*[need - F.ceil(F.col(f"n_{x}") * p / q) + F.col(f"k_{x}") for x in "ab"])


def verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough.

    Only texts of the pairs are needed, one of each class. A bitmap of their hashes keeps most
    other texts from being hashed and dealt out; a join makes the choice exact.
    """
    pairs = materialise(pairs, "ngram-pairs")
    ends = pairs.select(F.col("a").alias("sig")).unionByName(pairs.select(F.col("b").alias("sig"))).distinct()
    chosen = materialise(nodes.join(ends, "sig").select("sig", "text_hash"), "ngram-chosen")
    mask = (1 << FILTER_BITS) - 1
    slot = F.expr(f"(text_hash & {mask}) + 1")
    held = {r.b: r.m for r in chosen.groupBy(F.bitmap_bucket_number(slot).alias("b")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("m")).collect()}  # at most 2^FILTER_BITS bits
    shared = pairs.sparkSession.sparkContext.broadcast(held)

    def blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for b, m in shared.value.items():  # buckets of 2^15 bits, numbered from 1
            bitmap[(b - 1) << 12:b << 12] = np.frombuffer(m, np.uint8)
        seen: set[int] = set()
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False)
            keep = (bitmap[(hashes & mask) >> 3] >> (hashes & 7).astype(np.uint8) & 1).astype(bool)
            for i in np.flatnonzero(keep):
                keep[i] = hashes[i] not in seen
                seen.add(int(hashes[i]))
            some = batch.filter(pa.array(keep))
            for piece in shingles.pieces(some.column(1)) if len(some) else ():
                found = list(shingles.sets(piece))
                yield pa.RecordBatch.from_arrays([pa.array([shingles.signature(s) for s in found], pa.int64()),
                                                  pa.array([s.tobytes() for s in found], pa.binary())], names=["sig", "blob"])
    bodies = texts.select("_text_hash", "_text").mapInArrow(tidy(blobs), "sig long, blob binary").join(
        chosen.select("sig"), "sig", "left_semi").dropDuplicates(["sig"])
    bodies = materialise(bodies, "ngram-sets")
    one = {r: bodies.select(F.col("sig").alias(r), F.col("blob").alias(f"blob_{r}")) for r in "ab"}
    both = pairs.join(one["a"], "a").join(one["b"], "b").select("a", "b", "blob_a", "blob_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                joint = np.sort(np.concatenate([x, y]))
                common = int(np.count_nonzero(joint[1:] == joint[:-1]))
                ok.append(common * similarity[1] >= (len(x) + len(y) - common) * similarity[0])
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))
    return both.mapInArrow(tidy(check), "a long, b long")


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's ``key``, ``n_shingles`` and ``component_id``: the smallest key that links reach.

    A row without words is its own component; NULL keys never name a component unless all
    keys of it are NULL.
    """
    docs, links = graph(df.select(F.col(key).alias("_key"), F.col(text).alias("_text_in")), "_text_in")
    part = components.connected(links, None).select(F.col("node").alias("_sig"), "component")
    placed = docs.join(part, "_sig", "left").withColumn("_part", F.coalesce("component", "_sig"))
    names = placed.where("_sig <> 0").groupBy("_part").agg(F.min("_key").alias("component_id"))
    return placed.join(names, "_part", "left").select(
        F.col("_key").alias(key), "n_shingles",
        F.when(F.col("_sig") == 0, F.col("_key")).otherwise(F.col("component_id")).alias("component_id"))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest key.

    Rows without words stay. Of a repeated row one stays. Decisions travel as content
    numbers past a fixed-size bitmap, so the texts of most documents are not dealt out.
    """
    number = key_of(key, text)
    docs, links = graph(df.select(F.col(key).alias("_id"), number.alias("_c"), F.col(text).alias("_text_in")), "_text_in")
    part = components.connected(links, None).select(F.col("node").alias("_sig"), "component")
    placed = docs.where("_sig <> 0").join(part, "_sig", "left").select("_c", F.coalesce("component", "_sig").alias("part"), F.struct(
        F.col("_id").isNull().alias("unnamed"), F.col("_id"), F.col("_c")).alias("rank"))
    placed = materialise(placed, "ngram-parts")
    first = placed.groupBy("part").agg(F.min("rank").alias("best")).select("part", F.col("best._c").alias("stays"))
    decided = placed.join(first, "part")
    gone = materialise(decided.where("_c <> stays").select("_c").distinct(), "ngram-gone")
    many = materialise(decided.where("_c = stays").groupBy("_c").count().where("count > 1").select("_c"), "ngram-repeated")
    rest = without(df, key, text, gone)
    flagged = maybe_in(rest.withColumn("_key", number), "_key", many)
    again = flagged.where("_may").join(many.withColumnRenamed("_c", "_key").withColumn("_many", F.lit(True)), "_key", "left")
    unique = again.where("_many is null").select(*df.columns).unionByName(
        again.where("_many").dropDuplicates(["_key"]).select(*df.columns))
    return flagged.where("not _may").select(*df.columns).unionByName(unique)
