"""Benchmark items inside documents: size-partitioned MinHash containment search, native Spark only.

The i-th smallest shingle hash of an item is a uniform sample of its shingles, so a
document that contains a share c of the item holds each of them with chance c, however
long the document is. Items are partitioned by their number of shingles n, and each
partition keeps the k = n - ceil(t n) + 1 smallest hashes of its items: a document with
containment t or more misses at most n - ceil(t n) shingles, so it holds one of the k,
and no contained item is ever lost. Longer documents need no larger sketches.

Documents stream past a hash join with the sketches; only documents with a hit are then
read again and verified by exact containment of the shingle strings. Shingles have five
words; items with fewer words are one shingle of their own width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskengine.llm.text import key_of, maybe_in, whole, without
from riskengine.session import materialise

WIDTH = 5
CONTAINMENT = (3, 4)  # as a fraction
GAP = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), GAP), lambda w: w != "")


def starts(w: Column, width: int) -> Column:
    return F.when(F.size(w) >= width, F.sequence(F.lit(0), F.size(w) - width)).otherwise(F.array().cast("array<int>"))


def grams(w: Column, width: int) -> Column:
    """The shingles as text."""
    return F.transform(starts(w, width), lambda i: F.array_join(F.slice(w, i + 1, width), " "))


def gram_hashes(h: Column, width: int) -> Column:
    """The same shingles as numbers, from the hashes of their words."""
    return F.transform(starts(h, width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)], F.lit(width)))


def item_table(items: DataFrame, key: str = "item_id", text: str = "text", containment=CONTAINMENT) -> DataFrame:
    """item, width, n, its shingles, and its sketch; items without words are left out as nothing contains them."""
    w = items.select(F.col(key).alias("item"), words(whole(text)).alias("w")).where((F.size("w") > 0) & F.col("item").isNotNull())
    w = w.withColumn("width", F.least(F.lit(WIDTH), F.size("w"))).withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    pick = lambda f, c: F.coalesce(*[F.when(F.col("width") == k, F.array_distinct(f(F.col(c), k))) for k in range(1, WIDTH + 1)])
    t = w.select("item", "width", pick(grams, "w").alias("grams"), F.array_sort(pick(gram_hashes, "h")).alias("hashes"))
    t = t.withColumn("n", F.size("grams").cast("long"))
    k = (F.col("n") - F.ceil(F.col("n") * containment[0] / containment[1]) + 1).cast("int")
    return t.select("item", "width", "n", "grams", F.slice("hashes", 1, k).alias("sketch"))


def contained(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", containment=CONTAINMENT) -> DataFrame:
    """Rows (key, _key, item_id, n_item, n_shared, containment) of every document and item it contains.

    NULL and empty texts contain nothing; a repeated row or item gives repeated results. Items
    without an id cannot be named and are left out; NULL keys are kept.
    """
    table = materialise(item_table(items, containment=containment), "benchmark-items")
    index = table.select("width", F.explode("sketch").alias("hash"), "item").distinct()
    widths = sorted(r.width for r in table.select("width").distinct().collect())  # at most WIDTH numbers
    base = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"), key_of(key, text).alias("_key"))

    hashed = base.select("_key", F.transform(words(whole("text")), lambda x: F.xxhash64(x)).alias("h"))
    lists = [gram_hashes(F.col("h"), k) for k in widths]
    stream = hashed.select("_key", F.explode(F.concat(*lists) if lists else F.array().cast("array<bigint>")).alias("hash"))
    # the width is part of what is hashed, so the hash alone finds the item
    hits = stream.join(index.drop("width"), "hash").groupBy("_key", "item").count().groupBy("_key").agg(
        F.collect_list("item").alias("items"))
    found = materialise(hits, "benchmark-candidates")

    near = maybe_in(base, "_key", found.select("_key")).where("_may").join(found, "_key")
    shingles = near.withColumn("w", words(whole("text")))
    for k in widths:
        shingles = shingles.withColumn(f"g{k}", grams(F.col("w"), k))
    pairs = shingles.select("doc", "_key", *[f"g{k}" for k in widths], F.explode("items").alias("item"))
    both = pairs.join(table.drop("sketch"), "item")
    own = F.coalesce(*[F.when(F.col("width") == k, F.col(f"g{k}")) for k in widths]) if widths else F.array().cast("array<string>")
    shared = F.size(F.array_intersect("grams", own)).cast("long")
    return both.withColumn("n_shared", shared).where(F.col("n_shared") * containment[1] >= F.col("n") * containment[0]).select(
        F.col("doc").alias(key), "_key", F.col("item").alias("item_id"), F.col("n").alias("n_item"), "n_shared",
        (F.col("n_shared") / F.col("n")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that contain no item; all their columns."""
    found = materialise(contained(docs, items, key, text).select("_key").distinct(), "benchmark-found")
    return without(docs, key, text, found)
