import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from riskengine.llm import queries, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=3):
    """{row number: smallest reachable key} by comparing all pairs."""
    fp = [plain_fingerprint(t) if isinstance(t, str) or t is None else t for _, t in rows]
    return fp, reach([k for k, _ in rows], fp, radius)


def reach(keys, fp, radius=3):
    top = list(range(len(fp)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i
    for i in range(len(fp)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                top[root(i)] = root(j)
    groups = {}
    for i in range(len(fp)):
        groups.setdefault(root(i), []).append(keys[i])
    least = {r: min((k for k in ks if k is not None), default=None) for r, ks in groups.items()}
    return [least[root(i)] for i in range(len(fp))]


def test_texts_with_every_oddity_equal_brute_force(spark):
    r = random.Random(5)
    words = ["Alpha", "beta", "ÄRGER", "gamma,", "x" * 40, "delta\x85e", "日本", "a"]
    base = [" ".join(r.choices(words, k=r.randrange(1, 60))) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base * 3):
        w = t.split(" ")
        w[r.randrange(len(w))] = r.choice(words)
        rows.append((100 + i, " ".join(w)))
    long = " ".join(r.choices(words, k=30_000))
    rows += [(7, base[7]), (None, base[3]), (None, None), (300, ""), (301, " \t\r\n"), (302, None), (303, "a"), (304, "A  b"), (305, "\x0ba\tB\n"), (306, long), (307, long + " end")]
    df = spark.createDataFrame([(k, t, "f", 1, "p") for k, t in rows], "doc_id long, text string, fingerprint string, component_id long, part string").repartition(5)
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    fp, least = plain_components(rows)
    assert got == sorted(((k, f"{f:016x}", c) for (k, _), f, c in zip(rows, fp, least)), key=str)


def test_sparks_own_hash_gives_the_same_numbers(spark):
    texts = ["a b c", "Ünï cödé 日本", "x" * 100 + " y z", ""]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(F.xxhash64("t").alias("h")).collect()]
    assert [g % (1 << 64) for g in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def fingerprints(seed=1, n=400):
    """Chains at 3 bits, dense balls, and strangers."""
    r = random.Random(seed)
    out, centre = {0, (1 << 64) - 1}, r.getrandbits(64)
    for _ in range(n // 2):
        out.add(centre ^ sum({1 << r.randrange(64) for _ in range(r.randrange(9))}))
    for _ in range(n // 20):
        x = r.getrandbits(64)
        for _ in range(6):
            x ^= sum({1 << r.randrange(64) for _ in range(r.randrange(2, 5))})
            out.add(x)
    return sorted(out | {r.getrandbits(64) for _ in range(n // 5)})


def test_links_connect_what_all_pairs_connect_whatever_the_bucket_size(spark):
    fp = fingerprints()
    want = reach(fp, fp)
    signed = [simhash.signed(f) for f in fp]
    table = spark.createDataFrame([(s,) for s in signed], "fp long").withColumn("d", simhash.distances(F.col("fp")))
    for most in (40, 4096):  # 40: buckets are dealt again many times
        met = simhash.buckets(table, 3, most)
        assert met.groupBy("key").count().agg(F.max("count")).first()[0] <= most
        links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(table, 3, most).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in links)
        top = {f: f for f in fp}

        def root(x):
            while top[x] != x:
                x = top[x]
            return x
        for a, b in links:
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
        assert [root(f) for f in fp] == want


def test_parts_cover_all_bits_once():
    free = np.array([(1 << 64) - 1, 0b1011010, 0xFFFF << 30, 0xF], np.uint64)
    for f, *p in zip(free, *simhash.parts(free, 4)):
        assert sum(int(x) for x in p) == int(f) and np.bitwise_or.reduce(p) == f
        sizes = [int(x).bit_count() for x in p]
        assert max(sizes) - min(sizes) <= 1


def test_no_close_pair_fails_the_pivot_table(spark):
    """Distances to one reference never differ by more than the pair's own distance."""
    fp = np.array(fingerprints(2), np.uint64)
    d = np.bitwise_count(fp[:, None] ^ simhash.references()[None, :]).astype(int)
    rows = spark.createDataFrame([(simhash.signed(int(f)),) for f in fp], "fp long").withColumn("d", simhash.distances(F.col("fp"))).collect()
    assert {r.fp % (1 << 64): list(r.d) for r in rows} == {int(f): list(x) for f, x in zip(fp, d)}
    for i in range(len(fp)):
        own = np.bitwise_count(fp ^ fp[i])
        worst = np.abs(d - d[i]).max(axis=1)
        assert (worst <= own).all()
        assert worst[own > 20].min(initial=64) > 3  # strangers are discarded


def test_a_dense_bucket_gives_few_links(spark):
    r = random.Random(3)
    fp = sorted({sum({1 << (16 + r.randrange(48)) for _ in range(2)}) for _ in range(900)})
    table = spark.createDataFrame([(simhash.signed(f),) for f in fp], "fp long").withColumn("d", simhash.distances(F.col("fp")))
    assert simhash.links(table).count() <= 8 * len(fp)


def test_a_bucket_over_several_batches(spark):
    fp = fingerprints(4, 900)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(i, simhash.signed(f)) for i, f in enumerate(fp)], "doc_id long, fp long")
        links = simhash.links(df.select("fp", simhash.distances(F.col("fp")).alias("d"))).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    top = {f: f for f in fp}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in links:
        x, y = root(a % (1 << 64)), root(b % (1 << 64))
        top[max(x, y)] = min(x, y)
    assert [root(f) for f in fp] == reach(fp, fp)


def test_an_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_the_query_equals_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    fp, least = plain_components(rows)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op11_simhash_pivots"](spark, sf).collect()}
    assert got == {k: (f"{f:016x}", c) for (k, _), f, c in zip(rows, fp, least)}
