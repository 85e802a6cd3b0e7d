"""Near duplicates against all pairs; components against a plain union-find; prefixes for their promise."""

import random
import re

import numpy as np
import pyarrow as pa

from riskengine.llm import components, ngram_join, shingles

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(edges, nodes):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus(seed, n=260):
    """Copies, edited copies in chains, shared passages, tiny and empty texts."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([3, 5, 6, 40, 80, 200]))] for _ in range(25)]
    out = []
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        if r.random() < 0.2:
            w = w + passage
        bases.append(w) if r.random() < 0.1 else None
        out.append(r.choice([" ", "\n", "  "]).join(w) if r.random() < 0.97 else r.choice(["", " ", None]))
    return out


def test_near_duplicates_equal_all_pairs(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        rows = [(i * 3 + 1, t, "x") for i, t in enumerate(texts)]
        s = {i: plain_set(t) for i, t, _ in rows}
        links = [(a, b) for a in s for b in s if a < b and s[a] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
        want = plain_components(links, s)
        got = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component string")).collect()
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == {i: (len(s[i]), want[i]) for i in s}
        assert len(set(want.values())) < len(want)


def test_nulls_repeats_and_empty(spark):
    schema = "doc_id long, text string"
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (6, None), (6, ""), (None, None), (7, "A B C D E F")]
    got = ngram_join.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_shingles, x.component_id) for x in got if x.n_shingles) == [
        (False, 5, 2, 5), (False, 5, 2, 5), (False, 7, 2, 5), (True, 0, 2, 5)]
    assert sorted(str(x.component_id) for x in got if not x.n_shingles) == ["6", "6", "None"]
    assert ngram_join.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_prefixes_keep_their_promise():
    r = random.Random(3)
    counts = np.array([r.choice([0, 1, 2, 50]) for _ in range(1 << 8)] * 4)
    kind, others = ngram_join.classes(counts)
    seen = set()
    for _ in range(300):
        base = np.array([r.getrandbits(64) for _ in range(r.randrange(1, 60))], np.uint64)
        twin = base.copy()
        for _ in range(r.randrange(0, 6)):
            twin[r.randrange(len(twin))] = r.getrandbits(64)
        a, b = np.unique(base), np.unique(twin)
        common = len(np.intersect1d(a, b))
        if 4 * common >= 3 * (len(a) + len(b) - common):
            (p, k), (q, m) = (ngram_join.prefix(x, kind, others, bits=10) for x in (a, b))
            seen |= {k, m}
            assert len(np.intersect1d(p, q)) >= min(k, m)
    assert len(seen) > 1


def test_shared_only_across_batches():
    rows = [(1, 1), (1, 1), (2, 1), (2, 2), (2, 2), (2, 3), (3, 3), (4, 1), (4, 4), (5, 9)]
    for cut in range(1, 6):
        batches = [pa.RecordBatch.from_pydict({"key": [k for k, _ in rows[i:i + cut]], "sig": [s for _, s in rows[i:i + cut]]})
                   for i in range(0, len(rows), cut)]
        got = [(k, s) for b in ngram_join.shared_only(iter(batches)) for k, s in zip(b["key"].to_pylist(), b["sig"].to_pylist())]
        assert got == [(2, 1), (2, 2), (2, 3), (4, 1), (4, 4)], cut


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 120) if i % 30] + [(r.randrange(200, 400), r.randrange(200, 400)) for _ in range(90)] + [(7, 7)]
    nodes = sorted({x for e in edges for x in e})
    got = components.connected(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(n,) for n in [*nodes, 999]], "n long"))
    assert {x.node: x.component for x in got.collect()} == plain_components(edges, [*nodes, 999])


def test_sets_equal_plain_ones():
    texts = corpus(8, 80) + ["ab" * 700_000 + " x", "É é\x0bA  a\tB", "a", "abc def"]
    for t, s in zip(texts, shingles.sets(pa.array(texts))):
        assert len(s) == len(plain_set(t))
