import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from riskengine.llm import ranked_search
from riskengine.llm.ranked_search import Best, Vocabulary


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain(docs, items, top=20):
    bags = [(k, Counter(words(t)), len(words(t))) for k, t in docs]
    bags = [b for b in bags if b[2]]
    n, total = len(bags), sum(b[2] for b in bags)
    df = Counter(t for b in bags for t in b[1])
    out = []
    for item, text in items:
        scored = []
        for k, bag, size in bags:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 12 * m)) for t in words(text))
            if s > 0:
                scored.append((-s, k is None, k or 0, k))
        out += [(item, r, k, -s) for r, (s, _, _, k) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def made(seed=1, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ärger", "été", "X9", "日本"]
    text = lambda k: " ".join(r.choices(vocabulary, weights=[1 / (i + 1) for i in range(44)], k=k))
    docs = [(i, text(r.randrange(1, 40))) for i in range(n)]
    docs += [(500 + i, docs[3][1]) for i in range(50)] + [(600 + i, docs[4][1].upper().replace(" ", "--")) for i in range(30)]  # copies, some reordered by id
    docs += [(3, docs[3][1]), (None, docs[5][1]), (None, docs[3][1]), (700, None), (701, ""), (702, "--- !"), (703, text(20_000)), (-1, "W1")]
    r.shuffle(docs)
    items = [(i, text(r.randrange(1, 30))) for i in range(8)] + [(8, None), (9, ""), (10, "unknown words only"), (0, docs[0][1] or "w1"), (None, "w1 w1 w2 ÄRGER"), (11, "w3 " * 500)]
    return docs, items


def run(spark, docs, items, **kw):
    d = spark.createDataFrame([(k, t, 1, "s", 2) for k, t in docs], "doc_id long, text string, rank int, score string, item_id int").repartition(4)
    i = spark.createDataFrame([(k, t, 9, "x") for k, t in items], "item_id long, text string, doc_id int, terms string")
    return sorted(map(tuple, ranked_search.search(d, i, **kw).collect()), key=str)


def test_results_equal_a_plain_search(spark):
    docs, items = made()
    want = plain(docs, items)
    assert run(spark, docs, items) == want


def test_items_in_many_blocks_and_small_arrays(spark, monkeypatch):
    docs, items = made(2)
    assert run(spark, docs, items, block_words=40) == plain(docs, items)
    assert run(spark, docs, items, top=3) == plain(docs, items, 3)


def test_empty_tables(spark):
    docs, items = made(3, 10)
    assert run(spark, [], items) == run(spark, docs, []) == run(spark, [(1, None)], items) == []


def test_classes_are_few_and_keep_the_first_members(spark):
    docs = [(i, "a b b" if i % 2 else "B a b") for i in range(300)] + [(400, "a b"), (401, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    words_ = Vocabulary([type("R", (), {"item": 1, "terms": ["a", "b", "zz"]})])
    vectors = ranked_search.counted(d, spark.sparkContext.broadcast(words_), "doc_id", "text")
    assert sorted((r.id, r.n) for r in vectors.collect()) == sorted((i, len(t.split())) for i, t in docs if t)
    bags = sorted(ranked_search.bags(vectors, 301, 902, 20).collect(), key=lambda r: r.ids)
    assert [r.ids for r in bags] == [list(range(20)), [400]]


def test_sums_beyond_exact_doubles_stay_exact(spark, monkeypatch):
    docs, items = made(4, 40)
    monkeypatch.setattr(ranked_search, "EXACT", 0)
    monkeypatch.setattr(ranked_search, "CELLS", 50)
    v = Vocabulary([type("R", (), {"item": k, "terms": words(t)}) for k, t in items if words(t)])
    number = {w.decode(): i for i, w in enumerate(v.words)}
    batch, weights = [], np.arange(1, len(v.words) + 1) * 977
    for k, t in docs:
        c = sorted((number[w], n) for w, n in Counter(words(t)).items() if w in number)
        if c:
            batch.append((90 + len(c), np.array(c, "<u4").T.tobytes(), [k]))
    m, body, ids = zip(*batch)
    held = {}

    class Frame:
        def mapInArrow(self, f, schema):
            for out in f([pa.RecordBatch.from_arrays([pa.array(m), pa.array(body, pa.binary()), pa.array(ids, pa.list_(pa.int64()))], names=["m", "body", "ids"])]):
                for r in out.to_pylist():
                    held.setdefault(r["item"], []).append((-r["score"], r["ids"][0] is None, r["ids"][0] or 0))
    ranked_search.ranked(Frame(), type("B", (), {"value": v}), weights, 5)
    for i, terms in enumerate([words(t) for k, t in items if words(t)]):
        want = []
        for mm, b, ii in batch:
            t, tf = np.frombuffer(b, "<u4").reshape(2, -1).astype(int).tolist()
            bag = dict(zip(t, tf))
            s = sum(int(weights[number[x]]) * (1_000_000_000 * bag[number[x]] // (1000 * bag[number[x]] + 12 * mm)) for x in terms if number[x] in bag)
            if s:
                want.append((-s, ii[0] is None, ii[0] or 0))
        assert held.get(i, []) == sorted(want)[:5]


def test_result_lists_keep_ties_by_first_member():
    best = Best(1, 2)
    best.add(np.array([[5], [5], [7]]), [[9], [4], [None]])
    best.add(np.array([[5], [0], [5]]), [[3], [1], [None]])
    assert best.score.tolist() == [7, 5] and best.ids == [[None], [3]]
