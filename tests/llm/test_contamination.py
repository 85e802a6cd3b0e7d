"""Contained items against plain sets."""

import random
import re

from riskengine.llm import contamination


def grams(text, width):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if x]
    return {tuple(w[i:i + width]) for i in range(len(w) - width + 1)}


def plain(docs, items):
    out = []
    for d, t in docs:
        for i, q in items:
            w = [x for x in re.split(r"[\x20\x09-\x0D]+", (q or "").lower()) if x]
            if w and i is not None:
                s = grams(q, min(5, len(w)))
                k = len(s & grams(t, min(5, len(w))))
                if 4 * k >= 3 * len(s):
                    out.append((d, i, len(s), k))
    return sorted(out, key=str)


def case():
    r = random.Random(2)
    word = lambda: f"w{r.randrange(400)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([1, 2, 4, 5, 6, 12, 40, 40, 60])]
    items += [(20, items[6][1]), (21, ""), (22, None), (None, "a b c d e f"), (23, "x y " * 8)]
    docs = []
    for d in range(150):
        w = [word() for _ in range(r.choice([0, 3, 50, 400]))]
        for _ in range(r.randrange(3)):
            q = r.choice(items)[1] or ""
            q = q.split()
            for _ in range(r.choice([0, 0, 1, 2])):
                if q:
                    q[r.randrange(len(q))] = "zz"
            at = r.randrange(len(w) + 1)
            w[at:at] = q
        docs.append((d, r.choice([" ", "\n "]).join(w).upper() if d % 9 == 0 else " ".join(w)))
    return docs + [(200, None), (201, ""), (None, items[7][1]), (5, items[7][1]), (5, items[7][1])], items


def test_contained_equals_plain_sets(spark):
    docs, items = case()
    d = spark.createDataFrame([(*x, "en") for x in docs], "doc_id long, text string, item string")
    q = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.contained(d.drop("item"), q).select("doc_id", "item_id", "n_item", "n_shared").collect()
    want = plain(docs, items)
    assert sorted(map(tuple, got), key=str) == want and len(want) > 40
    clean = contamination.decontaminate(d, q)
    dirty = {(x[0]) for x in want if x[0] != 5} | {None}
    assert sorted((x.doc_id is None, x.doc_id, x.text) for x in clean.collect()) == sorted(
        (i is None, i, t) for i, t in docs if i not in dirty and t != items[7][1] and not any(g[0] == i for g in plain([(i, t)], items)))
    assert clean.columns == d.columns


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination.contained(d.limit(0), q).count() == 0
    assert contamination.contained(d, q.limit(0)).count() == 0
    assert contamination.decontaminate(d, q.limit(0)).count() == 1
    assert contamination.decontaminate(d, q).count() == 0
