"""Exponents against closed forms, and plans against a plain loop."""

import hashlib
import math
import random
from collections import Counter, defaultdict

from riskengine.llm import mixing
from riskengine.llm.mixing import Target

SCHEMA = "doc_id long, text string, source string, n int"


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def case(seed=1):
    r = random.Random(seed)
    sizes = {"a": 300, "b": 60, "c": 25, None: 9}
    rows = [(s, " ".join("w" for _ in range(r.randrange(0, 30)))) for s, n in sizes.items() for _ in range(n)]
    r.shuffle(rows)
    return [(i, t, s, 0) for i, (s, t) in enumerate(rows)]


def plain(rows, exponent, budget=None, block_tokens=mixing.BLOCK_TOKENS):
    total = Counter()
    for _, t, s, _ in rows:
        total[s] += len((t or "").split()) + 1
    a, p = exponent / 1e6, {s: n / sum(total.values()) for s, n in total.items()}
    z, top = sum(x ** a for x in p.values()), max(p, key=p.get)
    budget = total[top] * z / p[top] ** a if budget is None else budget
    blocks = max(1, -(-round(budget) // block_tokens))
    out = []
    for s in total:
        quota = round(p[s] ** a / z * budget)
        own, at, epoch = [(i, len((t or "").split()) + 1) for i, t, x, _ in rows if x == s], 0, 0
        while at < quota:
            for _, i, n in sorted((number(mixing.SEED, epoch, i), i, n) for i, n in own):
                if at < quota:
                    out.append((math.floor(at / quota * blocks), number(mixing.SEED + 1, epoch, "s" + s if s is not None else "", i), i, epoch, s, n))
                at += n
            epoch += 1
    slot, got = defaultdict(int), []
    for b, _, i, e, s, n in sorted(out, key=lambda x: x[:4]):
        slot[b] += 1
        got.append((i, s, e, b, slot[b], n))
    return sorted(got, key=str)


def test_plan_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE_ROWS", 20)
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 700)
    rows = case()
    df = spark.createDataFrame(rows, SCHEMA)
    for target in (Target(2.5), Target(1.0), Target(1000.0), Target(None, 0.9), Target(1.5, None, 900)):
        got = sorted((tuple(x)[:6] for x in mixing.plan(df, target).collect()), key=str)
        sources = defaultdict(int)
        for _, t, s, _ in rows:
            sources[s] += len(t.split()) + 1
        p = sorted(x / sum(sources.values()) for x in sources.values())
        if target.repeat:
            e = max(0, math.ceil(1e6 * (1 - math.log(target.repeat) / math.log(p[-1] / p[0]))))
        else:
            h = lambda a: -sum((w := x ** a / sum(y ** a for y in p)) * math.log(w) for x in p) / math.log(len(p))
            e = bisect_entropy(h, target.entropy)
        assert got == plain(rows, e, target.budget, 700)
        if target.budget is None:
            uses = Counter(x[0] for x in got)
            assert set(uses) == {r[0] for r in rows} and max(uses.values()) <= math.ceil(target.repeat or 99)


def bisect_entropy(h, goal):
    lo, hi = 0, 10**6
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if h(mid / 1e6) >= goal else (lo, mid)
    return lo


def test_mix_repeats_rows_as_planned(spark):
    rows = case(2) + [(3, "same text", "c", 1)] * 3 + [(None, None, "c", None), (None, "", "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_tokens int")
    want = Counter((x.doc_id, x.source) for x in mixing.plan(df, Target(3.0)).collect())
    got = mixing.mix(df, Target(3.0))
    assert got.columns == df.columns
    assert Counter((x.doc_id, x.source) for x in got.collect()) == want
    assert set(got.collect()) == set(df.collect())


def test_empty_and_single_source(spark):
    df = spark.createDataFrame([(1, "a b", "x", 0), (2, None, "x", 0)], SCHEMA)
    assert mixing.plan(df.limit(0)).count() == 0 and mixing.mix(df.limit(0)).count() == 0
    assert sorted(x.n_tokens for x in mixing.plan(df).collect()) == [1, 3]
