import math
import random

import numpy as np
from pyspark.sql import functions as F

from riskengine.llm import hard_negatives
from riskengine.llm.hard_negatives import Block, Mining

SCHEMA = "vec_id long, embedding array<float>, label int, name string, block int, score string"


def plain(rows, is_anchor, m=Mining()):
    """All products, straight from the definition."""
    use = [(i, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows
           if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    use = [(i, v, lab) for i, v, lab in use if sum((abs(x) + 2) ** 2 for x in v) < 2 ** 62]
    key = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for n, (i, v, lab) in enumerate(use):
        if i is None or not is_anchor(i):
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for k, (j, w, other) in enumerate(use) if k != n]
        for p, pid, _ in sorted((s for s in scored if s[2] == lab), key=key)[:m.positives]:
            inside = [s for s in scored if s[2] != lab and m.low[0] * p <= m.low[1] * s[0] <= m.low[1] * p]
            out += [(i, pid, r, s[1], p, s[0]) for r, s in enumerate(sorted(inside, key=key)[:m.negatives], 1)]
    return sorted(out, key=str)


def run(spark, rows, anchor, **kw):
    df = spark.createDataFrame([(*r, "n", 3, "s") for r in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, hard_negatives.mine(df, anchor=anchor, **kw).collect()), key=str)


def clustered(n, labels, dims, seed, copies=0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(4)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in r.choice(centres)], r.randrange(labels)) for i in range(n)]
    return rows + [(n + i, rows[0][1], r.randrange(2)) for i in range(copies)]


def test_blocks_of_every_size_equal_all_products(spark):
    rows = clustered(150, 4, 6, 1, copies=60)
    want = plain(rows, lambda i: i % 5 == 0)
    assert len(want) > 300
    for block_values in (6, 200, 1 << 21):
        assert run(spark, rows, F.col("id") % 5 == 0, block_values=block_values) == want


def test_oddities(spark):
    r = random.Random(2)
    rows = [(i, [round(r.uniform(-2, 2)) / 2 for _ in range(r.choice([3, 3, 2]))], r.randrange(3)) for i in range(60)]  # many ties
    rows += [(0, rows[0][1], rows[0][2]), (0, rows[0][1], rows[0][2]), (0, rows[1][1], rows[0][2])]  # repeated rows and ids
    rows += [(None, rows[0][1], 0), (None, rows[4][1], 1), (70, [], 0), (80, [0.0, 0.0, 0.0], 1), (90, [-0.0], 1)]
    rows += [(100, None, 1), (110, [1.0, None], 1), (120, [1.0, float("nan")], 1), (130, [float("inf")], 0), (140, [1.0], None),
             (150, [3e38, 1.0, 0.0], 1), (160, [2.0 ** 20, 1.0, 0.5], 1), (170, [-2.0 ** 20, 0.5, 0.5], 1), (-10, [1.0, 1.0, 1.0], 2)]
    want = plain(rows, lambda i: i % 10 == 0)
    assert run(spark, rows, F.col("id") % 10 == 0, block_values=40) == want
    assert run(spark, rows, F.col("id") % 10 == 0) == want


def test_every_row_may_be_an_anchor_with_other_windows(spark):
    rows = clustered(70, 2, 3, 4)
    m = Mining(positives=2, negatives=9, low=(1, 2))
    assert run(spark, rows, None, mining=m) == plain(rows, lambda i: True, m)


def test_one_label_or_no_rows(spark):
    assert run(spark, [(i, [1.0, float(i)], 1) for i in range(9)], F.col("id") % 2 == 0) == []
    assert run(spark, [], F.col("id") % 2 == 0) == []
    assert run(spark, [(0, [1.0], 1), (1, [0.9], 2)], F.col("id") == 0) == []  # no positive


def test_sorted_access_stops_early_and_misses_nothing():
    r = np.random.default_rng(1)
    n = 4000
    v = r.integers(-30, 30, (n, 4))
    v[:40] = r.integers(80, 120, (40, 4))
    block = Block([str(i) for i in range(n)], np.zeros(n, np.int64), [[i] for i in range(n)], list(v))
    met = 0
    table = block.floats

    class Counting(np.ndarray):
        def __getitem__(self, rows):
            nonlocal met
            if isinstance(rows, np.ndarray):
                met += len(rows)
            return np.asarray(super().__getitem__(rows))
    block.floats = table.view(Counting)
    (rows, scores), = block.search(np.array([100, 90, 80, 70]), np.ones(n, dtype=bool), [(None, None)], 5)
    own = v @ np.array([100, 90, 80, 70])
    first = np.lexsort((np.arange(n), -own))[:5]
    assert rows.tolist() == first.tolist() and scores.tolist() == own[first].tolist()
    assert met < n / 4


def test_a_wide_range_of_components_is_exact():
    big = [np.array([2 ** 29, 3, -1]), np.array([2 ** 29, 2, 5]), np.array([-2 ** 29, 2, 5])]
    block = Block(list("abc"), np.zeros(3, np.int64), [[0], [1], [2]], big)
    (rows, scores), = block.search(np.array([2 ** 29 + 1, 7, 1]), np.ones(3, dtype=bool), [(None, None)], 3)
    assert list(zip(rows, scores)) == [(0, 2 ** 29 * (2 ** 29 + 1) + 20), (1, 2 ** 29 * (2 ** 29 + 1) + 19), (2, -2 ** 29 * (2 ** 29 + 1) + 19)]
