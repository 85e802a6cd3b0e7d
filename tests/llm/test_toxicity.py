"""Segments against their definition, and held-out accuracy."""

import random
import zlib

import numpy as np

from riskengine.llm import toxicity


def recursive(scores, shift=0):
    """The best segment, then the same left and right of it."""
    best = max(((sum(scores[i:j]), -(j - i), -i) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[2], -best[2] - best[1]
    return recursive(scores[:i], shift) + [(i + shift, j + shift, best[0])] + recursive(scores[j:], shift + j)


def test_segments_equal_the_definition():
    r = random.Random(1)
    for _ in range(300):
        scores = [r.choice([-3.0, -1.0, 1.0, 2.0, 4.0]) + r.random() for _ in range(r.randrange(0, 24))]
        got, want = toxicity.segments(np.array(scores)), recursive(scores)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        assert np.allclose([x[2] for x in got], [x[2] for x in want])


def test_held_out_accuracy(spark):
    r = random.Random(2)
    words, bad = [f"word{i}x" for i in range(300)], ["nasty", "vileword", "horrid"]
    docs, labels = [], []
    for i in range(1600):
        w = [r.choice(words) for _ in range(r.choice([5, 30, 200]))]
        y = int(r.random() < 0.2)
        for _ in range(3 * y):
            w.insert(r.randrange(len(w)), r.choice(bad) + r.choice(["", "ly", "er"]))
        docs.append((i, " ".join(w), "x"))
        labels.append((i, y, 7.0))
    docs += [(9001, None, "x"), (9002, "", None), (None, "nasty nasty", "x"), (3, docs[3][1], "x"), (9003, "nasty " * 5 + "word " * 100000, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, score double")
    got = toxicity.scored(d, lab).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 for x in got)
    truth = {i: y for i, y, _ in labels}
    test = [x for x in got if x.held_out and x.doc_id in truth]
    assert all(zlib.crc32(str(x.doc_id).encode()) % 4 == 2 for x in test) and len(test) > 200
    assert np.mean([x.predicted == truth[x.doc_id] for x in test]) > 0.95
    assert next(x for x in got if x.doc_id == 9001).predicted == 0
    kept = toxicity.clean(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(x.predicted == 0 for x in got)


def test_labels_of_held_out_rows_change_nothing(spark):
    d = spark.createDataFrame([(i, f"a{i % 7} b c{'bad' if i % 5 == 0 else ''}") for i in range(200)], "doc_id long, text string")
    lab = [(i, int(i % 5 == 0)) for i in range(200)]
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in lab]
    one, two = (sorted((x.doc_id, x.score) for x in toxicity.scored(d, spark.createDataFrame(x, "doc_id long, toxic int")).collect())
                for x in (lab, flipped))
    assert one == two


def test_empty(spark):
    d, lab = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.scored(d, lab).first().predicted == 0
    assert toxicity.scored(d.limit(0), lab).count() == 0
