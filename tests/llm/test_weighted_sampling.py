"""Collision rates against the generalised Jaccard similarity, and edited texts against slices."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from riskengine.llm import weighted_sampling as ws


def weights(text):
    w = [x for x in text.replace("\n", " ").split(" ") if x]
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_collision_rate_is_generalised_jaccard(spark):
    r = random.Random(3)
    rows = []
    for i in range(60):
        base = [f"w{r.randrange(30)}" for _ in range(r.choice([8, 40, 120]))]
        other = base[:int(len(base) * r.random())] * r.choice([1, 2, 3])
        rows.append((i, " ".join(base), " ".join(other + base[:r.randrange(20)])))
    df = spark.createDataFrame(rows, "i long, a string, b string")
    sig = {n: {x.i: x.signature for x in ws.signatures(df, ["i"], n, 48).collect()} for n in "ab"}
    gaps, truths = [], []
    for i, a, b in rows:
        truths.append(jaccard(weights(a), weights(b)))
        gaps.append(sum(x == y for x, y in zip(sig["a"][i], sig["b"][i])) / 48 - truths[-1])
    assert abs(sum(gaps) / len(gaps)) < 0.03 and max(map(abs, gaps)) < 0.3
    assert min(truths) < 0.2 and max(truths) > 0.6


def test_registered_samples_separate_three_quarters_from_a_half(spark):
    """Pairs of 200 shingles each, a share of them in common: errors of likeness() at the registered number of samples."""
    r = random.Random(5)
    rows, truths = [], []
    for i in range(120):
        w = [f"w{r.randrange(10**6)}" for _ in range(204)]
        same = 175 if i % 2 else 137
        rows.append((i, " ".join(w), " ".join(w[:same] + [f"v{r.randrange(10**6)}" for _ in w[same:]])))
        truths.append(jaccard(weights(rows[-1][1]), weights(rows[-1][2])))
    df = spark.createDataFrame(rows, "i long, a string, b string")
    a, b = (ws.signatures(df, ["i"], n, ws.SAMPLES).withColumnRenamed("signature", n) for n in "ab")
    got = {x.i: x.l for x in a.join(b, "i").select("i", ws.likeness(F.col("a"), F.col("b")).alias("l")).collect()}
    assert {round(t, 2) for t in truths} == {0.5, 0.75}
    assert (sum((got[i] - t) ** 2 for i, t in enumerate(truths)) / len(truths)) ** 0.5 < 0.055
    mixed = sum((got[i] >= 0.625) != (t > 0.7) for i, t in enumerate(truths))
    assert mixed <= 2


def test_draws_follow_their_distributions(spark):
    """a and the parts drawn given a: c and r are Gamma(2, 1), b is uniform, and neither pair is correlated."""
    import numpy as np
    n = 60_000
    t, k = F.xxhash64(F.col("id")), F.lit(5)
    more = F.xxhash64(t, k, F.lit(1))
    half = lambda i: (F.shiftrightunsigned(more, 32 * i).bitwiseAND((1 << 32) - 1) + F.lit(0.5)) / F.lit(float(1 << 32))
    x = spark.range(n).select(ws.exponential(ws.order(t, k)).alias("a"), (-F.ln(half(0))).alias("e"), (-F.ln(half(1))).alias("f")).toPandas()
    a, e, f = (x[c].to_numpy() for c in "aef")
    z = 1 + e / a
    c, r = a * z, np.log(z) + f
    b = 1 - np.log(z) / r
    gamma = lambda v: 1 - (1 + v) * np.exp(-v)
    for u in (1 - np.exp(-a), gamma(c), gamma(r), b):
        assert np.abs(np.sort(u) - (np.arange(n) + 0.5) / n).max() < 1.7 / np.sqrt(n)  # Kolmogorov's bound at 0.5 %
    pairs = np.corrcoef([gamma(c), gamma(r), b])
    assert np.abs(pairs[np.triu_indices(3, 1)]).max() < 0.015


def test_weights_agree_with_their_similarity(spark):
    """One term of weights v and w: agreement v / w; and a weight 1 by the short way equals the long way."""
    pairs = [(1, 1), (1, 2), (2, 3), (3, 10), (5, 6)]
    rows = [(i, v, w) for i in range(3000) for v, w in pairs]
    df = spark.createDataFrame(rows, "i int, v int, w int").withColumn("term", F.xxhash64("i"))
    for name, weight in (("of_v", F.col("v")), ("of_w", F.col("w")), ("of_1", F.lit(1))):
        df = ws.often(df, weight, F.lit(3), name)
    both = df.select("v", "w", (F.col("of_v") == F.col("of_w")).cast("int").alias("same"), (ws.once(ws.order(F.col("term"), F.lit(3))) == F.col("of_1")).alias("short"))
    got = {(x.v, x.w): (x.same, x.short) for x in both.groupBy("v", "w").agg(F.avg("same").alias("same"), F.min("short").alias("short")).collect()}
    for (v, w), (same, short) in got.items():
        assert abs(same - v / w) < 0.035 and short


def test_edited_texts_and_order(spark):
    r = random.Random(4)
    texts = ["", None, "é\U0001f600x" * 9, "one two three", "a b c d e f g " * 300] + [" ".join(f"w{r.randrange(90)}" for _ in range(r.randrange(90))) for _ in range(40)]
    rows = [(i * 5, t, "x") for i, t in enumerate(texts)]
    r.shuffle(rows)
    got = {x.doc_id: x for x in ws.fingerprints(spark.createDataFrame(rows, "doc_id long, text string, key string").drop("key")).collect()}
    ordered = [(i, t or "") for i, t, _ in sorted(rows)]
    assert len(got) == len(rows)
    for j, (i, t) in enumerate(ordered):
        after = ordered[(j + 1) % len(ordered)][1]
        q = len(t) // 4
        edited = t[:len(t) - q] + after[:q]
        x = got[i]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= x.near_edited <= 1 and x.near_next == (1 if t == after else x.near_next)
        assert (x.fingerprint == "") == (not weights(t))
        if edited == t:
            assert x.near_edited == 1 and x.fingerprint == x.edited_fingerprint


def test_repeated_null_and_empty(spark):
    schema = "doc_id long, text string"
    t = "a b c d e f g h i j"
    got = ws.fingerprints(spark.createDataFrame([(1, t), (1, t), (None, t), (2, None), (1, "z")], schema)).collect()
    assert len(got) == 5
    assert len({x.fingerprint for x in got if x.n_chars == len(t)}) == 1
    assert sorted(x.near_next for x in got if x.n_chars == len(t))[-1] == 1
    assert ws.fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = ws.fingerprints(spark.createDataFrame([(7, t)], schema)).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256((t[:-4] + t[:4]).encode()).hexdigest()


def test_signatures_of_both_equal_those_of_each(spark):
    """Terms in common, of other weights in the two texts, in one of them only, and texts of fewer words than a shingle."""
    r = random.Random(6)
    rows = [(0, "", "", None), (1, "a b", "", "x"), (2, "", "a b c d e f", "y"), (3, "a b c d e f g " * 9, "a b c d e f g", "z"), (4, "a b c", "a b c", "w")]
    for i in range(5, 60):
        base = [f"w{r.randrange(r.choice([6, 400]))}" for _ in range(r.randrange(120))]
        cut = r.randrange(len(base) + 1)
        rows.append((i, " ".join(base), " ".join(base[:cut] * r.choice([1, 1, 3]) + base[:r.randrange(9)]), f"note {i}"))
    df = spark.createDataFrame(rows, "i long, a string, b string, note string")
    each = {n: {x.i: x.signature for x in ws.signatures(df, ["i"], n, 20).collect()} for n in "ab"}
    got = ws.signatures_of_both(df, ["i"], ("a", "b"), ["note"], 20).collect()
    assert sorted((x.i, x.note) for x in got) == [(i, n) for i, _, _, n in rows]
    for x in got:
        assert x.own == each["a"].get(x.i, []) and x.changed == each["b"].get(x.i, [])


def test_signatures_are_not_dealt_out_to_meet_what_is_passed_on(spark):
    """Texts dealt out once by some of the keys: terms, minima and passed-on columns need no further exchange."""
    df = spark.createDataFrame([(i, i % 3, f"a b c d e f {i}", f"a b c d {i}") for i in range(20)], "i long, j long, a string, b string").repartition(3, "i")
    drawn = ws.signatures_of_both(df, ["i", "j"], ("a", "b"), ["j"], 8)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_fingerprints_draw_shared_terms_once(spark, monkeypatch):
    """Rows that are drawn for a text and its edited text: fewer than their terms together."""
    counted = []
    real = ws.drawn

    def spy(x, keys, samples):
        counted.append(x.where("term is not null").count())
        return real(x, keys, samples)
    monkeypatch.setattr(ws, "drawn", spy)
    texts = [" ".join(f"w{i}x{j}" for j in range(100)) for i in range(6)]
    assert ws.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), samples=8).count() == 6
    assert len(counted) == 1 and counted[0] < 6 * 96 * 1.5
