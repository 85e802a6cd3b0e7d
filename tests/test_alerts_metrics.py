import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskengine.operators import alerts, heat, metrics, ranking, rolling

SCORED = "transaction_id string, event_timestamp timestamp, fraud_probability double, is_fraud int"
DAY0 = datetime(2025, 6, 1)


def table(spark, scores, labels, hours=1, start=DAY0):
    rows = [(f"t{i:05d}", start + timedelta(hours=i * hours), s, y) for i, (s, y) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, SCORED)


def days(spark, n_days=5, per_day=200, ties=False, seed=42):
    r = random.Random(seed)
    rows = []
    for d in range(n_days):
        for i in range(per_day):
            s = r.choice([0.1, 0.2, 0.9]) if ties else r.random()
            rows.append((f"t{d}_{i:04d}", DAY0 + timedelta(days=d, seconds=r.randrange(0, 600) if ties else i * 300),
                         s, int(r.random() < 0.03)))
    return rows, spark.createDataFrame(rows, SCORED)


def expected_alerts(rows, budget):
    out = set()
    for day in {r[1].date() for r in rows}:
        mine = sorted((r for r in rows if r[1].date() == day),
                      key=lambda r: (-(r[2] if r[2] is not None and r[2] == r[2] else -math.inf), r[1], r[0]))
        out |= {r[0] for r in mine[:math.ceil(budget * len(mine))]}
    return out


@pytest.mark.parametrize("budget", [0.005, 0.1, 0.5, 1.0])
@pytest.mark.parametrize("ties", [False, True])
def test_daily_budget_picks_the_top_of_each_day(spark, budget, ties):
    rows, df = days(spark, ties=ties)
    got = {r["transaction_id"] for r in alerts.daily_alerts(df, budget).filter("alert").collect()}
    assert got == expected_alerts(rows, budget)


def test_zero_budget_and_missing_scores(spark):
    rows, df = days(spark, 1, 50)
    assert alerts.daily_alerts(df, 0.0).filter("alert").count() == 0
    odd = [(r[0], r[1], None if i % 3 == 0 else (float("nan") if i % 3 == 1 else r[2]), r[3]) for i, r in enumerate(rows)]
    got = alerts.daily_alerts(spark.createDataFrame(odd, SCORED), 0.5)
    assert got.count() == 50
    assert {r["transaction_id"] for r in got.filter("alert").collect()} == expected_alerts(odd, 0.5)


def test_alert_rate_respects_the_budget_on_round_days(spark):
    _, df = days(spark)
    for r in alerts.alert_day_stats(df, 0.005).collect():
        assert r["alert_rate"] <= 0.005 * 1.01


def test_threshold_for_budget(spark):
    df = table(spark, [i / 10 for i in range(1, 11)], [0] * 10)
    assert alerts.budget_threshold(df, 0.2).first()["threshold"] == 0.9
    assert alerts.budget_threshold(df, 0.0).first()["threshold"] == math.inf
    assert alerts.budget_threshold(df, 1.0).first()["threshold"] == 0.0
    tied = table(spark, [0.5] * 50 + [0.6] * 30 + [0.7] * 20, [0] * 100)
    t = alerts.budget_threshold(tied, 0.25).first()["threshold"]
    assert tied.filter(F.col("fraud_probability") >= t).count() / 100 <= 2.5 * 0.25


def test_daily_confusion_by_hand(spark):
    rows = [(DAY0 + timedelta(days=d), y, a) for d, ys, as_ in (
        (0, [1, 1, 0, 0, 0], [True, False, True, False, False]), (1, [1, 1, 1, 0, 0], [True, True, False, False, False]))
        for y, a in zip(ys, as_)]
    df = spark.createDataFrame(rows, "event_timestamp timestamp, is_fraud int, alert boolean").withColumn(
        "event_date", F.to_date("event_timestamp"))
    got = [tuple(r[c] for c in ("tp", "fp", "fn", "tn")) for r in metrics.daily_metrics(df).orderBy("event_date").collect()]
    assert got == [(1, 1, 1, 2), (2, 0, 1, 2)]


def test_precision_and_recall_by_hand(spark):
    df = table(spark, [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.0], [1] * 4 + [0] * 6)
    r = metrics.precision_at_budget(df, 0.30).first()
    assert (r["true_positives"], r["false_positives"], r["false_negatives"]) == (3, 0, 1)
    assert r["precision"] == 1.0 and r["recall"] == 0.75
    all_fraud = metrics.precision_at_budget(table(spark, [0.9, 0.8, 0.7, 0.6, 0.5], [1] * 5), 0.40).first()
    assert all_fraud["precision"] == 1.0 and all_fraud["recall"] == 0.40
    none = metrics.precision_at_budget(table(spark, [0.9, 0.8, 0.7, 0.6, 0.5], [0] * 5), 0.40).first()
    assert none["true_positives"] == 0 and none["precision"] == 0.0 and none["recall"] == 0.0


def test_unlabelled_rows_fall_in_no_cell(spark):
    r = metrics.confusion_at_threshold(table(spark, [0.9, 0.1, 0.8], [1, 0, None]), 0.5).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 0, 0, 1)


def test_cost_benefit_by_hand(spark):
    df = table(spark, [0.9 if i < 10 else 0.1 for i in range(100)], [int(i < 10) for i in range(100)], hours=0)
    r = metrics.cost_benefit(metrics.precision_at_budget(df, 0.10), 1000, 100).first()
    assert r["net_savings"] == 9000 and r["roi"] == 9.0


# A published seven-day run (n, alerts, tp, fp, fn, tn per day).
GOLDEN = [(3101, 16, 11, 5, 92, 2993), (3896, 20, 15, 5, 106, 3770), (3105, 16, 16, 0, 112, 2977),
          (3783, 19, 11, 8, 86, 3678), (3352, 17, 17, 0, 107, 3228), (2575, 13, 11, 2, 46, 2516),
          (2259, 12, 4, 8, 67, 2180)]


def golden(spark):
    rows = [(DAY0.date() + timedelta(days=i), *g, g[1] / g[0], g[2] + g[4], g[2] / (g[2] + g[3]), g[2] / (g[2] + g[4]))
            for i, g in enumerate(GOLDEN)]
    return spark.createDataFrame(rows, "event_date date, num_transactions long, num_alerts long, tp long, fp long, fn long, "
                                       "tn long, alert_rate double, total_fraud long, precision double, recall double")


def test_cumulative_metrics_of_the_published_days(spark):
    r = metrics.cumulative_metrics(golden(spark)).first()
    want = {"total_days": 7, "total_transactions": 22071, "total_fraud": 701, "total_alerts": 113, "total_caught": 85,
            "total_missed": 616, "total_false_positives": 28, "overall_precision": 0.7522123893805309,
            "overall_recall": 0.12125534950071326, "overall_alert_rate": 0.005119840514702551,
            "average_daily_precision": 0.7422763639868902, "std_daily_precision": 0.22058504810698645,
            "average_daily_recall": 0.12222605414459972, "std_daily_recall": 0.03759846119049332}
    for k, v in want.items():
        assert abs(r[k] - v) < 1e-12, k
    s = metrics.backtest_summary(golden(spark), 0.005).first()
    assert s["period"] == "2025-06-01 to 2025-06-07" and s["alert_budget_violations"] == 0
    assert abs(s["fraud_rate"] - 0.0317611345204114) < 1e-12
    assert metrics.budget_adherence(golden(spark), 0.005).count() == 0
    assert metrics.quota_adherence(golden(spark), 0.005).count() == 0


def pairwise_auc(rows):
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def stepwise_ap(rows):
    total, seen, hit, ap = sum(y for _, y in rows), 0, 0, 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        here = [y for t, y in rows if t == s]
        seen, hit = seen + len(here), hit + sum(here)
        ap += sum(here) / total * hit / seen
    return ap


@pytest.mark.parametrize("digits", [1, 6])
def test_ranking_metrics(spark, digits):
    r = random.Random(1)
    rows = [(round(min(1.0, max(0.0, r.gauss(0.6 if y else 0.4, 0.2))), digits), y) for y in (int(r.random() < 0.2) for _ in range(400))]
    got = metrics.ranking_metrics(table(spark, *zip(*rows))).first()
    assert abs(got["roc_auc"] - pairwise_auc(rows)) < 1e-9
    assert abs(got["pr_auc"] - stepwise_ap(rows)) < 1e-9


def test_recall_at_precision_is_the_best_one(spark):
    df = table(spark, [0.9, 0.8, 0.7, 0.6], [1, 0, 1, 1])
    got = {r["target_precision"]: (r["recall"], r["threshold"]) for r in metrics.recall_at_precision(df, [0.7, 0.9]).collect()}
    assert got[0.7] == (1.0, 0.6)
    assert got[0.9][1] == 0.9


def test_budget_curve_recall_rises(spark):
    r = random.Random(0)
    ys = [int(r.random() < 0.036) for _ in range(3000)]
    df = table(spark, [r.betavariate(8, 2) if y else r.betavariate(2, 8) for y in ys], ys, hours=0.01)
    curve = metrics.budget_curve(df).orderBy("alert_budget").collect()
    assert [c["alert_budget"] for c in curve] == metrics.BUDGETS
    assert all(a["recall"] <= b["recall"] for a, b in zip(curve, curve[1:]))
    best = metrics.best_budget(metrics.budget_curve(df), 0.7).first()
    assert best["alert_budget"] == max(c["alert_budget"] for c in curve if c["precision"] >= 0.7)
    assert metrics.cost_benefit(metrics.precision_at_budget(df)).first()["roi"] > 1


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)] + [(None,)], "v double")
    got = {r["quantile"]: r["value"] for r in ranking.exact_quantiles(df, "v", [0.0, 0.5, 0.95, 1.0]).collect()}
    assert got[0.0] == 1 and got[0.5] == 2.5 and got[1.0] == 4 and abs(got[0.95] - 3.85) < 1e-12


@pytest.mark.parametrize("edges", [[], [0.2, 0.21], None])
def test_edges_never_change_a_rank(spark, edges):
    rows, df = days(spark, 2, 100, ties=True)
    got = {(str(r["event_date"]), r["value"], r["left"]) for r in ranking.kth_largest(
        df.withColumn("event_date", F.to_date("event_timestamp")), ["event_date"], "fraud_probability",
        [("k", lambda n: F.lit(37))], edges=edges).collect()}
    want = set()
    for d in (0, 1):
        s = sorted((r[2] for r in rows if r[1].date() == (DAY0 + timedelta(days=d)).date()), reverse=True)
        want.add((str((DAY0 + timedelta(days=d)).date()), s[36], 37 - sum(x > s[36] for x in s)))
    assert got == want


@pytest.fixture
def tiny_buckets(spark):
    """Eight buckets of at most twenty distinct scores."""
    for k, v in ((ranking.BUCKETS_CONF, "8"), (ranking.BUCKET_ROWS_CONF, "20")):
        spark.conf.set(k, v)
    yield
    for k in (ranking.BUCKETS_CONF, ranking.BUCKET_ROWS_CONF):
        spark.conf.unset(k)


def many_scores(n=3000, seed=7):
    """Scores over all magnitudes, crowded ones, ties, and none."""
    r = random.Random(seed)
    kinds = (lambda: 10.0 ** r.uniform(-300, 300), lambda: -10.0 ** r.uniform(-300, 300), lambda: 0.5 + r.random() * 1e-12, lambda: 0.25,
             lambda: r.choice([None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0]))
    return [r.choice(kinds)() for _ in range(n)]


def clean(x):
    return float("-inf") if x is None or x != x else x


def test_large_buckets_are_cut_until_small_and_ranks_stay(spark, tiny_buckets):
    scores = many_scores()
    df = spark.createDataFrame([(i % 3, s) for i, s in enumerate(scores)], "g int, s double").repartition(5)
    wanted = [1, 2, 500, 501, 777, 998, 999, 1000]
    got = {(r.g, int(r.label)): (r.value, r.left) for r in ranking.kth_largest(df, ["g"], "s", [(str(k), lambda n, k=k: F.lit(k)) for k in wanted]).collect()}
    for g in range(3):
        own = sorted((clean(s) for s in scores[g::3]), reverse=True)
        for k in wanted:
            assert got[g, k] == (own[k - 1], k - sum(x > own[k - 1] for x in own)), (g, k)


def test_no_sort_holds_more_than_a_bucket_may(spark, tiny_buckets):
    scores = sorted({clean(s) for s in many_scores()})
    points = spark.createDataFrame([(0, s) for s in scores], "_bucket long, s double")
    while (cut := ranking.finer(points, ["_bucket"], "s")) is not None:
        points = cut
    rows = points.collect()
    sizes = Counter(r._bucket for r in rows)
    assert max(sizes.values()) <= 20 and len(rows) == len(scores)
    assert [r.s for r in sorted(rows, key=lambda r: (r._bucket, r.s))] == scores  # buckets keep the order


def test_curve_and_percentiles_with_tiny_buckets(spark, tiny_buckets):
    r = random.Random(1)
    rows = [(r.random() if r.random() < 0.8 else 0.5, int(r.random() < 0.2)) for _ in range(900)]
    df = spark.createDataFrame(rows, "s double, y int")
    for c in ranking.score_curve(df, "s", "y").collect():
        assert (c.n_above, c.pos_above) == (sum(x >= c.score for x, _ in rows), sum(y for x, y in rows if x >= c.score))
        assert (c.total_n, c.total_pos) == (900, sum(y for _, y in rows))
    got = {q.quantile: q.value for q in ranking.exact_quantiles(df, "s", [0.0, 0.3, 0.5, 0.99, 1.0]).collect()}
    assert all(abs(v - np.quantile([x for x, _ in rows], q)) < 1e-12 for q, v in got.items())


# -- online policy -------------------------------------------------------------

def fold(rows, budget, window=5000, min_scores=50, fallback=0.95):
    """The policy as a plain loop over one segment's rows in order."""
    recent, counts, out = [], {}, {}
    for tid, ts, score, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        recent = (recent + [score])[-window:]
        n = len(recent)
        limit = fallback if n < min_scores else sorted(recent, reverse=True)[max(1, min(math.ceil(budget * n), n)) - 1]
        c = counts.setdefault(ts.date(), [0, 0])
        c[0] += 1
        quota = max(1, int(c[0] * budget))
        alert = score >= limit and c[1] < quota
        out[tid] = (limit, c[0], quota, alert, score >= limit and not alert)
        c[1] += alert
    return out


@pytest.mark.parametrize("seed", range(5))
def test_kth_largest_of_last_equals_sorting_each_window(seed):
    r = np.random.default_rng(seed)
    n = int(r.integers(1, 400))
    s = r.choice([r.normal(size=n), np.round(r.normal(size=n), 1), np.zeros(n)][seed % 3:], axis=0) if seed < 2 else np.round(r.normal(size=n), 1)
    s[r.random(n) < 0.1] = -np.inf
    for window in (1, 7, 50, 1000):
        size = np.minimum(np.arange(1, n + 1), window)
        k = r.integers(1, size + 1)
        want = [np.sort(s[max(0, i - window + 1):i + 1])[-k[i]] for i in range(n)]
        assert rolling.kth_largest_of_last(s, window, k).tolist() == want
    assert rolling.kth_largest_of_last(np.zeros(0), 5, np.zeros(0, int)).tolist() == []


def test_issued_equals_the_loop():
    r = np.random.default_rng(3)
    for _ in range(50):
        n, done = int(r.integers(1, 80)), int(r.integers(0, 4))
        quota = np.maximum(done, np.cumsum(r.random(n) < 0.2)) + int(r.integers(0, 2))
        wanted, have, want = r.random(n) < 0.5, done, []
        for w, q in zip(wanted, quota):
            have += int(w and have < q)
            want.append(have)
        assert rolling.issued_so_far(wanted, quota, done).tolist() == want


@pytest.mark.parametrize("sliced", [False, True])
def test_online_policy_equals_the_loop(spark, sliced, monkeypatch):
    r = random.Random(5)
    rows = [(f"t{i:04d}", DAY0 + timedelta(minutes=r.randrange(0, 3 * 1440)), round(r.random(), 2), 0) for i in range(900)]
    df = spark.createDataFrame(rows, SCORED).withColumn("segment", F.lit("all"))
    profile = heat.KeyProfile(("all",), heat.HOT_ROWS, 3600 * 10**6) if sliced else heat.KeyProfile()
    if sliced:
        monkeypatch.setattr(alerts, "CHUNK", 150)
    scored = alerts.rolling_threshold(df, "segment", 0.02, window=120, profile=profile)
    got = alerts.sequential_budget(scored, "segment", budget=0.02, slice_us=3600 * 10**6 if sliced else None).collect()
    want = fold(rows, 0.02, 120)
    assert len(got) == len(rows)
    for g in got:
        assert (g["alert_threshold"], g["daily_count"], g["daily_budget"], g["should_alert"],
                g["budget_exceeded"]) == want[g["transaction_id"]], g


def test_risk_tiers(spark):
    df = spark.createDataFrame([(0.95,), (0.9,), (0.7,), (0.3,), (0.29,)], "s double")
    assert [r[0] for r in df.select(alerts.risk_tier("s")).collect()] == ["critical", "critical", "high", "medium", "low"]


def test_service_summary(spark):
    rows = [(DAY0 + timedelta(hours=i), float(i), i % 10 == 0, i % 25 == 0) for i in range(1, 101)]
    df = spark.createDataFrame(rows, "event_timestamp timestamp, latency_ms double, alert boolean, error boolean")
    r = metrics.service_summary(df).first()
    assert r["total_requests"] == 100 and r["total_alerts"] == 10 and abs(r["p50_latency_ms"] - 50.5) < 1e-9
    assert abs(r["p99_latency_ms"] - 99.01) < 1e-9 and r["error_count"] == 4 and r["avg_latency_ms"] == 50.5
    assert abs(r["requests_per_second"] - 100 / (99 * 3600)) < 1e-12
    last = [x for x in rows if x[0].date() == rows[-1][0].date()]
    assert r["daily_budget_utilization"] == sum(x[2] for x in last) / len(last)
    assert set(metrics.service_summary(df.limit(0)).first()) == {0}


def test_daily_service_metrics_as_a_stream(spark, tmp_path):
    from riskengine.streaming import policy, source
    r = random.Random(8)
    rows = [(DAY0 + timedelta(minutes=17 * i), r.random(), r.random() < 0.1, r.random() < 0.05, round(r.expovariate(0.05), 3) if r.random() < 0.9 else None)
            for i in range(400)]
    schema = "event_timestamp timestamp, fraud_probability double, alert boolean, error boolean, latency_ms double"
    for a in (0, 150, 300):
        spark.createDataFrame(rows[a:a + 150], schema).repartition(3).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = source.read_events(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, 1)
    out = str(tmp_path / "out")
    source.run_to_end(policy.daily_service_metrics(events), str(tmp_path / "cp"), lambda b, i: b.write.mode("overwrite").parquet(out), "complete")
    got = {x.event_date: x for x in spark.read.parquet(out).collect()}
    for day in {str(x[0].date()) for x in rows}:
        own = [x for x in rows if str(x[0].date()) == day]
        ms = [x[4] for x in own if x[4] is not None]
        g = got[day]
        assert (g.total_requests, g.total_alerts, g.error_count) == (len(own), sum(x[2] for x in own), sum(x[3] for x in own))
        for q in (50, 95, 99):
            assert abs(g[f"p{q}_latency_ms"] - np.percentile(ms, q)) < 1e-9
        assert abs(g.daily_budget_utilization - sum(x[2] for x in own) / len(own)) < 1e-12
        span = (max(x[0] for x in own) - min(x[0] for x in own)).total_seconds()
        assert abs(g.requests_per_second - len(own) / max(span, 1)) < 1e-12
