"""Steps over the whole table that a job makes once, and results that do not depend on sharing them."""

import pytest
from pyspark.sql import functions as F

from riskengine import catalog
from riskengine.models import anomaly
from riskengine.operators import metrics, ranking, split
from riskengine.plans import training


@pytest.fixture
def calls(monkeypatch):
    counts = {}

    def counted(owner, name, *others):
        inner = getattr(owner, name)

        def call(*a, **kw):
            counts[name] = counts.get(name, 0) + 1
            return inner(*a, **kw)
        for o in (owner, *others):
            if hasattr(o, name):
                monkeypatch.setattr(o, name, call)
    counted(anomaly.IsolationForest, "raw_scores")
    counted(ranking, "score_curve", metrics, training)
    counted(split, "leakage_report")
    counted(metrics, "alert_cutoffs")
    return counts


def test_rows_walk_the_forest_once(spark, sf, calls):
    assert catalog.anomaly_top_precision(spark, sf).count() == 1
    assert calls["raw_scores"] == 1


def test_both_stages_share_split_and_curves(spark, sf, calls):
    """One leakage check; of each model one curve, and one set of cutoffs for all budgets; train and test walk once each."""
    assert catalog.stage_comparison(spark, sf).count() == 2
    assert calls == {"raw_scores": 2, "score_curve": 2, "leakage_report": 1, "alert_cutoffs": 2}


def table(spark, n, ids):
    i = F.col("id")
    return spark.range(n).select((i % ids).cast("string").alias("transaction_id"), F.when(i % 7 != 0, F.sin(i)).alias("x"), (i % 13 * i).cast("double").alias("y"))


@pytest.mark.parametrize("ids", [3, 10**6])
def test_scores_are_the_forests_own(spark, ids):
    """Missing values, and ids that repeat so often that no draw lies near the smallest ones."""
    df = table(spark, 900, ids)
    options = {"trees": 5, "sample": 16}
    forest = anomaly.train_forest(df, ["x", "y"], **options)
    again, scored = anomaly.train_and_score(df, ["x", "y"], keep=["transaction_id", "y"], **options)
    assert forest.nodes.equals(again.nodes) and (forest.low, forest.high) == (again.low, again.high)
    want = sorted((r.transaction_id, r.y, r.anomaly_score) for r in forest.score(df).collect())
    assert sorted(map(tuple, scored.collect())) == want
    by_array = forest.raw_scores(df, F.array("x", "y"), "a")
    assert forest.raw_scores(by_array, out="c").where("a <> c").count() == 0


def test_a_budget_beside_the_curve(spark):
    i = F.col("id")
    df = spark.range(400).select(i.cast("string").alias("transaction_id"), (i % 3 * 86400).cast("timestamp").alias("event_timestamp"),
                                 F.sin(i).alias("fraud_probability"), (i % 5 == 0).cast("int").alias("is_fraud"))
    got = {(r.section, r.metric): r.value for r in metrics.evaluation_report(df, 0.07, [0.01, 0.2]).collect()}
    alone = metrics.cost_benefit(metrics.precision_at_budget(df, 0.07)).first().asDict()
    assert {m: v for (s, m), v in got.items() if s == "budget"} == alone
    assert {s for s, _ in got} == {"ranking", "budget", "curve@0.01", "curve@0.2"}
