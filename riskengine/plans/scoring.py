"""Batch scoring and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskengine.models.anomaly import IsolationForest
from riskengine.models.supervised import SupervisedModel
from riskengine.operators.alerts import BUDGET, SCORE, daily_alerts, risk_tier
from riskengine.operators.features import build_features
from riskengine.operators.metrics import (backtest_summary, budget_adherence, cumulative_metrics,
                                          daily_metrics)
from riskengine.session import materialise
from riskengine.sources.etl import join_raw
from riskengine.sources.tables import unlabelled, write_report


def model_table(transactions: DataFrame, **profiles) -> DataFrame:
    """Features over the whole history, next to the raw columns of the same rows."""
    return join_raw(build_features(transactions, **profiles), transactions)


def score_table(table: DataFrame, model: SupervisedModel, forest: IsolationForest | None = None,
                keep: tuple[str, ...] = ("transaction_id",)) -> DataFrame:
    if forest is not None:
        table = forest.score(table)
    return model.predict(table, keep)


def score_unlabelled(transactions: DataFrame, model: SupervisedModel, forest: IsolationForest | None = None,
                     output: str | None = None) -> DataFrame:
    """(transaction_id, fraud_probability) of every unlabelled row.

    Features see the whole history; only then are the labelled rows dropped.
    """
    features = build_features(transactions)
    wanted = unlabelled(transactions)
    scores = score_table(join_raw(features, wanted), model, forest)
    if output:
        scores.write.mode("overwrite").parquet(output)
    return scores


def score_with_tiers(table: DataFrame, model: SupervisedModel, forest: IsolationForest | None = None,
                     keep: tuple[str, ...] = ("transaction_id", "event_timestamp")) -> DataFrame:
    return score_table(table, model, forest, keep).withColumn("risk_tier", risk_tier("fraud_probability"))


def run_backtest(scored: DataFrame, start: str, end: str, budget: float = BUDGET,
                 output: str | None = None) -> dict[str, DataFrame]:
    """Replay of the days in [start, end]: one job, since days do not depend on each other."""
    day = F.to_date("event_timestamp")
    rows = scored.filter((day >= F.lit(start).cast("date")) & (day <= F.lit(end).cast("date")))
    # scores may come from a model: what the replay reads is written once
    rows = materialise(rows.select("transaction_id", "event_timestamp", SCORE, "is_fraud"), "backtest")
    daily = materialise(daily_metrics(daily_alerts(rows, budget)), "daily")  # one row per day, read four times
    out = {"daily": daily, "cumulative": cumulative_metrics(daily),
           "violations": budget_adherence(daily, budget), "summary": backtest_summary(daily, budget)}
    if output:
        for name, df in out.items():
            write_report(df, f"{output}/{name}")
    return out
