"""Training pipelines: features, label-aware split, anomaly stage, boosted trees, report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskengine.models.anomaly import IsolationForest, train_and_score
from riskengine.models.supervised import SupervisedModel, train_supervised
from riskengine.operators.alerts import BUDGET, SCORE
from riskengine.operators.metrics import (confusion_at_threshold, evaluation_report, ranking_metrics,
                                          recall_at_precision)
from riskengine.operators.ranking import score_curve
from riskengine.operators.split import (SplitDates, calculate_split, split_stats, temporal_split,
                                        validate_no_leakage, validation_tail)
from riskengine.session import materialise
from riskengine.sources.tables import write_report

TARGET_PRECISIONS = [0.5, 0.6, 0.7, 0.8, 0.9]


@dataclass
class Trained:
    dates: SplitDates
    forest: IsolationForest | None
    model: SupervisedModel
    test_scores: DataFrame
    report: DataFrame
    split: DataFrame
    thresholds: DataFrame = field(repr=False, default=None)
    confusion: DataFrame = field(repr=False, default=None)
    curve: DataFrame = field(repr=False, default=None)  # of the test scores


def checked_split(table: DataFrame, test_days: int = 30, buffer_hours: int = 1) -> tuple[SplitDates, DataFrame, DataFrame]:
    """Split dates, training and test rows; an error if anything leaks."""
    dates = calculate_split(table, test_days, buffer_hours)
    train, test = temporal_split(table, dates)
    validate_no_leakage(train, test, dates)
    return dates, train, test


def run_training(table: DataFrame, *, two_stage: bool = True, test_days: int = 30, buffer_hours: int = 1,
                 validation_share: float = 0.2, budget: float = BUDGET, output: str | None = None,
                 trees: int = 100, columns: list[str] | None = None,
                 parted: tuple[SplitDates, DataFrame, DataFrame] | None = None, **gbt) -> Trained:
    """Train on ``table`` (features, raw columns, label, times) and evaluate on its last days.

    Two stages add the anomaly score, learnt without labels, as one more column. ``parted`` is the
    :func:`checked_split` of the table, if made already.
    """
    spark = table.sparkSession
    dates, train, test = parted or checked_split(table, test_days, buffer_hours)
    forest = None
    if two_stage:
        forest, train = train_and_score(train, trees=trees)
        test = forest.score(test)
        if columns is not None:
            columns = [*columns, "anomaly_score"]
    labelled = train.filter(F.col("is_fraud").isin(0, 1))
    # boosting reads its rows many times: write them once
    fit_rows = materialise(validation_tail(labelled, validation_share), "train")
    model = train_supervised(fit_rows, columns, validation="is_validation", **gbt)
    keep = ("transaction_id", "event_timestamp", "is_fraud")
    scores = materialise(model.predict(test, keep), "scores")
    curve = score_curve(scores, SCORE, "is_fraud")
    report = evaluation_report(scores, budget, curve=curve)
    done = Trained(dates, forest, model, scores, report, split_stats(table, dates),
                   recall_at_precision(scores, TARGET_PRECISIONS, curve=curve), confusion_at_threshold(scores, 0.5), curve)
    if output:
        save_training(spark, done, output)
    return done


def save_training(spark: SparkSession, done: Trained, output: str) -> None:
    if done.forest is not None:
        done.forest.save(spark, f"{output}/forest")
    done.model.save(spark, f"{output}/model")
    write_report(done.report, f"{output}/report")
    write_report(done.model.importance(), f"{output}/importance")


def compare_stages(table: DataFrame, *, test_days: int = 30, buffer_hours: int = 1, **kw) -> DataFrame:
    """Ranking metrics of the single-stage and two-stage models, side by side, on one split."""
    parted = checked_split(table, test_days, buffer_hours)
    rows = None
    for name, two in (("single_stage", False), ("two_stage", True)):
        done = run_training(table, two_stage=two, parted=parted, **kw)
        m = ranking_metrics(done.test_scores, curve=done.curve)
        m = m.withColumn("model", F.lit(name))
        rows = m if rows is None else rows.unionByName(m)
    return rows
