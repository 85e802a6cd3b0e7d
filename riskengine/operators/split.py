"""Label-aware splits by time, and the proof that nothing leaks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from riskengine.functions.timing import DAY, HOUR, micros
from riskengine.operators.ranking import kth_largest
from riskengine.schema import require_columns


@dataclass(frozen=True)
class SplitDates:
    train_end_us: int
    test_start_us: int


def split_dates(df: DataFrame, test_days: int = 30, buffer_hours: int = 1,
                min_train_days: int = 7) -> DataFrame:
    """One row: data range, train end, test start, training days."""
    us = micros("event_timestamp")
    g = df.agg(F.min(us).alias("min_us"), F.max(us).alias("max_us"),
               F.count(F.when(us.isNull(), 1)).alias("null_times"))
    start = F.col("max_us") - test_days * DAY
    return g.select("min_us", "max_us", "null_times", (start - buffer_hours * HOUR).alias("train_end_us"),
                    start.alias("test_start_us"),
                    F.floor((start - buffer_hours * HOUR - F.col("min_us")) / DAY).alias("train_days"),
                    F.lit(min_train_days).alias("min_train_days"))


def calculate_split(df: DataFrame, test_days: int = 30, buffer_hours: int = 1,
                    min_train_days: int = 7) -> SplitDates:
    r = split_dates(df, test_days, buffer_hours, min_train_days).first()
    if r["null_times"]:
        raise ValueError("event_timestamp contains NULL")
    if r["max_us"] is None or r["train_days"] < min_train_days:
        raise ValueError(f"training window too small: {r['train_days']} days")
    return SplitDates(r["train_end_us"], r["test_start_us"])


def temporal_split(df: DataFrame, dates: SplitDates) -> tuple[DataFrame, DataFrame]:
    """Train: before the buffer and label known before the test window. Test: the window."""
    require_columns(df, "event_timestamp", "label_available_timestamp", "is_fraud")
    us, label = micros("event_timestamp"), micros("label_available_timestamp")
    train = df.filter((us < dates.train_end_us) & (label < dates.test_start_us))
    return train, df.filter(us >= dates.test_start_us)


def split_sets(df: DataFrame, dates: SplitDates):
    """The split as a column: train, test or excluded."""
    us, label = micros("event_timestamp"), micros("label_available_timestamp")
    return (F.when(us >= dates.test_start_us, "test")
            .when((us < dates.train_end_us) & (label < dates.test_start_us), "train")
            .otherwise("excluded"))


def split_stats(df: DataFrame, dates: SplitDates, min_labelled: float = 0.80) -> DataFrame:
    """Rows, labels and frauds of each set; ``enough_labels`` is the warning."""
    g = df.groupBy(split_sets(df, dates).alias("split")).agg(
        F.count(F.lit(1)).alias("n"), F.count("is_fraud").alias("labelled"),
        F.count(F.when(F.col("is_fraud") == 1, 1)).alias("frauds"),
        F.count(F.when(F.col("is_fraud") == 0, 1)).alias("legit"))
    return g.withColumn("enough_labels", F.col("labelled") / F.col("n") >= min_labelled)


def id_overlap(a: DataFrame, b: DataFrame, key: str = "transaction_id") -> DataFrame:
    return a.select(key).intersect(b.select(key))


def leakage_report(train: DataFrame, test: DataFrame, dates: SplitDates) -> DataFrame:
    """(check, violations): time overlap, late labels, shared ids."""
    first = test.agg(F.min(micros("event_timestamp")).alias("_t"))
    us, label = micros("event_timestamp"), micros("label_available_timestamp")
    counts = train.crossJoin(F.broadcast(first)).agg(  # one row
        F.count(F.when(us >= F.col("_t"), 1)).alias("time_overlap"),
        F.count(F.when(label >= dates.test_start_us, 1)).alias("late_labels"))
    shared = id_overlap(train, test).agg(F.count(F.lit(1)).alias("shared_ids"))
    row = counts.crossJoin(F.broadcast(shared))
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("check"), F.col(c).alias("violations"))
        for c in ("time_overlap", "late_labels", "shared_ids")])).alias("c")).select("c.*")


def validate_no_leakage(train: DataFrame, test: DataFrame, dates: SplitDates) -> bool:
    bad = leakage_report(train, test, dates).filter("violations > 0").collect()  # three rows at most
    if bad:
        raise ValueError("leakage: " + ", ".join(f"{r['check']}={r['violations']}" for r in bad))
    return True


def validation_tail(train: DataFrame, share: float = 0.2, flag: str = "is_validation") -> DataFrame:
    """Flag the latest ``share`` of the rows, cut at an exact event time."""
    rows = train.withColumn("_t", micros("event_timestamp").cast("double"))
    cut = kth_largest(rows, [], "_t", [("k", lambda n: F.greatest(F.lit(1), F.floor(n * F.lit(share))))])
    cut = cut.select(F.col("value").alias("_cut"))  # one row
    return (rows.crossJoin(F.broadcast(cut)).withColumn(flag, F.col("_t") >= F.col("_cut"))
            .drop("_t", "_cut"))


