"""Budgeted alerting: daily top-k, thresholds, rolling and sequential budgets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from riskengine.functions.timing import SECOND, event_date, micros
from riskengine.operators.heat import (HOT_ROWS, KeyProfile, profile_keys, row_ranks, row_running)
from riskengine.operators import rolling
from riskengine.operators.ranking import clean_score, kth_largest, reaches
from riskengine.session import materialise

BUDGET = 0.005
SCORE = "fraud_probability"
# Fixed values of the online policy and of the tiers.
FALLBACK_THRESHOLD = 0.95
MIN_SCORES = 50
RECENT_SCORES = 5000
TIERS = {"critical": 0.9, "high": 0.7, "medium": 0.3}


def risk_tier(score: Column | str) -> Column:
    """NULL and NaN scores are low."""
    return F.coalesce(*[F.when(reaches(score, bound), tier) for tier, bound in TIERS.items()], F.lit("low"))


def _dated(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumns({"event_date": event_date(ts), "_us": micros(ts)})


def alert_cutoffs(scored: DataFrame, budgets: list[float], *, score: str = SCORE,
                  ts: str = "event_timestamp", id_col: str = "transaction_id",
                  buckets: int | None = None) -> DataFrame:
    """For each day and budget, the last alerted row in (score desc, time, id) order.

    Gives (event_date, alert_budget, n, k, value, us, id). The k-th row is found
    by narrowing: score bucket, then exact score and minute, then the rows of that
    minute. The input is read once, into a narrow stored table; that one is scanned
    by every step and never shuffled.
    """
    rows = materialise(_dated(scored, ts).select("event_date", "_us", F.col(id_col).alias("_id"), score), "scores")
    minute = F.floor(F.col("_us") / (60 * SECOND))
    wanted = [(repr(float(b)), lambda n, b=b: F.ceil(F.lit(float(b)) * n)) for b in budgets]
    near = kth_largest(rows, ["event_date"], score, wanted, sub=minute, buckets=buckets)
    # one row per day and budget
    at = near.select(F.col("event_date").alias("_d"), "label", "n", "k", "value", "sub", "left")
    ties = rows.withColumns({"_v": clean_score(score), "_minute": minute}).join(
        F.broadcast(at), (F.col("event_date") == F.col("_d")) & (F.col("_v") == F.col("value"))
        & (F.col("_minute") == F.col("sub")))
    ranked = row_ranks(ties, ["event_date", "label"], "_us", "_id", "_rn")
    return ranked.filter(F.col("_rn") == F.col("left")).select(
        "event_date", F.col("label").cast("double").alias("alert_budget"), "n", "k", "value",
        F.col("_us").alias("us"), F.col("_id").alias("id"))


def _within(score: str, id_col: str) -> Column:
    v = clean_score(score)
    same = v == F.col("_cv")
    return F.coalesce((v > F.col("_cv")) | (same & (F.col("_us") < F.col("_cus")))
                      | (same & (F.col("_us") == F.col("_cus")) & (F.col(id_col) <= F.col("_cid"))),
                      F.lit(False))


def _cut(cutoffs: DataFrame, *extra: str) -> DataFrame:
    return F.broadcast(cutoffs.select("event_date", *extra, F.col("value").alias("_cv"),
                                      F.col("us").alias("_cus"), F.col("id").alias("_cid")))


def daily_alerts(scored: DataFrame, budget: float = BUDGET, *, score: str = SCORE,
                 ts: str = "event_timestamp", id_col: str = "transaction_id",
                 cutoffs: DataFrame | None = None) -> DataFrame:
    """Mark the ceil(budget * n) highest scores of each day: adds event_date and alert."""
    if cutoffs is None:
        cutoffs = alert_cutoffs(scored, [budget], score=score, ts=ts, id_col=id_col)
    return (_dated(scored, ts).join(_cut(cutoffs), "event_date", "left")
            .withColumn("alert", _within(score, id_col)).drop("_us", "_cv", "_cus", "_cid"))


def alerts_by_budget(scored: DataFrame, budgets: list[float], *, score: str = SCORE,
                     ts: str = "event_timestamp", id_col: str = "transaction_id",
                     cutoffs: DataFrame | None = None) -> DataFrame:
    """One row per transaction and budget; meant to be aggregated at once (map side)."""
    if cutoffs is None:
        cutoffs = alert_cutoffs(scored, budgets, score=score, ts=ts, id_col=id_col)
    return (_dated(scored, ts).join(_cut(cutoffs, "alert_budget"), "event_date")
            .withColumn("alert", _within(score, id_col)).drop("_us", "_cv", "_cus", "_cid"))


def alert_day_stats(scored: DataFrame, budget: float = BUDGET, **kw) -> DataFrame:
    """Per day: volume, quota, alerts, rate and the lowest alerted score."""
    c = alert_cutoffs(scored, [budget], **kw)
    return c.select("event_date", F.col("n").alias("num_transactions"),
                    F.col("k").alias("budget_quota"), F.col("k").alias("num_alerts"),
                    (F.col("k") / F.col("n")).alias("alert_rate"), F.col("value").alias("threshold"))


def alert_policy_summary(scored: DataFrame, budget: float = BUDGET, **kw) -> DataFrame:
    days = alert_day_stats(scored, budget, **kw)
    rate = F.sum("num_alerts") / F.sum("num_transactions")
    return days.agg(F.sum("num_alerts").alias("total_alerts"), rate.alias("alert_rate"),
                    (rate / budget).alias("budget_utilized"),
                    F.min("threshold").alias("threshold_used"),
                    F.count(F.lit(1)).alias("days_processed"))


def budget_threshold(scored: DataFrame, budget: float = BUDGET, score: str = SCORE) -> DataFrame:
    """The k-th largest score overall; infinite for k = 0, zero when every row is alerted."""
    def k(n):
        return F.ceil(F.lit(float(budget)) * n)
    got = kth_largest(scored, [], score, [("k", lambda n: F.greatest(k(n), F.lit(1)))])
    kk = k(F.col("n"))
    return got.select(F.lit(float(budget)).alias("alert_budget"), "n", kk.cast("long").alias("k"),
                      F.when(kk == 0, F.lit(float("inf"))).when(kk >= F.col("n"), F.lit(0.0))
                      .otherwise(F.col("value")).alias("threshold"))


# -- online policy -------------------------------------------------------------

CHUNK = 50_000


def rolling_threshold(scored: DataFrame, segment: str, budget: float = BUDGET, *,
                      window: int = RECENT_SCORES, min_scores: int = MIN_SCORES,
                      fallback: float = FALLBACK_THRESHOLD, score: str = SCORE,
                      ts: str = "event_timestamp", id_col: str = "transaction_id",
                      profile: KeyProfile | None = None) -> DataFrame:
    """The k-th largest of the segment's last ``window`` scores, the row itself included.

    Rows are numbered per segment and cut into runs of ``CHUNK`` rows, each with
    the ``window - 1`` rows before it, so a task never holds a whole segment.
    """
    profile = profile or profile_keys(scored, segment)
    chunk = max(CHUNK, window)
    rows = scored.select(F.col(segment).alias("segment"), F.col(id_col).cast("string").alias("_id"),
                         micros(ts).alias("_us"), F.col(score).cast("double").alias("_score"))
    slice_us = profile.slice_us if profile.hot or profile.cold_bound > HOT_ROWS else None
    ranked = row_ranks(rows, ["segment"], "_us", "_id", "_rn", slice_us)
    own = F.floor((F.col("_rn") - 1) / chunk)
    offset = (F.col("_rn") - 1) % chunk
    copies = F.when(offset >= chunk - (window - 1), F.array(own, own + 1)).otherwise(F.array(own))
    spread = ranked.withColumns({"_own": own, "_run": F.explode(copies)})

    def one_run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_rn", kind="stable")
        pdf["alert_threshold"] = rolling.thresholds(pdf["_score"].to_numpy("float64"), window, budget, min_scores, fallback)
        mine = pdf[pdf["_own"] == pdf["_run"]]
        return mine[["_id", "segment", "_us", "_score", "alert_threshold"]]

    seg_type = scored.schema[segment].dataType.simpleString()
    done = spread.groupBy("segment", "_run").applyInPandas(
        one_run, f"_id string, segment {seg_type}, _us long, _score double, alert_threshold double")
    return done.select(F.col("_id").alias(id_col), F.col("segment").alias(segment),
                       F.timestamp_micros("_us").alias(ts), F.col("_score").alias(score),
                       "alert_threshold")


def sequential_budget(scored: DataFrame, segment: str, threshold: Column | str = "alert_threshold",
                      budget: float = BUDGET, *, score: str = SCORE, ts: str = "event_timestamp",
                      id_col: str = "transaction_id", slice_us: int | None = None) -> DataFrame:
    """Alert when the score reaches the threshold and the day's budget so far allows it.

    With n the day's running count, q = max(1, floor(n * budget)) and c = 1 for a
    row at or above the threshold, the alerts issued follow
    ``issued = min(issued before + c, q)``. That recursion has a closed form in
    running aggregates, ``issued = C + min(0, running min of (q - C))`` with C the
    running sum of c, so the feedback needs no sequential fold and a day may be
    cut into time slices.
    """
    limit = F.col(threshold) if isinstance(threshold, str) else threshold
    rows = scored.withColumns({
        "event_date": event_date(ts), "_us": micros(ts), "_id": F.col(id_col).cast("string"),
        "_cand": reaches(score, limit).cast("long")})
    if slice_us is None:
        heavy = (rows.groupBy(segment, "event_date").agg(F.count(F.lit(1)).alias("n"))
                 .agg(F.max("n")).first()[0] or 0)
        slice_us = 60 * SECOND if heavy > HOT_ROWS else None
    keys = [segment, "event_date"]
    counted = row_running(rows, keys, "_us", "_id",
                          {"daily_count": ("sum", F.lit(1)), "_c": ("sum", F.col("_cand"))}, slice_us)
    counted = counted.withColumn("daily_budget", F.greatest(
        F.lit(1), F.floor(F.col("daily_count") * F.lit(float(budget)))).cast("long"))
    if slice_us is not None:
        counted = materialise(counted, "budget")
    low = row_running(counted, keys, "_us", "_id",
                      {"_low": ("min", F.col("daily_budget") - F.col("_c"))}, slice_us, last=-1)
    before = F.col("_c") - F.col("_cand") + F.least(F.lit(0), F.coalesce(F.col("_low"), F.lit(0)))
    issued = F.least(before + F.col("_cand"), F.col("daily_budget"))
    return low.withColumns({
        "should_alert": issued > before,
        "budget_exceeded": (F.col("_cand") == 1) & (before >= F.col("daily_budget")),
        "daily_alerts": issued,
        "alert_budget_remaining": F.greatest(F.lit(0), F.col("daily_budget") - before),
    }).drop("_us", "_id", "_cand", "_c", "_low")
