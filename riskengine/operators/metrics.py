"""Confusion, ranking, budget and cost metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskengine.functions.timing import SECOND, event_date, micros
from riskengine.operators.alerts import (BUDGET, SCORE, alert_cutoffs, alerts_by_budget,
                                         risk_tier)
from riskengine.operators.ranking import exact_quantiles, reaches, score_curve
from riskengine.session import materialise

# Fixed values of the reports.
BUDGETS = [0.001, 0.005, 0.01, 0.02, 0.05]
TARGET_PRECISION = 0.70
FRAUD_LOSS = 50_000.0
INVESTIGATION_COST = 500.0
TOLERANCE = 0.20


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, zero when b is zero."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def confusion(flag: Column, label: str = "is_fraud") -> list[Column]:
    """tp, fp, fn, tn; rows without a label are in none of them."""
    y = F.col(label)

    def n(cond, name):
        return F.count(F.when(cond, 1)).alias(name)
    return [n(flag & (y == 1), "tp"), n(flag & (y == 0), "fp"),
            n(~flag & (y == 1), "fn"), n(~flag & (y == 0), "tn")]


def daily_metrics(alerted: DataFrame, label: str = "is_fraud") -> DataFrame:
    """One row per event_date of a table with ``alert`` flags."""
    g = alerted.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("num_transactions"),
        F.count(F.when(F.col("alert"), 1)).alias("num_alerts"), *confusion(F.col("alert"), label))
    return g.select(
        "event_date", "num_transactions", "num_alerts",
        (F.col("num_alerts") / F.col("num_transactions")).alias("alert_rate"),
        "tp", "fp", "fn", "tn", (F.col("tp") + F.col("fn")).alias("total_fraud"),
        (F.col("fp") + F.col("tn")).alias("total_legit"),
        ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
        ratio("tp", F.col("tp") + F.col("fn")).alias("recall"),
        ratio("fp", F.col("fp") + F.col("tn")).alias("false_alert_rate"))


def cumulative_metrics(daily: DataFrame) -> DataFrame:
    """Totals over the days, and the mean and population deviation of the daily rates."""
    p = F.when(F.col("num_alerts") > 0, F.col("precision"))
    r = F.when(F.col("total_fraud") > 0, F.col("recall"))
    g = daily.agg(
        F.count(F.lit(1)).alias("total_days"), F.sum("num_transactions").alias("total_transactions"),
        F.sum("total_fraud").alias("total_fraud"), F.sum("num_alerts").alias("total_alerts"),
        F.sum("tp").alias("total_caught"), F.sum("fn").alias("total_missed"),
        F.sum("fp").alias("total_false_positives"),
        F.coalesce(F.avg(p), F.lit(0.0)).alias("average_daily_precision"),
        F.coalesce(F.stddev_pop(p), F.lit(0.0)).alias("std_daily_precision"),
        F.coalesce(F.avg(r), F.lit(0.0)).alias("average_daily_recall"),
        F.coalesce(F.stddev_pop(r), F.lit(0.0)).alias("std_daily_recall"))
    return g.withColumns({
        "overall_precision": ratio("total_caught", F.col("total_caught") + F.col("total_false_positives")),
        "overall_recall": ratio("total_caught", F.col("total_caught") + F.col("total_missed")),
        "overall_alert_rate": ratio("total_alerts", "total_transactions")})


def budget_adherence(daily: DataFrame, budget: float = BUDGET, tolerance: float = TOLERANCE) -> DataFrame:
    """Days whose alert rate passes the budget by more than the tolerance."""
    return daily.filter(F.col("alert_rate") > F.lit(budget * (1 + tolerance))).select(
        "event_date", "alert_rate", F.lit(budget).alias("budget"),
        (F.col("alert_rate") - budget).alias("violation"))


def quota_adherence(daily: DataFrame, budget: float = BUDGET) -> DataFrame:
    """Days with more alerts than ceil(budget * n): empty by construction of the policy."""
    quota = F.ceil(F.lit(float(budget)) * F.col("num_transactions"))
    return daily.withColumn("budget_quota", quota.cast("long")).filter(
        F.col("num_alerts") > F.col("budget_quota"))


def backtest_summary(daily: DataFrame, budget: float = BUDGET, tolerance: float = TOLERANCE) -> DataFrame:
    over = F.count(F.when(F.col("alert_rate") > F.lit(budget * (1 + tolerance)), 1))
    near = F.count(F.when(F.col("alert_rate") > F.lit(budget * 1.01), 1))
    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    return daily.agg(
        F.concat(F.min("event_date").cast("string"), F.lit(" to "),
                 F.max("event_date").cast("string")).alias("period"),
        F.count(F.lit(1)).alias("days_processed"),
        F.sum("num_transactions").alias("total_transactions"),
        ratio(tp + fn, F.sum("num_transactions")).alias("fraud_rate"),
        ratio(tp, tp + fp).alias("overall_precision"), ratio(tp, tp + fn).alias("overall_recall"),
        tp.alias("fraud_caught"), fn.alias("fraud_missed"),
        F.when(over > 0, near).otherwise(0).cast("long").alias("alert_budget_violations"))


def cumulative_savings(daily: DataFrame, fraud_loss: float = FRAUD_LOSS,
                       cost: float = INVESTIGATION_COST) -> DataFrame:
    """Savings by day and their running total (one row per calendar day)."""
    d = daily.select("event_date", (F.col("tp") * fraud_loss).alias("prevented"),
                     (F.col("num_alerts") * cost).alias("cost"))
    w = (Window.partitionBy(F.lit(0)).orderBy("event_date")
         .rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("net_savings", F.col("prevented") - F.col("cost"))
    return d.withColumn("cumulative_savings", F.sum("net_savings").over(w))


def _rates(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.select(
        "alert_budget", "threshold", "actual_alert_rate",
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(fp, tn + fp).alias("false_alert_rate"), tp.alias("true_positives"),
        fp.alias("false_positives"), fn.alias("false_negatives"), tn.alias("true_negatives"),
        (tp + fn).alias("total_fraud"), tp.alias("fraud_caught"), fn.alias("fraud_missed"),
        (tp + fp).alias("total_flagged"))


def budget_curve(scored: DataFrame, budgets: list[float] | None = None, *,
                 label: str = "is_fraud", cutoffs: DataFrame | None = None, **kw) -> DataFrame:
    """Precision and recall under the daily top-k policy, one row per budget.

    ``cutoffs``: stored :func:`alert_cutoffs` of these budgets (others are left out), if there are some already.
    """
    budgets = budgets or BUDGETS
    if cutoffs is None:
        cutoffs = materialise(alert_cutoffs(scored, budgets, **kw), "cutoffs")  # read twice, one row per day and budget
    else:
        cutoffs = cutoffs.filter(F.col("alert_budget").isin([float(b) for b in budgets]))
    hits = alerts_by_budget(scored, budgets, cutoffs=cutoffs, **kw).groupBy("alert_budget").agg(
        (F.count(F.when(F.col("alert"), 1)) / F.count(F.lit(1))).alias("actual_alert_rate"),
        *confusion(F.col("alert"), label))
    low = cutoffs.groupBy("alert_budget").agg(F.min("value").alias("threshold"))
    return _rates(hits.join(F.broadcast(low), "alert_budget"))


def precision_at_budget(scored: DataFrame, budget: float = BUDGET, **kw) -> DataFrame:
    """The daily-quota form."""
    return budget_curve(scored, [budget], **kw)


def precision_at_percentile(scored: DataFrame, budget: float = BUDGET, *, score: str = SCORE,
                            label: str = "is_fraud") -> DataFrame:
    """The global form: everything at or above the (1 - budget) percentile."""
    cut = exact_quantiles(scored, score, [1 - budget]).select(F.col("value").alias("threshold"))
    flagged = scored.crossJoin(F.broadcast(cut))  # one row
    hits = flagged.groupBy("threshold").agg(
        (F.count(F.when(reaches(score, F.col("threshold")), 1)) / F.count(F.lit(1)))
        .alias("actual_alert_rate"), *confusion(reaches(score, F.col("threshold")), label))
    return _rates(hits.withColumn("alert_budget", F.lit(float(budget))))


def best_budget(curve: DataFrame, target: float = TARGET_PRECISION) -> DataFrame:
    """The highest budget whose precision meets the target."""
    return curve.filter(F.col("precision") >= target).orderBy(F.desc("alert_budget")).limit(1)


def cost_benefit(at_budget: DataFrame, fraud_loss: float = FRAUD_LOSS,
                 cost: float = INVESTIGATION_COST) -> DataFrame:
    spent = F.col("total_flagged") * F.lit(float(cost))
    saved = F.col("fraud_caught") * F.lit(float(fraud_loss))
    return at_budget.withColumns({
        "avg_fraud_loss": F.lit(float(fraud_loss)), "investigation_cost": F.lit(float(cost)),
        "fraud_prevented_value": saved, "fraud_losses": F.col("fraud_missed") * F.lit(float(fraud_loss)),
        "investigation_costs": spent, "net_savings": saved - spent,
        "roi": F.when(spent > 0, saved / spent - 1).otherwise(0.0)})


def ranking_metrics(scored: DataFrame, score: str = SCORE, label: str = "is_fraud", *, curve: DataFrame | None = None) -> DataFrame:
    """ROC-AUC with ties counted half, and step-wise average precision; ``curve`` is the table's :func:`score_curve`, if made already."""
    c = score_curve(scored, score, label) if curve is None else curve
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    neg_total = F.col("total_n") - F.col("total_pos")
    neg_below = neg_total - (F.col("n_above") - F.col("pos_above"))
    g = c.agg(
        F.max("total_n").alias("labelled"), F.max("total_pos").alias("positives"),
        F.sum(pos * (neg_below + neg / 2)).alias("_u"),
        F.sum(pos * F.col("pos_above") / F.col("n_above")).alias("_ap"))
    p, n = F.col("positives"), F.col("labelled") - F.col("positives")
    return g.select("labelled", "positives",
                    F.when((p > 0) & (n > 0), F.col("_u") / (p.cast("double") * n)).alias("roc_auc"),
                    F.when(p > 0, F.col("_ap") / p).alias("pr_auc"))


def recall_at_precision(scored: DataFrame, targets: list[float], score: str = SCORE,
                        label: str = "is_fraud", *, curve: DataFrame | None = None) -> DataFrame:
    """Best recall with precision at or above each target, and the highest score giving it."""
    c = score_curve(scored, score, label) if curve is None else curve
    t = F.explode(F.array(*[F.lit(float(x)) for x in targets]))
    best = (c.select(t.alias("target_precision"), "score", "n_above", "pos_above", "total_pos")
            .filter(F.col("pos_above") / F.col("n_above") >= F.col("target_precision"))
            .groupBy("target_precision")
            .agg(F.max(F.struct(F.col("pos_above"), F.col("score"))).alias("b"),
                 F.max("total_pos").alias("p")))
    return best.select("target_precision", ratio("b.pos_above", "p").alias("recall"),
                       F.col("b.score").alias("threshold"))


def confusion_at_threshold(scored: DataFrame, threshold: float = 0.5, score: str = SCORE,
                           label: str = "is_fraud") -> DataFrame:
    """Rows without a usable score are not flagged."""
    g = scored.agg(*confusion(reaches(score, threshold), label))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return g.select(F.lit(float(threshold)).alias("threshold"), "tp", "fp", "fn", "tn",
                    precision.alias("precision"), recall.alias("recall"),
                    ratio(2 * precision * recall, precision + recall).alias("f1"),
                    ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


LATENCY_QUANTILES = (0.5, 0.95, 0.99)


def service_summary(log: DataFrame, *, latency: str = "latency_ms", alert: str = "alert",
                    error: str = "error", ts: str = "event_timestamp") -> DataFrame:
    """Requests, rate, alerts, errors and latency percentiles of a scored log, and the share of its last day that was alerted."""
    q = exact_quantiles(log, latency, list(LATENCY_QUANTILES))
    wide = q.agg(*[F.max(F.when(F.col("quantile") == p, F.col("value"))).alias(f"p{int(p * 100)}_latency_ms")
                   for p in LATENCY_QUANTILES])
    us = micros(ts)
    days = log.groupBy(event_date(ts).alias("_day")).agg(
        F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col(alert), 1)).alias("_a"), F.count(F.when(F.col(error), 1)).alias("_e"),
        F.sum(latency).alias("_l"), F.count(latency).alias("_k"), F.min(us).alias("_from"), F.max(us).alias("_to"))
    last = F.max(F.when(F.col("_day").isNotNull(), F.struct("_day", "_a", "_n")))
    span = F.greatest((F.max("_to") - F.min("_from")) / SECOND, F.lit(1.0))
    g = days.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_requests"), F.coalesce(F.sum("_a"), F.lit(0)).alias("total_alerts"),
        F.coalesce(F.sum("_e"), F.lit(0)).alias("error_count"), (F.sum("_l") / F.sum("_k")).alias("avg_latency_ms"),
        (F.sum("_n") / span).alias("requests_per_second"), last.alias("_last"))
    g = g.withColumns({"alert_rate": ratio("total_alerts", "total_requests"),
                       "daily_budget_utilization": ratio(F.col("_last._a"), F.col("_last._n"))}).drop("_last")
    return g.crossJoin(F.broadcast(wide)).fillna(0.0)  # one row each; zeros for an empty log


def score_by_class(scored: DataFrame, score: str = SCORE, label: str = "is_fraud") -> DataFrame:
    """Score statistics of each label class, NULL labels included as their own class."""
    return scored.groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"),
        F.stddev_samp(score).alias("std_score"), F.min(score).alias("min_score"),
        F.max(score).alias("max_score"))


def tier_distribution(scored: DataFrame, score: str = SCORE, label: str = "is_fraud") -> DataFrame:
    return scored.groupBy(risk_tier(score).alias("risk_tier")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(label) == 1, 1)).alias("frauds"))


def evaluation_report(scored: DataFrame, budget: float = BUDGET, budgets: list[float] | None = None,
                      score: str = SCORE, label: str = "is_fraud", *, curve: DataFrame | None = None) -> DataFrame:
    """The whole report as (section, metric, value) rows; ``curve`` as for :func:`ranking_metrics`."""
    def long(df, section, name=None):
        cols = [c for c in df.columns if c != name]
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value"))
                                    for c in cols])).alias("m")
        head = F.lit(section) if name is None else F.concat(F.lit(section + "@"), F.col(name).cast("string"))
        return df.select(head.alias("section"), pairs).select("section", "m.metric", "m.value")
    budgets = budgets or BUDGETS
    cutoffs = materialise(alert_cutoffs(scored, list(dict.fromkeys([*budgets, budget])), score=score), "cutoffs")  # of all budgets at once
    by_budget = budget_curve(scored, budgets, score=score, label=label, cutoffs=cutoffs)
    at = precision_at_budget(scored, budget, score=score, label=label, cutoffs=cutoffs)
    return (long(ranking_metrics(scored, score, label, curve=curve), "ranking")
            .unionByName(long(cost_benefit(at), "budget"))
            .unionByName(long(by_budget, "curve", "alert_budget")))
