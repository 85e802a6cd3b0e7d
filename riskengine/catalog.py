"""Named queries over the test tables: one per operator family."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskengine.fixtures import table, txn_events, txn_orders
from riskengine.functions.identity import (device_hash, payee_address, payer_address, payer_hash,
                                           payer_of_address)
from riskengine.functions.timing import epoch_seconds, micros
from riskengine.models import anomaly, nodes, preparation, supervised
from riskengine.operators import (alerts, compare, contracts, detect, features, heat, history,
                                  metrics, quality, ranking, split)
from riskengine.plans import scoring, training
from riskengine.schema import FEATURES
from riskengine.session import materialise, shared_dir, use_utc
from riskengine.sources import etl, tables
from riskengine.streaming import keyed, policy, source
from riskengine.streaming.features import FeatureStream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BUDGET = 0.01
SPLIT = {"test_days": 7, "buffer_hours": 1}


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(use_utc(spark), sf_dir)
    QUERIES[fn.__name__] = run
    return run


def r4(c: Column | str, name: str | None = None) -> Column:
    name = name or c
    return F.round(F.col(c) if isinstance(c, str) else c, 4).alias(name)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Doubles to four places (except those kept), dates as text."""
    out = []
    for f in df.schema:
        t = f.dataType.simpleString()
        if t == "double" and f.name not in keep:
            out.append(r4(f.name))
        elif t == "date":
            out.append(F.col(f.name).cast("string").alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


NARROW = ["transaction_id", "event_timestamp", "payer_id", "device_id", "payee_vpa", "amount",
          "is_fraud", "label_available_timestamp"]


# -- point-in-time features ----------------------------------------------------

@query
def payer_velocity(spark, d):
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "payer_id", "amount")
    return rounded(history.payer_velocity(df).drop("event_timestamp", "amount"))


@query
def payer_velocity_custom_windows(spark, d):
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "payer_id", "amount")
    out = history.payer_velocity(df, {"10min": 600, "3d": 3 * 86400})
    return rounded(out.drop("event_timestamp", "amount"))


@query
def device_velocity(spark, d):
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "device_id")
    return history.device_velocity(df).drop("event_timestamp")


@query
def payer_velocity_inclusive_orders(spark, d):
    df = txn_orders(spark, d).select("transaction_id", "event_timestamp", "payer_id", "amount")
    out = history.payer_velocity(df, {"24h": 86400}, inclusive=True)
    return rounded(out.drop("event_timestamp", "amount"))


@query
def device_distinct_payers(spark, d):
    df = txn_orders(spark, d).select("transaction_id", "event_timestamp", "device_id", "payer_id")
    out = history.distinct_last_rows(df, "device_id", "payer_id", "device_distinct_payers_7d")
    return out.select("transaction_id", "device_distinct_payers_7d")


@query
def payer_distinct_payees(spark, d):
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "payer_id", "payee_vpa")
    out = history.distinct_last_rows(df, "payer_id", "payee_vpa", "payer_distinct_payees_7d")
    return out.select("transaction_id", "payer_distinct_payees_7d")


@query
def device_distinct_last20(spark, d):
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "device_id", "payer_id")
    out = history.distinct_last_rows(df, "device_id", "payer_id", "device_distinct_last20", rows=20)
    return out.select("transaction_id", "device_distinct_last20")


@query
def distinct_payees_7d_range(spark, d):
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "payer_id", "payee_vpa")
    out = history.distinct_in_span(df, "payer_id", "payee_vpa", "distinct_payees_7d")
    return out.select("transaction_id", "distinct_payees_7d")


@query
def risk_history(spark, d):
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "payer_id", "is_fraud",
                                     "label_available_timestamp")
    return history.risk_history(df).select("transaction_id", "payer_past_fraud_count_30d")


@query
def risk_history_orders(spark, d):
    df = txn_orders(spark, d).select("transaction_id", "event_timestamp", "payer_id", "is_fraud",
                                     "label_available_timestamp")
    return history.risk_history(df).select("transaction_id", "payer_past_fraud_count_30d")


@query
def full_features(spark, d):
    return rounded(features.build_features(txn_events(spark, d)).drop("event_timestamp"))


@query
def full_features_orders(spark, d):
    return rounded(features.build_features(txn_orders(spark, d)).drop("event_timestamp"))


@query
def full_features_hot_keys(spark, d):
    """Same table, but every larger key takes the sliced path."""
    df = txn_orders(spark, d)
    counts = df.count()
    # shares of the table for small ones; in large ones no key above the operator's own limit is left to one task
    payers = heat.profile_keys(df, "payer_id", hot_rows=min(counts // 50, heat.HOT_ROWS))
    devices = heat.profile_keys(df, "device_id", hot_rows=min(counts // 5, heat.HOT_ROWS))
    day = 86400 * 10**6
    payers = heat.KeyProfile(payers.hot, heat.HOT_ROWS, 200 * day)
    devices = heat.KeyProfile(devices.hot, heat.HOT_ROWS, 50 * day)
    out = features.build_features(df, payer_profile=payers, device_profile=devices)
    return rounded(out.drop("event_timestamp"))


@query
def history_slice(spark, d):
    """The 24 h before each payer's last transaction."""
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "payer_id", "amount")
    probes = df.groupBy("payer_id").agg(F.max("event_timestamp").alias("probe_timestamp"))
    rows = history.history_slice(df, probes, "payer_id", 86400)
    return rows.select("payer_id", "transaction_id", micros("probe_timestamp").alias("probe_us"),
                       "amount")


@query
def history_slice_totals(spark, d):
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "payer_id", "amount")
    probes = df.groupBy("payer_id").agg(F.max("event_timestamp").alias("probe_timestamp"))
    return rounded(history.history_totals(df, probes, "payer_id", 86400).drop("probe_timestamp"))


@query
def history_totals_hot(spark, d):
    """Totals of the year before each hundredth order, with every payer on the sliced path; some probes ask for unknown payers."""
    df = txn_orders(spark, d).select("transaction_id", "event_timestamp", "payer_id", "amount")
    i = F.col("transaction_id").cast("long")
    probes = df.filter(i % 100 == 0).select("transaction_id", F.col("event_timestamp").alias("probe_timestamp"),
                                            F.when(i % 300 != 0, F.col("payer_id")).otherwise("nobody").alias("asked"))
    profile = heat.KeyProfile(tuple(str(k) for k in range(50)), heat.HOT_ROWS, 100 * 86400 * 10**6)
    out = history.history_totals(df, probes, "payer_id", 365 * 86400, probe_key="asked", profile=profile)
    return rounded(out.drop("probe_timestamp"))


# -- alerts --------------------------------------------------------------------

@query
def daily_alerts(spark, d):
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "fraud_probability")
    out = alerts.daily_alerts(df, BUDGET)
    return out.select("transaction_id", F.col("event_date").cast("string").alias("event_date"), "alert")


@query
def daily_alerts_orders(spark, d):
    """Scores of two digits: heavy score ties, settled by time and id."""
    df = txn_orders(spark, d).withColumn("fraud_probability", F.floor(F.col("amount") / 60000) / 10)
    df = df.withColumn("event_timestamp", F.date_trunc("month", "event_timestamp"))
    out = alerts.daily_alerts(df.select("transaction_id", "event_timestamp", "fraud_probability"), 0.1)
    return out.select("transaction_id", F.col("event_date").cast("string").alias("event_date"), "alert")


@query
def alert_day_stats(spark, d):
    return rounded(alerts.alert_day_stats(txn_events(spark, d), BUDGET))


@query
def alert_policy_summary(spark, d):
    return rounded(alerts.alert_policy_summary(txn_events(spark, d), BUDGET))


@query
def budget_threshold(spark, d):
    return rounded(alerts.budget_threshold(txn_events(spark, d), BUDGET))


@query
def rolling_threshold(spark, d):
    df = txn_events(spark, d)
    out = alerts.rolling_threshold(df, "payee_vpa", BUDGET, window=300)
    return out.select("transaction_id", "payee_vpa", F.round("alert_threshold", 6).alias("alert_threshold"))


@query
def sequential_budget(spark, d):
    df = txn_events(spark, d).withColumn("alert_threshold", F.lit(0.15))
    out = alerts.sequential_budget(df, "payee_vpa", budget=BUDGET)
    return out.select("transaction_id", "daily_count", "daily_budget", "should_alert", "budget_exceeded",
                      "alert_budget_remaining")


@query
def online_policy(spark, d):
    """Rolling threshold and sequential budget together, per merchant."""
    df = txn_events(spark, d)
    scored = alerts.rolling_threshold(df, "payee_vpa", BUDGET, window=300)
    out = alerts.sequential_budget(scored, "payee_vpa", budget=BUDGET)
    return out.select("transaction_id", "should_alert", "budget_exceeded", "daily_count")


@query
def risk_tiers(spark, d):
    df = txn_events(spark, d)
    return df.select("transaction_id", alerts.risk_tier("fraud_probability").alias("risk_tier"))


@query
def unusable_scores(spark, d):
    """Tiers, cells at a threshold and the running budget where some scores are NaN or NULL."""
    i = F.col("transaction_id").cast("long")
    df = txn_events(spark, d).withColumn("fraud_probability", F.when(i % 10 == 3, F.lit(float("nan"))).when(
        i % 10 != 7, F.col("fraud_probability")))
    tiers = df.groupBy(alerts.risk_tier("fraud_probability").alias("what")).agg(F.count("*").alias("n"))
    cells = metrics.confusion_at_threshold(df, 0.3).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("what"), F.col(c).alias("n")) for c in ("tp", "fp", "fn", "tn")])).alias("c")).select("c.*")
    fold = alerts.sequential_budget(df.withColumn("alert_threshold", F.lit(0.15)), "payee_vpa", budget=BUDGET).agg(
        F.count(F.when(F.col("should_alert"), 1)).alias("n")).select(F.lit("issued").alias("what"), "n")
    daily = alerts.daily_alerts(df, 0.95).where("alert").agg(F.count(F.when(
        F.isnan("fraud_probability") | F.col("fraud_probability").isNull(), 1)).alias("n")).select(F.lit("unusable in daily top").alias("what"), "n")
    return tiers.unionByName(cells).unionByName(fold).unionByName(daily)


# -- metrics -------------------------------------------------------------------

def _daily(spark, d):
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "fraud_probability", "is_fraud")
    return metrics.daily_metrics(alerts.daily_alerts(df, BUDGET))


@query
def daily_metrics(spark, d):
    return rounded(_daily(spark, d))


@query
def cumulative_metrics(spark, d):
    return rounded(metrics.cumulative_metrics(_daily(spark, d)))


@query
def budget_adherence(spark, d):
    return rounded(metrics.budget_adherence(_daily(spark, d), 0.0085))


@query
def quota_adherence(spark, d):
    return rounded(metrics.quota_adherence(_daily(spark, d), 0.0085))


@query
def backtest_summary(spark, d):
    return rounded(metrics.backtest_summary(_daily(spark, d), 0.0085))


@query
def cumulative_savings(spark, d):
    return rounded(metrics.cumulative_savings(_daily(spark, d)))


@query
def precision_at_budget_daily(spark, d):
    return rounded(metrics.precision_at_budget(txn_events(spark, d), BUDGET), "alert_budget")


@query
def precision_at_budget_global(spark, d):
    return rounded(metrics.precision_at_percentile(txn_events(spark, d), BUDGET), "alert_budget")


@query
def budget_curve(spark, d):
    return rounded(metrics.budget_curve(txn_events(spark, d)), "alert_budget")


@query
def best_budget(spark, d):
    curve = metrics.budget_curve(txn_events(spark, d))
    return rounded(metrics.best_budget(curve, 0.2), "alert_budget")


@query
def cost_benefit(spark, d):
    at = metrics.precision_at_budget(txn_events(spark, d), BUDGET)
    return rounded(metrics.cost_benefit(at), "alert_budget")


@query
def roc_pr_auc(spark, d):
    return rounded(metrics.ranking_metrics(txn_events(spark, d)))


@query
def recall_at_precision(spark, d):
    return rounded(metrics.recall_at_precision(txn_events(spark, d), [0.1, 0.2, 0.3, 0.5]), "target_precision")


@query
def confusion_at_threshold(spark, d):
    return rounded(metrics.confusion_at_threshold(txn_events(spark, d), 0.3))


@query
def exact_percentiles(spark, d):
    return rounded(ranking.exact_quantiles(txn_events(spark, d), "amount", [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]),
                   "quantile")


@query
def service_summary(spark, d):
    df = txn_events(spark, d).select(
        "event_timestamp", F.col("amount").alias("latency_ms"), (F.col("fraud_probability") > 0.2).alias("alert"),
        (F.col("payee_vpa") == "merchant_error@upi").alias("error"))
    return rounded(metrics.service_summary(df))


@query
def score_by_class(spark, d):
    return rounded(metrics.score_by_class(txn_events(spark, d)))


@query
def tier_distribution(spark, d):
    return metrics.tier_distribution(txn_events(spark, d))


@query
def evaluation_report(spark, d):
    return rounded(metrics.evaluation_report(txn_events(spark, d), BUDGET))


# -- preparation and contracts -------------------------------------------------

def _raw(spark, d):
    """Orders in the raw card-transaction shape."""
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("TransactionID"), F.col("o_totalprice").alias("TransactionAmt"),
        (F.col("o_orderkey") * 61).alias("TransactionDT"),
        (F.col("o_orderkey") % 11 == 0).cast("double").alias("isFraud"),
        F.col("o_custkey").alias("card1"), F.col("o_orderstatus").alias("card4"),
        F.when(F.col("o_custkey") % 3 == 0, F.col("o_orderpriority")).alias("card6"),
        F.substring("o_orderpriority", 1, 1).alias("ProductCD"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("dev"), F.col("o_custkey") % 100)).alias("DeviceInfo"))


def _shape(df):
    return df.select(
        F.col("transaction_id").cast("string").alias("transaction_id"), "amount",
        micros("event_timestamp").alias("event_us"), micros("label_available_timestamp").alias("label_us"),
        "is_fraud", "currency", "payer_id", "payer_vpa", "payee_vpa", "device_id")


@query
def standardise_upi(spark, d):
    return _shape(etl.to_payment_shape(etl.standardise(_raw(spark, d), True)))


@query
def generate_dataset(spark, d):
    """Train (status F) and test orders: merge, standardise, map, union."""
    raw = _raw(spark, d)
    ident = table(spark, d, "customer").select(
        F.col("c_custkey").alias("TransactionID"), F.col("c_mktsegment").alias("id_12"))
    train = F.col("card4") == "F"
    out = etl.generate_dataset(raw.filter(train), ident, raw.filter(~train).drop("isFraud"), ident)
    return _shape(out).join(out.select(F.col("transaction_id").cast("string").alias("transaction_id"), "id_12"),
                            "transaction_id")


@query
def payer_fingerprint(spark, d):
    o = table(spark, d, "orders")
    h = payer_hash("o_custkey", "o_orderstatus", "o_orderpriority")
    return o.select("o_orderkey", h.alias("payer_id"), payer_address(h).alias("payer_vpa"),
                    device_hash(F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority"))).alias("device_id"),
                    payee_address("o_orderstatus").alias("payee_vpa"))


@query
def identity_merge(spark, d):
    """Most orders have no identity row."""
    o = table(spark, d, "orders").withColumnRenamed("o_orderkey", "TransactionID")
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "TransactionID")
    return etl.merge_identity(o, c).select("TransactionID", "o_custkey", "o_totalprice", "c_name", "c_acctbal")


@query
def identity_key_check(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "TransactionID")
    etl.assert_row_preserving(c)
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "TransactionID")
    return o.agg(F.count(F.lit(1)).alias("n_before")).crossJoin(
        etl.merge_identity(o, c).agg(F.count(F.lit(1)).alias("n_after")))


@query
def normalise_vpa(spark, d):
    e = table(spark, d, "events")
    vpa = (F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("user_"), "user_id", F.lit("@upi")))
           .when(F.col("event_id") % 3 == 1, F.concat("event_type", F.lit("."), "user_id", F.lit("@bank")))
           .otherwise(F.concat(F.lit("user_"), "user_id", F.lit("@bank"))))
    return e.select("event_id", payer_of_address(vpa).alias("payer_id"), epoch_seconds("ts").alias("epoch"))


def _dirty(spark, d):
    """Events as text rows, some of them broken."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    return e.select(
        i.alias("transaction_id"),
        F.when(i % 41 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .alias("event_timestamp"),
        F.when(i % 37 == 0, "abc").when(i % 23 == 0, F.concat(F.lit("-"), F.col("value").cast("string")))
        .when(i % 29 == 0, F.lit("0")).otherwise(F.col("value").cast("string")).alias("amount"),
        F.when(i % 31 == 0, "USD").otherwise("INR").alias("currency"),
        F.concat(F.lit("USER_"), "user_id", F.lit("@UPI")).alias("payer_vpa"),
        F.when(i % 43 == 0, F.lit(None)).otherwise(F.concat(F.upper("event_type"), F.lit("@upi"))).alias("payee_vpa"),
        F.get_json_object("props", "$.k").alias("device_id"),
        F.col("user_id").alias("V1"))


@query
def contract_valid(spark, d):
    valid, _ = contracts.enforce(_dirty(spark, d))
    return valid.select("transaction_id", micros("event_timestamp").alias("event_us"), r4("amount"),
                        "currency", "payer_vpa", "payee_vpa", "device_id", "V1")


@query
def contract_rejects(spark, d):
    _, bad = contracts.enforce(_dirty(spark, d))
    return bad.select(F.col("transaction_id").cast("string").alias("transaction_id"),
                      F.array_join("reject_reasons", "; ").alias("reasons"))


@query
def contract_strict(spark, d):
    _, bad = contracts.enforce(_dirty(spark, d), strict=True)
    return bad.select(F.col("transaction_id").cast("string").alias("transaction_id"),
                      F.array_join("reject_reasons", "; ").alias("reasons"))


# -- quality -------------------------------------------------------------------

def _gated(spark, d):
    i = F.col("transaction_id").cast("long")
    df = txn_events(spark, d)
    return df.withColumns({
        "amount": F.when(i % 97 == 0, 0.0).when(i % 101 == 0, 2e6).otherwise(F.col("amount")),
        "currency": F.when(i % 89 == 0, "USD").otherwise(F.col("currency")),
        "payer_id": F.when(i % 83 == 0, F.lit(None)).otherwise(F.col("payer_id")),
        "label_available_timestamp": F.when(i % 79 == 0, F.lit(None))
        .when(i % 73 == 0, F.col("event_timestamp")).otherwise(F.col("label_available_timestamp")),
        "transaction_id": F.when(i % 67 == 0, (i + 1).cast("string")).otherwise(F.col("transaction_id")),
        "fraud_pattern": F.when(F.col("is_fraud") == 1, F.element_at(
            F.array(F.lit("ring"), F.lit("spike")), (i % 2 + 1).cast("int")))})


@query
def quality_report(spark, d):
    return rounded(quality.quality_report(_gated(spark, d)))


@query
def event_gate(spark, d):
    passed, stopped = contracts.gate_events(_gated(spark, d))
    return (passed.select("transaction_id", F.lit(True).alias("passed"))
            .unionByName(stopped.select("transaction_id", F.lit(False).alias("passed"))))


@query
def fraud_summary(spark, d):
    return rounded(quality.fraud_summary(_gated(spark, d)))


@query
def table_profile(spark, d):
    return quality.table_profile(_gated(spark, d))


def _stored(df: DataFrame, files: int, *order: str) -> DataFrame:
    """``df`` as a table of several files in the given order, with the places of its rows."""
    path = f"{shared_dir(df.sparkSession)}/tables/ordered-{uuid.uuid4().hex}"
    df.repartitionByRange(files, *order).sortWithinPartitions(*order).write.parquet(path)
    return quality.with_places(df.sparkSession.read.schema(df.schema).parquet(path))


@query
def dataset_validation(spark, d):
    """The table lies by device, so its times fall where a device begins."""
    return quality.dataset_validation(_stored(_gated(spark, d), 5, "device_id", "event_timestamp", "transaction_id"))


@query
def order_rules(spark, d):
    """Order along a table of several files: kept, kept mostly, and broken."""
    df = txn_orders(spark, d).select(F.col("transaction_id").cast("long").alias("number"), "event_timestamp",
                                     F.when(F.col("device_id") != "5-LOW", F.col("amount")).alias("amount"))
    suite = [quality.increasing("number"), quality.increasing("event_timestamp"), quality.increasing("event_timestamp", 0.45),
             quality.increasing("amount", 0.6), quality.not_null("amount")]
    return rounded(quality.quality_report(_stored(df, 7, "number"), {"order": suite}))


@query
def label_delay_stats(spark, d):
    return rounded(quality.label_delay_stats(_gated(spark, d)))


@query
def feature_ranges(spark, d):
    f = features.build_features(txn_events(spark, d))
    return rounded(quality.feature_ranges(f, FEATURES))


@query
def monotonicity_violations(spark, d):
    """Some rows are damaged on purpose."""
    extra = F.when(F.col("transaction_id").cast("long") % 89 == 0, 1_000_000).otherwise(0)
    f = features.build_features(txn_events(spark, d)).withColumn("payer_txn_count_5min", F.col("payer_txn_count_5min") + extra)
    return quality.monotonicity_violations(f).select("transaction_id")


@query
def consistency_check(spark, d):
    df = txn_events(spark, d)
    return rounded(quality.consistency_check(df, features.build_features(df)))


# -- splits --------------------------------------------------------------------

@query
def split_dates(spark, d):
    return split.split_dates(txn_events(spark, d), **SPLIT)


@query
def temporal_split(spark, d):
    df = txn_events(spark, d)
    train, test = split.temporal_split(df, split.calculate_split(df, **SPLIT))
    return (train.select("transaction_id", F.lit("train").alias("split"))
            .unionByName(test.select("transaction_id", F.lit("test").alias("split"))))


@query
def split_stats(spark, d):
    df = txn_events(spark, d)
    return split.split_stats(df, split.calculate_split(df, **SPLIT))


@query
def leakage_report(spark, d):
    df = txn_events(spark, d)
    dates = split.calculate_split(df, **SPLIT)
    train, test = split.temporal_split(df, dates)
    return split.leakage_report(train, test, dates)


@query
def validation_tail(spark, d):
    df = txn_events(spark, d)
    train, _ = split.temporal_split(df, split.calculate_split(df, **SPLIT))
    return split.validation_tail(train).select("transaction_id", "is_validation")


# -- detectors, comparisons, set operations ------------------------------------

@query
def device_rings(spark, d):
    return detect.shared_devices(txn_events(spark, d), 3)


@query
def ring_members(spark, d):
    return detect.ring_members(txn_events(spark, d), 3)


@query
def active_payers(spark, d):
    return detect.active_payers(txn_events(spark, d), 10)


@query
def velocity_spikes(spark, d):
    return detect.velocity_spikes(txn_orders(spark, d), min_txns=4, seconds=10 * 86400)


@query
def velocity_spikes_hot(spark, d):
    """The same bursts when every payer takes the sliced path."""
    df = txn_orders(spark, d)
    hot = heat.profile_keys(df, "payer_id", hot_rows=1).hot
    profile = heat.KeyProfile(hot, heat.HOT_ROWS, 100 * 86400 * 10**6)
    return detect.velocity_spikes(df, min_txns=4, seconds=10 * 86400, profile=profile)


@query
def night_anomalies(spark, d):
    return rounded(detect.night_anomalies(txn_events(spark, d)))


@query
def pattern_members(spark, d):
    return detect.pattern_members(_gated(spark, d), "ring")


@query
def batch_stream_diff(spark, d):
    """The table against a copy without errors and with whole amounts."""
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "payee_vpa", "amount")
    other = (df.filter(F.col("payee_vpa") != "merchant_error@upi")
             .withColumn("amount", F.floor("amount").cast("double")))
    return compare.batch_stream_diff(df, other).select("transaction_id", "column")


@query
def union_train_test(spark, d):
    df = txn_events(spark, d).select("transaction_id", "amount", "payee_vpa", F.col("is_fraud").cast("double"))
    test = F.col("payee_vpa") == "merchant_view@upi"
    return etl.union_sets(df.filter(~test), df.filter(test).drop("is_fraud"))


@query
def top_scores(spark, d):
    return tables.top_scores(txn_events(spark, d).select("transaction_id", "fraud_probability"), 10)


@query
def first_by_time(spark, d):
    return tables.first_by_time(txn_orders(spark, d), 100).select("transaction_id", "payer_id")


@query
def sampled_rows(spark, d):
    return tables.sample_rows(txn_events(spark, d), 100).select("transaction_id", "amount")


@query
def labelled_rows(spark, d):
    df = txn_events(spark, d)
    df = df.withColumn("is_fraud", F.when(F.col("payee_vpa") != "merchant_view@upi", F.col("is_fraud")))
    return (tables.labelled(df).select("transaction_id", F.lit("labelled").alias("part"))
            .unionByName(tables.unlabelled(df).select("transaction_id", F.lit("unlabelled").alias("part"))))


@query
def training_table(spark, d):
    """Features joined to the raw columns they do not have."""
    raw = txn_events(spark, d)
    out = etl.join_raw(features.build_features(raw), raw)
    return rounded(out.select("transaction_id", "payer_id", "payee_vpa", "amount", "currency",
                              "payer_txn_count_24h", "device_txn_count_24h", "is_fraud"))


@query
def distinct_devices(spark, d):
    return txn_events(spark, d).select("payer_id", "device_id").distinct()


@query
def id_overlap(spark, d):
    """Two overlapping periods."""
    df, t = txn_events(spark, d), F.col("event_timestamp")
    return split.id_overlap(df.filter(t < F.lit("2024-01-20").cast("timestamp")),
                            df.filter(t >= F.lit("2024-01-10").cast("timestamp")))


# -- models --------------------------------------------------------------------

def _model_table(spark, d):
    return scoring.model_table(txn_events(spark, d).drop("fraud_probability", "payer_vpa"))


@query
def scaled_features(spark, d):
    df = txn_events(spark, d).select("transaction_id", "amount", "fraud_probability")
    return rounded(preparation.scale(df, preparation.fit_scaler(df, ["amount", "fraud_probability"])))


@query
def aligned_matrix(spark, d):
    df = txn_events(spark, d)
    i = F.col("transaction_id").cast("long")
    df = df.select("transaction_id", F.when(i % 7 != 0, F.col("amount")).alias("amount"),
                   F.when(i % 5 == 0, F.lit("x")).otherwise(F.col("amount").cast("string")).alias("V1"),
                   F.when(i % 11 == 0, F.lit(float("inf"))).otherwise(F.lit(1.5)).alias("V2"))
    return rounded(preparation.align_features(df, ["V2", "amount", "V1", "V9"], 0.0))


@query
def class_weight(spark, d):
    return rounded(preparation.class_weight(txn_events(spark, d)))


@query
def label_encode(spark, d):
    """Codes of the categories, with NULL as a category."""
    df = txn_events(spark, d)
    i = F.col("transaction_id").cast("long")
    df = df.withColumn("device_id", F.when(i % 13 != 0, F.col("device_id")))
    return preparation.category_codes(df, ["payee_vpa", "device_id"])


@query
def encoded_rows_joined(spark, d):
    """The same codes when every column has too many values for a list."""
    df = txn_events(spark, d).select(
        "transaction_id", "event_timestamp", "payee_vpa",
        F.when(F.col("amount") > 5, F.concat_ws("/", "device_id", "payee_vpa")).alias("pair"))
    early = df.filter(F.col("event_timestamp") < F.lit("2024-01-10").cast("timestamp"))
    enc = preparation.fit_encoder(early, ["pair", "payee_vpa"], max_categories=1)
    return enc.transform(df).select("transaction_id", F.col("pair").cast("long").alias("pair_code"),
                                    F.col("payee_vpa").cast("long").alias("payee_code"))


@query
def encoded_rows(spark, d):
    """Encoder fitted on the earlier rows; unseen values take the code of missing."""
    df = txn_events(spark, d).select(
        "transaction_id", "event_timestamp", "payee_vpa",
        F.when(F.col("amount") > 5, F.concat_ws("/", "device_id", "payee_vpa")).alias("pair"))
    early = df.filter(F.col("event_timestamp") < F.lit("2024-01-10").cast("timestamp"))
    enc = preparation.fit_encoder(early, ["pair", "payee_vpa"])
    return enc.transform(df).select("transaction_id", F.col("pair").cast("long").alias("pair_code"),
                                    F.col("payee_vpa").cast("long").alias("payee_code"))


@query
def anomaly_scores(spark, d):
    f = materialise(features.build_features(txn_events(spark, d)), "features")
    return anomaly.train_and_score(f, keep=["transaction_id"])[1].select("transaction_id", r4("anomaly_score"))


@query
def anomaly_top_precision(spark, d):
    """Frauds among the one percent most anomalous rows."""
    df = txn_events(spark, d)
    f = materialise(features.build_features(df), "features")
    scored = anomaly.train_and_score(f, keep=["transaction_id", "event_timestamp"])[1].join(
        df.select("transaction_id", "is_fraud"), "transaction_id")
    scored = materialise(scored.select("transaction_id", "event_timestamp", "is_fraud", "anomaly_score"), "anomaly")
    cut = alerts.budget_threshold(scored, 0.01, "anomaly_score")
    return rounded(scored.crossJoin(F.broadcast(cut)).filter("anomaly_score >= threshold").agg(
        F.count(F.lit(1)).alias("n_flagged"), F.avg("is_fraud").alias("precision")))


@query
def anomaly_contract(spark, d):
    """What the anomaly stage finds in a table: columns it may use, must not use, and misses."""
    df = features.build_features(txn_events(spark, d)).drop("payer_txn_sum_1h").withColumn("is_fraud", F.lit(0))
    return anomaly.contract_report(df).join(df.agg(F.count(F.lit(1)).alias("n_rows")))


@query
def model_inputs(spark, d):
    """The columns a model may be trained on, with their kind and how many rows have a value."""
    df = _model_table(spark, d)
    kinds = dict(zip(("numeric", "category"), preparation.split_by_type(df, preparation.model_columns(df))))
    values = df.agg(*[F.count(c).alias(c) for cs in kinds.values() for c in cs])
    return values.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.col(c).alias("n_values"))
                                             for kind, cs in kinds.items() for c in cs])).alias("x")).select("x.*")


@query
def anomaly_importance(spark, d):
    f = materialise(features.build_features(txn_events(spark, d)), "features")
    return rounded(anomaly.permutation_importance(anomaly.train_forest(f), f))


@query
def model_node_tables(spark, d):
    """Forest and boosted trees as node tables walked by joins, against the models themselves, before and after they are saved."""
    table_ = materialise(_model_table(spark, d), "model-table")
    root = f"{shared_dir(spark)}/models/nodes-{uuid.uuid4().hex}"
    done = training.run_training(table_, test_days=7, output=root)
    test = materialise(split.temporal_split(table_, done.dates)[1], "test-rows")
    forest = anomaly.IsolationForest.load(spark, f"{root}/forest")
    model = supervised.SupervisedModel.load(spark, f"{root}/model")
    tables_ = {"forest": nodes.forest_nodes(spark, forest), "boosted": nodes.boosted_nodes(spark, f"{root}/model")}
    stored = {k: materialise(t, "nodes") for k, t in tables_.items()}
    scored = materialise(done.forest.score(test), "scored")
    walked = {"forest": materialise(nodes.forest_scores(test, forest, stored["forest"]), "walked"),
              "boosted": materialise(nodes.boosted_scores(scored, model, stored["boosted"]), "walked")}
    kept = {("forest", "trained"): scored.select("transaction_id", "anomaly_score"),
            ("forest", "loaded"): forest.score(test).select("transaction_id", "anomaly_score"),
            ("boosted", "trained"): done.test_scores.select("transaction_id", "fraud_probability"),
            ("boosted", "loaded"): model.predict(scored)}
    rows = None
    for (name, when), own in kept.items():
        part = compare.difference_counts(own, walked[name], atol=1e-9).select(F.lit(name).alias("model"), F.lit(when).alias("stage"), "*")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def _trained(spark, d, **kw):
    table_ = materialise(_model_table(spark, d), "model-table")
    return training.run_training(table_, test_days=7, **kw)


def _fitted(table_):
    """A model of all labelled rows; their latest part tells when to stop."""
    rows = materialise(split.validation_tail(table_.filter(F.col("is_fraud").isin(0, 1))), "train")
    return supervised.train_supervised(rows, validation="is_validation")


@query
def gbt_scores(spark, d):
    return _trained(spark, d, two_stage=False).test_scores.select("transaction_id", r4("fraud_probability"))


@query
def two_stage_report(spark, d):
    return rounded(_trained(spark, d).report)


@query
def feature_importance(spark, d):
    return rounded(_trained(spark, d).model.importance())


@query
def stage_comparison(spark, d):
    table_ = materialise(_model_table(spark, d), "model-table")
    return rounded(training.compare_stages(table_, test_days=7))


@query
def batch_score(spark, d):
    """Scores of the unlabelled rows, with features over the whole history."""
    df = txn_events(spark, d).drop("fraud_probability", "payer_vpa")
    late = F.col("event_timestamp") >= F.lit("2024-01-25").cast("timestamp")
    df = df.withColumn("is_fraud", F.when(~late, F.col("is_fraud")))
    table_ = materialise(scoring.model_table(df), "model-table")
    model = _fitted(table_)
    return scoring.score_unlabelled(df, model).select("transaction_id", r4("fraud_probability"))


@query
def backtest_range(spark, d):
    out = scoring.run_backtest(txn_events(spark, d), "2024-01-08", "2024-01-14", BUDGET)
    return rounded(out["daily"])


# -- streams -------------------------------------------------------------------

DROP_FILES = 8      # files of a drop
LEAST_ROWS = 100_000  # of a drop that is cut into files


def _dropped(drops: list[DataFrame], path: str) -> int:
    """Write the drops of a stream one after the other; each is as many files (the result), which one trigger takes."""
    rows = [df.count() for df in drops]
    files = DROP_FILES if min(rows) >= LEAST_ROWS else 1
    for df in drops:
        (df.repartition(files) if files > 1 else df.coalesce(1)).write.mode("append").parquet(path)
    return files


def _parted(df: DataFrame, slot: Column, parts: int) -> list[DataFrame]:
    """The rows by slot, each read from files of its own; ``df`` is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/streams/parted-{uuid.uuid4().hex}"
    df.withColumn("_slot", slot.cast("int")).write.partitionBy("_slot").parquet(path)
    table_ = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_slot", T.IntegerType())])).parquet(path)
    return [table_.where(F.col("_slot") == i).drop("_slot") for i in range(parts)]


def _staged(df: DataFrame, name: str, parts: int = 3) -> tuple[str, str, int]:
    """Lay the table out as ``parts`` time-ordered drops of a stream; (folder, source path, files a drop)."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/streams/{name}-{uuid.uuid4().hex}"
    r = df.agg(F.min("event_timestamp").cast("double"), F.max("event_timestamp").cast("double")).first()
    width = (r[1] - r[0]) / parts
    slot = F.least(F.lit(parts - 1), F.floor((F.col("event_timestamp").cast("double") - r[0]) / width))
    return root, f"{root}/source", _dropped(_parted(df, slot, parts), f"{root}/source")


def _feature_stream(df: DataFrame, name: str, **kw) -> FeatureStream:
    """The stream of ``df``, run to its end."""
    spark = df.sparkSession
    root, src, files = _staged(df, name)
    stream = FeatureStream(spark, f"{root}/out", **kw)
    stream.run(source.read_events(spark, src, df.schema, files), f"{root}/checkpoint")
    return stream


@query
def stream_features_parity(spark, d):
    """Features of the streamed events; the batch result is the yardstick."""
    df = txn_events(spark, d).drop("fraud_probability", "payer_vpa", "currency")
    return rounded(_feature_stream(df, "features").read("features").drop("event_timestamp", "batch_id"))


@query
def stream_parity_differences(spark, d):
    """Batch features against streamed ones, and against streamed ones that were damaged on purpose."""
    df = txn_events(spark, d).drop("fraud_probability", "payer_vpa", "currency")
    batch = materialise(features.build_features(df), "features")
    streamed = materialise(_feature_stream(df, "parity").read("features").drop("batch_id"), "streamed")
    i = F.col("transaction_id").cast("long")
    damaged = streamed.filter(i % 97 != 0).withColumns({
        "payer_txn_count_24h": F.col("payer_txn_count_24h") + F.when(i % 50 == 0, 1).otherwise(0),
        "device_txn_count_1h": F.when(i % 61 != 0, F.col("device_txn_count_1h"))})
    parts = [compare.difference_counts(batch, other).select(F.lit(name).alias("against"), "*")
             for name, other in (("streamed", streamed), ("damaged", damaged))]
    return parts[0].unionByName(parts[1])


LATENESS_DAYS = 20


def delayed_orders(spark: SparkSession, d: str, parts: int = 4) -> DataFrame:
    """Orders with the number of the drop in which they arrive: some come days or months after their time.

    Fifty payers, five devices, days as times, and amounts that are infinite, not a number or too large for money.
    """
    i = F.col("transaction_id").cast("long")
    delay = F.when(i % 9 == 0, 45).when(i % 7 == 0, 10).otherwise(0)
    odd = F.when(i % 31 == 0, float("inf")).when(i % 37 == 0, float("nan")).when(i % 41 == 0, 1e300).otherwise(F.col("amount"))
    arrival = F.datediff("event_timestamp", F.lit("1992-01-01").cast("date")) + delay
    return txn_orders(spark, d).drop("fraud_probability").withColumn("amount", odd).withColumn(
        "arrival", F.least(F.lit(parts - 1), F.floor(arrival / 700)).cast("long"))


@query
def stream_out_of_order(spark, d):
    """Keyed features of a stream whose rows come out of order: exact for all that are not late; late ones are told apart."""
    df = delayed_orders(spark, d)
    root = f"{shared_dir(spark)}/streams/delayed-{uuid.uuid4().hex}"
    files = _dropped([p.drop("arrival") for p in _parted(df, F.col("arrival"), 4)], f"{root}/source")
    stream = FeatureStream(spark, f"{root}/out", lateness_seconds=LATENESS_DAYS * 86400)
    stream.run(source.read_events(spark, f"{root}/source", df.drop("arrival").schema, files), f"{root}/checkpoint")
    rows = stream.read("rows")
    shown = [F.when(~F.col("is_late"), F.col(c)).alias(c) for c in FEATURES]
    return rounded(rows.select("transaction_id", "is_late", *shown))


@query
def stream_late_rows(spark, d):
    """The table of late rows of an unordered stream, per payer."""
    df = delayed_orders(spark, d)
    root = f"{shared_dir(spark)}/streams/late-{uuid.uuid4().hex}"
    files = _dropped([p.drop("arrival") for p in _parted(df, F.col("arrival"), 4)], f"{root}/source")
    stream = FeatureStream(spark, f"{root}/out", lateness_seconds=LATENESS_DAYS * 86400)
    stream.run(source.read_events(spark, f"{root}/source", df.drop("arrival").schema, files), f"{root}/checkpoint")
    return stream.read("late").groupBy("payer_id").agg(F.count(F.lit(1)).alias("n_late"), F.min(micros("event_timestamp")).alias("first_us"))


@query
def stream_label_feed(spark, d):
    """Labels arrive as a stream of their own, when they become known."""
    df = txn_events(spark, d).drop("fraud_probability", "payer_vpa", "currency")
    r = df.agg(F.min(micros("event_timestamp")), F.max(micros("event_timestamp"))).first()
    slot = lambda us: F.least(F.lit(2), F.floor((us - r[0]) * 3 / (r[1] - r[0] + 1)))
    frauds = df.filter("is_fraud = 1").select("transaction_id", "payer_id", "event_timestamp", "label_available_timestamp")
    root = f"{shared_dir(spark)}/streams/labels-{uuid.uuid4().hex}"
    bare = df.withColumns({"is_fraud": F.lit(None).cast("int"), "label_available_timestamp": F.lit(None).cast("timestamp")})
    # one drop of each source per micro-batch
    files = _dropped(_parted(bare, slot(micros("event_timestamp")), 3), f"{root}/source")
    said = _dropped(_parted(frauds, slot(F.greatest(micros("event_timestamp"), micros("label_available_timestamp"))), 3), f"{root}/labels")
    stream = FeatureStream(spark, f"{root}/out", labels=source.read_events(spark, f"{root}/labels", frauds.schema, said))
    stream.run(source.read_events(spark, f"{root}/source", bare.schema, files), f"{root}/checkpoint")
    return rounded(stream.read("features").drop("event_timestamp", "batch_id"))


@query
def stream_alert_policy(spark, d):
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "payee_vpa", "fraud_probability")
    root, src, files = _staged(df, "policy")
    events = source.read_events(spark, src, df.schema, files)
    source.append_to(policy.alert_stream(events, "payee_vpa", BUDGET, window=300), f"{root}/checkpoint", f"{root}/out")
    return spark.read.parquet(f"{root}/out").select("transaction_id", "should_alert", "budget_exceeded", "daily_count")


@query
def stream_daily_metrics(spark, d):
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "fraud_probability", F.col("amount").alias("latency_ms"),
                                     (F.col("fraud_probability") > 0.2).alias("alert"),
                                     (F.col("payee_vpa") == "merchant_error@upi").alias("error"))
    root, src, files = _staged(df, "metrics")
    out = f"{root}/out"
    source.run_to_end(policy.daily_service_metrics(source.read_events(spark, src, df.schema, files)),
                      f"{root}/checkpoint", lambda b, i: b.write.mode("overwrite").parquet(out), "complete")
    return rounded(spark.read.parquet(out))


@query
def stream_gate(spark, d):
    df = _gated(spark, d).select("transaction_id", "event_timestamp", "amount", "currency",
                                 "label_available_timestamp")
    root, src, files = _staged(df, "gate")
    events = source.read_events(spark, src, df.schema, files)
    source.run_to_end(events, f"{root}/checkpoint", source.gated(events, f"{root}/passed", f"{root}/stopped"))
    return spark.read.parquet(f"{root}/stopped").select("transaction_id")


@query
def stream_deduplicated(spark, d):
    """Clicks are sent twice."""
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "amount", "payee_vpa")
    twice = df.unionByName(df.filter(F.col("payee_vpa") == "merchant_click@upi"))
    root, src, files = _staged(twice, "dedup")
    events = source.deduplicate(source.read_events(spark, src, df.schema, files))
    source.append_to(events, f"{root}/checkpoint", f"{root}/out")
    return spark.read.parquet(f"{root}/out").select("transaction_id", "amount")


@query
def stream_seek(spark, d):
    df = txn_events(spark, d).select("transaction_id", "event_timestamp")
    root, src, files = _staged(df, "seek")
    events = source.read_events(spark, src, df.schema, files, start="2024-01-20")
    source.append_to(events, f"{root}/checkpoint", f"{root}/out")
    return spark.read.parquet(f"{root}/out").select("transaction_id")


@query
def stream_scores(spark, d):
    """Streamed rows scored by a model trained on the batch table."""
    df = txn_events(spark, d).drop("fraud_probability", "payer_vpa", "currency")
    table_ = materialise(scoring.model_table(df), "model-table")
    model = _fitted(table_)
    return _feature_stream(df, "scores", model=model).read("scores").select("transaction_id", r4("fraud_probability"), "risk_tier")


@query
def stream_keyed_features(spark, d):
    """The same features from bounded per-key state."""
    df = txn_events(spark, d).drop("fraud_probability", "payer_vpa", "currency")
    root, src, files = _staged(df, "keyed")
    keyed.use_rocksdb(spark)
    events = source.read_events(spark, src, df.schema, files)
    source.append_to(keyed.keyed_features(events), f"{root}/checkpoint", f"{root}/out")
    return rounded(spark.read.parquet(f"{root}/out").drop("event_timestamp"))


# -- sources and sinks ---------------------------------------------------------

@query
def csv_to_table(spark, d):
    """CSV with a declared schema into the date-partitioned table, and back."""
    root = f"{shared_dir(spark)}/tables/csv-{uuid.uuid4().hex}"
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "payer_id", "amount")
    tables.write_csv(df, f"{root}/csv")
    tables.csv_to_table(spark, f"{root}/csv", f"{root}/table", df.schema)
    back = tables.read_transactions(spark, f"{root}/table")
    return back.select("transaction_id", micros("event_timestamp").alias("event_us"), "payer_id", r4("amount"),
                       F.col("event_date").cast("string").alias("event_date"))


@query
def csv_with_time_format(spark, d):
    """CSV whose times are written day first, read by a declared format."""
    path = f"{shared_dir(spark)}/tables/format-{uuid.uuid4().hex}"
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "amount")
    form = "dd/MM/yyyy HH:mm:ss.SSSSSS"
    df.write.option("header", True).option("timestampFormat", form).csv(path)
    return tables.read_csv(spark, path, df.schema, form).select(
        "transaction_id", micros("event_timestamp").alias("event_us"), r4("amount"))


@query
def feature_sink(spark, d):
    """Features written as a table and read back, without the excluded columns."""
    path = f"{shared_dir(spark)}/tables/features-{uuid.uuid4().hex}"
    df = txn_events(spark, d).select("transaction_id", "event_timestamp", "payer_id", "amount")
    tables.write_table(history.payer_velocity(df), path)
    return rounded(tables.project_excluding(spark.read.parquet(path), "event_timestamp", "amount"))


@query
def replaced_column(spark, d):
    """One column takes another's place: one column of that name, with its values."""
    path = f"{shared_dir(spark)}/tables/replaced-{uuid.uuid4().hex}"
    df = txn_events(spark, d).select("transaction_id", "payer_id", "device_id")
    tables.write_table(tables.replace_column(df, "device_id", "payer_id"), path)
    return spark.read.parquet(path)


@query
def raw_column_families(spark, d):
    """The columns of some raw families, by their patterns, with the number of values in each."""
    e = txn_events(spark, d)
    raw = e.select("transaction_id", F.col("amount").alias("V1"), F.col("amount").alias("V12x"), F.col("payer_id").alias("id-02"),
                   F.col("device_id").alias("card3"), F.col("payee_vpa").alias("R_emaildomain"))
    names = tables.raw_columns(raw, ("V", "id", "email"))
    return raw.agg(*[F.count(f"`{c}`").alias(c) for c in names]).select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("n")) for c in names])).alias("x")).select("x.*")


@query
def one_day_scan(spark, d):
    """One event date of the partitioned table: the others are not read."""
    root = f"{shared_dir(spark)}/tables/day-{uuid.uuid4().hex}"
    tables.write_transactions(txn_events(spark, d), root)
    day = tables.read_transactions(spark, root, start="2024-01-15", end="2024-01-15")
    return day.select("transaction_id", r4("amount"))


@query
def report_round_trip(spark, d):
    """Daily metrics written as JSON rows and read back."""
    path = f"{shared_dir(spark)}/tables/report-{uuid.uuid4().hex}"
    daily = rounded(_daily(spark, d))
    tables.write_report(daily, path)
    return tables.read_report(spark, path, daily.schema)


@query
def sorted_table(spark, d):
    """A globally time-sorted table; each of its files is in order."""
    path = f"{shared_dir(spark)}/tables/sorted-{uuid.uuid4().hex}"
    tables.write_sorted(txn_events(spark, d).select("event_timestamp", "transaction_id"), path)
    order = quality.file_order(spark.read.parquet(path), "event_timestamp")
    return order.agg(F.min("increasing_share").alias("lowest_share"), F.min("success").alias("in_order")).crossJoin(
        spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")))
