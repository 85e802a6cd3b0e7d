"""Features, alerts and daily metrics as one job over the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskengine.fixtures import txn_events
from riskengine.operators.alerts import daily_alerts
from riskengine.operators.features import build_features
from riskengine.operators.metrics import daily_metrics
from riskengine.session import use_utc


def feature_backtest(spark: SparkSession, sf_dir: str, budget: float = 0.01) -> DataFrame:
    df = txn_events(use_utc(spark), sf_dir)
    daily = daily_metrics(daily_alerts(
        df.select("transaction_id", "event_timestamp", "fraud_probability", "is_fraud"), budget))
    feats = build_features(df).groupBy(F.to_date("event_timestamp").alias("event_date")).agg(
        F.avg("payer_txn_count_24h").alias("avg_payer_txn_count_24h"),
        F.max("device_distinct_payers_7d").alias("max_device_distinct_payers"),
        F.sum("payer_past_fraud_count_30d").alias("known_frauds"))
    return daily.join(feats, "event_date")
