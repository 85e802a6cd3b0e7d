"""Detectors for the known fraud patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskengine.functions.timing import SECOND, event_date, is_night, micros
from riskengine.operators.heat import KeyProfile, next_time, profile_keys, row_running
from riskengine.operators.history import EntityFeatures, entity_features
from riskengine.session import materialise


def shared_devices(df: DataFrame, min_payers: int = 3) -> DataFrame:
    """Devices used by at least ``min_payers`` payers, with their volume."""
    pairs = df.groupBy("device_id", "payer_id").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_fraud") == 1, 1)).alias("f"))
    return (pairs.groupBy("device_id").agg(
        F.count("payer_id").alias("n_payers"), F.sum("n").alias("n_txns"), F.sum("f").alias("n_fraud"))
        .filter((F.col("n_payers") >= min_payers) & F.col("device_id").isNotNull()))


def ring_members(df: DataFrame, min_payers: int = 3) -> DataFrame:
    """One row per (ring device, payer): members stay rows, not one list per device."""
    pairs = (df.filter(F.col("payer_id").isNotNull()).groupBy("device_id", "payer_id")
             .agg(F.count(F.lit(1)).alias("n_txns")))
    return pairs.join(shared_devices(df, min_payers).select("device_id", "n_payers"), "device_id")


def active_payers(df: DataFrame, min_legit: int = 10) -> DataFrame:
    return (df.filter(F.col("is_fraud") == 0).groupBy("payer_id")
            .agg(F.count(F.lit(1)).alias("n_legit")).filter(F.col("n_legit") >= min_legit))


def velocity_spikes(df: DataFrame, min_txns: int = 10, seconds: int = 300,
                    profile: KeyProfile | None = None) -> DataFrame:
    """Bursts of at least ``min_txns`` of a payer's transactions within the span.

    A hit is a row with ``min_txns - 1`` predecessors in [T - span, T); hits of a
    payer no further apart than the span form one burst.
    """
    profile = profile or profile_keys(df, "payer_id")
    narrow = df.select("transaction_id", "event_timestamp", "payer_id", "amount")
    spec = EntityFeatures("payer_id", counts=(("_before", seconds),))
    hits = (entity_features(narrow, spec, profile=profile)
            .filter(F.col("_before") >= min_txns - 1).withColumn("_us", micros("event_timestamp")))
    slice_us = None
    if profile.hot:
        hits, slice_us = materialise(hits, "hits"), profile.slice_us
    hits = next_time(hits, ["payer_id"], "_us", "transaction_id", "_next", slice_us)
    closes = F.when(F.col("_next") - F.col("_us") > seconds * SECOND, 1).otherwise(0)
    hits = row_running(hits, ["payer_id"], "_us", "transaction_id",
                       {"_burst": ("sum", closes)}, slice_us, last=-1)
    return hits.groupBy("payer_id", F.coalesce("_burst", F.lit(0)).alias("burst")).agg(
        F.min("_us").alias("first_hit_us"), F.max("_us").alias("last_hit_us"),
        F.count(F.lit(1)).alias("n_hits"), (F.max("_before") + 1).alias("peak_txns"))


def night_anomalies(df: DataFrame) -> DataFrame:
    """Transactions from 02:00 to 04:59 and their share, per payer."""
    night = is_night("event_timestamp")
    g = df.groupBy("payer_id").agg(
        F.count(F.lit(1)).alias("n_txns"), F.count(F.when(night, 1)).alias("n_night"),
        F.count(F.when(night & (F.col("is_fraud") == 1), 1)).alias("n_night_fraud"))
    return g.filter(F.col("n_night") > 0).withColumn("night_share", F.col("n_night") / F.col("n_txns"))


def pattern_members(df: DataFrame, pattern: str) -> DataFrame:
    """The distinct payers, devices and days of one tagged pattern."""
    return (df.filter(F.col("fraud_pattern") == pattern)
            .select("fraud_pattern", "payer_id", "device_id",
                    event_date("event_timestamp").cast("string").alias("event_date")).distinct())
