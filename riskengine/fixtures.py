"""Adapters that give the TPC-H-like test tables a transaction shape.

Labels here are rules over the table columns, not real fraud.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskengine.functions.timing import plus_hours


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        ts.alias("event_timestamp"),
        F.concat(F.lit("u"), "user_id").alias("payer_id"),
        F.concat(F.lit("user_"), "user_id", F.lit("@upi")).alias("payer_vpa"),
        F.concat(F.lit("d"), F.get_json_object("props", "$.k")).alias("device_id"),
        F.concat(F.lit("merchant_"), "event_type", F.lit("@upi")).alias("payee_vpa"),
        F.col("value").alias("amount"),
        F.lit("INR").alias("currency"),
        ((F.col("event_type") == "error") & (F.col("value") > 100)).cast("int").alias("is_fraud"),
        plus_hours(ts, (F.lit(6) + (F.col("event_id") * 37) % 66)).alias("label_available_timestamp"),
        F.round(F.col("value") / 500, 6).alias("fraud_probability"))


def txn_orders(spark: SparkSession, sf_dir: str, payers: int = 50) -> DataFrame:
    """Orders as transactions; few payers and day-granular times give many ties."""
    o = table(spark, sf_dir, "orders")
    ts = F.col("o_orderdate").cast("timestamp")
    return o.select(
        F.col("o_orderkey").cast("string").alias("transaction_id"),
        ts.alias("event_timestamp"),
        (F.col("o_custkey") % payers).cast("string").alias("payer_id"),
        F.col("o_orderpriority").alias("device_id"),
        F.concat("o_orderpriority", "o_orderstatus").alias("payee_vpa"),
        F.col("o_totalprice").alias("amount"),
        (F.col("o_orderkey") % 11 == 0).cast("int").alias("is_fraud"),
        plus_hours(ts, (F.lit(6) + (F.col("o_orderkey") * 37) % 66)).alias("label_available_timestamp"),
        F.round(F.col("o_totalprice") / 600000, 6).alias("fraud_probability"))


def txn_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as transactions, for runs at the size of the published baseline.

    Their keys repeat, so the id is a hash of the whole row; not for row checks.
    """
    li = table(spark, sf_dir, "lineitem")
    ts = F.col("l_shipdate").cast("timestamp")
    return li.select(
        F.xxhash64(*li.columns).cast("string").alias("transaction_id"),
        plus_hours(ts, F.col("l_orderkey") % 24).alias("event_timestamp"),
        F.concat(F.lit("u"), F.col("l_partkey")).alias("payer_id"),
        F.concat(F.lit("d"), F.col("l_suppkey")).alias("device_id"),
        F.concat(F.lit("m"), F.col("l_suppkey") % 50).alias("payee_vpa"),
        F.col("l_extendedprice").alias("amount"),
        ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 29 == 0).cast("int").alias("is_fraud"),
        plus_hours(ts, 48).alias("label_available_timestamp"))
