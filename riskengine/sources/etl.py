"""Raw card transactions and identities into the payment-shaped table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskengine.functions.identity import (CARD_COLUMNS, device_hash, payee_address, payer_address,
                                           payer_hash)
from riskengine.functions.timing import from_origin, plus_hours

LABEL_DELAY_HOURS = 48


def merge_identity(txn: DataFrame, identity: DataFrame, key: str = "TransactionID") -> DataFrame:
    """Every transaction, with its identity columns where there are any."""
    return txn.join(identity, key, "left")


def assert_row_preserving(identity: DataFrame, key: str = "TransactionID") -> None:
    """A left join keeps the row count when the right key is unique."""
    twice = identity.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(5).collect()
    if twice:
        raise ValueError(f"identity key not unique, e.g. {[r[key] for r in twice]}")


def standardise(df: DataFrame, train: bool, origin: str = "2025-01-01 00:00:00") -> DataFrame:
    """Names, event time from relative seconds, label column, label time, currency."""
    df = df.withColumnsRenamed({"TransactionID": "transaction_id", "TransactionAmt": "amount"})
    df = df.withColumn("event_timestamp", from_origin("TransactionDT", origin))
    if train:
        df = df.withColumnRenamed("isFraud", "is_fraud")
    else:
        df = df.withColumn("is_fraud", F.lit(None).cast("double"))
    return df.withColumns({
        "label_available_timestamp": plus_hours("event_timestamp", LABEL_DELAY_HOURS),
        "currency": F.lit("INR")})


def to_payment_shape(df: DataFrame) -> DataFrame:
    """Payer, payee and device identities out of the raw columns."""
    cards = [c for c in CARD_COLUMNS if c in df.columns]
    device = F.col("DeviceInfo") if "DeviceInfo" in df.columns else F.lit(None).cast("string")
    df = df.withColumns({"payer_id": payer_hash(*cards), "device_id": device_hash(device),
                         "payee_vpa": payee_address("ProductCD")})
    df = df.withColumn("payer_vpa", payer_address("payer_id"))
    if "DeviceType" not in df.columns:
        df = df.withColumn("DeviceType", F.lit(None).cast("string"))
    return df


def union_sets(*parts: DataFrame) -> DataFrame:
    """Stack tables whose columns differ; absent ones are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def generate_dataset(train_txn: DataFrame, train_identity: DataFrame, test_txn: DataFrame,
                     test_identity: DataFrame) -> DataFrame:
    """The whole preparation as one lazy plan; write it with ``write_transactions``."""
    parts = [to_payment_shape(standardise(merge_identity(t, i), is_train))
             for t, i, is_train in ((train_txn, train_identity, True),
                                    (test_txn, test_identity, False))]
    return union_sets(*parts)


def join_raw(features: DataFrame, raw: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Features with the raw columns they do not already have."""
    overlap = [c for c in raw.columns if c in features.columns and c != key]
    return features.join(raw.drop(*overlap).withColumn(key, F.col(key).cast("string")), key)
