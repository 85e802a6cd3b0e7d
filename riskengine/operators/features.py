"""The closed 13-column feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskengine.functions.identity import UNKNOWN_DEVICE
from riskengine.functions.timing import micros
from riskengine.operators.heat import KeyProfile, profile_keys
from riskengine.operators.history import (DEVICE_WINDOWS, LAST_ROWS, PAYER_WINDOWS, RISK_DAYS,
                                          EntityFeatures, entity_features)
from riskengine.session import materialise
from riskengine.schema import FEATURE_SCHEMA, assert_feature_schema, require_columns

PAYER_SPEC = EntityFeatures(
    "payer_id",
    counts=tuple((f"payer_txn_count_{n}", s) for n, s in PAYER_WINDOWS.items()),
    sums=tuple((f"payer_txn_sum_{n}", s) for n, s in PAYER_WINDOWS.items()),
    distinct=(("payer_distinct_payees_7d", "payee_vpa", "rows", LAST_ROWS),),
    risk=(("payer_past_fraud_count_30d", RISK_DAYS),))

DEVICE_SPEC = EntityFeatures(
    "device_id",
    counts=tuple((f"device_txn_count_{n}", s) for n, s in DEVICE_WINDOWS.items()),
    distinct=(("device_distinct_payers_7d", "payer_id", "rows", LAST_ROWS),))

INPUTS = ["transaction_id", "event_timestamp", "payer_id", "device_id", "payee_vpa", "amount",
          "is_fraud", "label_available_timestamp"]


def build_features(df: DataFrame, *, payer_profile: KeyProfile | None = None,
                   device_profile: KeyProfile | None = None,
                   sentinel_mode: str = "parity") -> DataFrame:
    """All point-in-time features of every row: one exchange per entity, no join.

    ``sentinel_mode="null"`` treats the unknown-device sentinel as no device, so
    its features are zero and its rows skip the device shuffle.
    """
    require_columns(df, *INPUTS)
    rows = df.select(*INPUTS).withColumns({
        "transaction_id": F.col("transaction_id").cast("string"),
        "_us": micros("event_timestamp")})
    if sentinel_mode == "null":
        rows = rows.withColumn("device_id", F.when(F.col("device_id") != UNKNOWN_DEVICE,
                                                   F.col("device_id")))
    elif sentinel_mode != "parity":
        raise ValueError("sentinel_mode is 'parity' or 'null'")
    payer_profile = payer_profile or profile_keys(rows, "payer_id")
    device_profile = device_profile or profile_keys(rows, "device_id")
    by_payer = entity_features(rows, PAYER_SPEC, profile=payer_profile)
    kept = [c for c in FEATURE_SCHEMA.names if c in by_payer.columns]
    by_payer = by_payer.select(*kept, "payer_id", "device_id", "_us")
    if device_profile.hot:  # several branches read it; run the payer stage once
        by_payer = materialise(by_payer, "payer-features")
    by_device = entity_features(by_payer, DEVICE_SPEC, profile=device_profile)
    return assert_feature_schema(by_device.select(*FEATURE_SCHEMA.names))
