"""Column contracts shared by every job."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T

TXN_CORE = T.StructType([
    T.StructField("transaction_id", T.StringType(), False),
    T.StructField("event_timestamp", T.TimestampType(), False),
    T.StructField("amount", T.DoubleType(), False),
    T.StructField("currency", T.StringType(), True),
    T.StructField("payer_id", T.StringType(), True),
    T.StructField("payer_vpa", T.StringType(), False),
    T.StructField("payee_vpa", T.StringType(), False),
    T.StructField("device_id", T.StringType(), False),
    T.StructField("is_fraud", T.DoubleType(), True),
    T.StructField("fraud_pattern", T.StringType(), True),
    T.StructField("label_available_timestamp", T.TimestampType(), True),
])

PAYER_VELOCITY = [f"payer_txn_{m}_{w}" for w in ("5min", "1h", "24h") for m in ("count", "sum")]
DEVICE_VELOCITY = ["device_txn_count_1h", "device_txn_count_24h"]
# The "_7d" names are kept for compatibility; they count over the last 1000 rows.
DISTINCT_COUNTS = ["device_distinct_payers_7d", "payer_distinct_payees_7d"]
RISK_HISTORY = ["payer_past_fraud_count_30d"]
FEATURES = PAYER_VELOCITY + DEVICE_VELOCITY + DISTINCT_COUNTS + RISK_HISTORY

FEATURE_SCHEMA = T.StructType(
    [T.StructField("transaction_id", T.StringType()),
     T.StructField("event_timestamp", T.TimestampType())]
    + [T.StructField(c, T.DoubleType() if "_sum_" in c else T.LongType()) for c in FEATURES])

# Identifiers, times and targets a model must never see.
LEAKY_COLUMNS = ["transaction_id", "event_timestamp", "label_available_timestamp", "is_fraud",
                 "fraud_pattern"]
IDENTITY_COLUMNS = ["payer_id", "payer_vpa", "payee_vpa", "device_id", "currency"]


def assert_feature_schema(df: DataFrame) -> DataFrame:
    """The feature table is closed: exactly these columns, with these types."""
    want = {f.name: f.dataType.simpleString() for f in FEATURE_SCHEMA}
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    if want != have:
        raise ValueError(f"feature columns differ: missing {sorted(set(want) - set(have))}, "
                         f"extra {sorted(set(have) - set(want))}, "
                         f"types {[(c, have[c]) for c in want if c in have and have[c] != want[c]]}")
    return df.select(*FEATURE_SCHEMA.names)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
