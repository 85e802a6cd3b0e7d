"""Record contracts: typed rows out, rejected rows kept with their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskengine.schema import TXN_CORE

REQUIRED = ["transaction_id", "event_timestamp", "amount", "payer_vpa", "payee_vpa", "device_id"]


def _columns(df: DataFrame, strict: bool) -> tuple[dict[str, Column], list[Column]]:
    types = {f.name: f.dataType for f in TXN_CORE}
    typed: dict[str, Column] = {}
    reasons: list[Column] = []

    def reason(bad: Column, text: str):
        reasons.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(text)))

    for name, dtype in types.items():
        if name not in df.columns:
            if name == "currency":
                typed[name] = F.lit("INR")
            else:
                typed[name] = F.lit(None).cast(dtype)
                if name in REQUIRED:
                    reason(F.lit(True), f"{name}: missing")
            continue
        raw = F.col(f"`{name}`")
        value = raw.cast("string") if isinstance(dtype, T.StringType) else raw.try_cast(dtype)
        typed[name] = value
        if name in REQUIRED or name == "currency":
            reason(raw.isNull(), f"{name}: missing")
        if not isinstance(dtype, T.StringType):
            reason(raw.isNotNull() & value.isNull(), f"{name}: not a {dtype.simpleString()}")
    amount = typed["amount"]
    if strict:
        reason((amount <= 0) | F.isnan(amount), "amount: must be positive")
        reason(typed["currency"] != "INR", "currency: only INR is supported")
    else:
        reason(amount < 0, "amount: must not be negative")
    for vpa in ("payer_vpa", "payee_vpa"):
        typed[vpa] = F.lower(typed[vpa])
    return typed, reasons


def _typed_rows(df: DataFrame, typed: dict[str, Column], *more: Column) -> DataFrame:
    rest = [F.col(f"`{c}`") for c in df.columns if c not in typed]
    core = [v.alias(n) for n, v in typed.items()
            if n in df.columns or n in REQUIRED or n == "currency"]
    return df.select(*core, *rest, *more)


def checked(df: DataFrame, strict: bool = False) -> DataFrame:
    """Coerced core columns, all other columns as they came, and ``reject_reasons``."""
    typed, reasons = _columns(df, strict)
    return _typed_rows(df, typed, F.array_compact(F.array(*reasons)).alias("reject_reasons"))


def enforce(df: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid rows, typed) and (rejected rows, as they came, with reasons)."""
    typed, reasons = _columns(df, strict)
    bad = F.lit(False)
    for r in reasons:
        bad = bad | r.isNotNull()
    valid = _typed_rows(df.filter(~bad), typed)
    rejects = df.filter(bad).withColumn("reject_reasons", F.array_compact(F.array(*reasons)))
    return valid, rejects


def event_gate(df: DataFrame) -> Column:
    """Amount above zero, INR, and a label time that is absent or after the event."""
    label = F.col("label_available_timestamp")
    return F.coalesce(
        (F.coalesce(F.col("amount"), F.lit(0.0)) > 0) & (F.col("currency") == "INR")
        & (label.isNull() | (label > F.col("event_timestamp"))), F.lit(False))


def gate_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passed, stopped); works on batch and streaming tables."""
    return df.filter(event_gate(df)), df.filter(~event_gate(df))
