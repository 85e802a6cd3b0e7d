"""Comparing two versions of a table by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


def compare_frames(a: DataFrame, b: DataFrame, key: str = "transaction_id",
                   columns: list[str] | None = None, atol: float = 1e-5) -> DataFrame:
    """(key, column, left_value, right_value) of every difference.

    Numbers may differ by ``atol``; a key on one side only is a difference in
    ``<row>``. Both keys are expected to be unique.
    """
    columns = columns or [c for c in a.columns if c in b.columns and c != key]
    left = a.select(F.col(key).alias("_ka"), *[F.col(c).alias(f"_a_{c}") for c in columns])
    right = b.select(F.col(key).alias("_kb"), *[F.col(c).alias(f"_b_{c}") for c in columns])
    j = left.join(right, F.col("_ka") == F.col("_kb"), "full_outer")
    both = F.col("_ka").isNotNull() & F.col("_kb").isNotNull()
    diffs = [F.when(~both, F.struct(
        F.lit("<row>").alias("column"),
        F.when(F.col("_ka").isNotNull(), "present").alias("left_value"),
        F.when(F.col("_kb").isNotNull(), "present").alias("right_value")))]
    for c in columns:
        x, y = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        same = x.eqNullSafe(y)
        if isinstance(a.schema[c].dataType, T.NumericType) and isinstance(b.schema[c].dataType, T.NumericType):
            same = same | F.coalesce(F.abs(x.cast("double") - y.cast("double")) <= atol, F.lit(False))
        diffs.append(F.when(both & ~same, F.struct(
            F.lit(c).alias("column"), x.cast("string").alias("left_value"),
            y.cast("string").alias("right_value"))))
    return (j.select(F.coalesce("_ka", "_kb").alias(key), F.explode(F.array(*diffs)).alias("_d"))
            .filter(F.col("_d").isNotNull()).select(key, "_d.*"))


def difference_counts(a: DataFrame, b: DataFrame, key: str = "transaction_id",
                      columns: list[str] | None = None, atol: float = 1e-5) -> DataFrame:
    """One row: how many keys both sides hold, how many only one holds, in how many rows and cells they differ."""
    diffs = compare_frames(a, b, key, columns, atol).select(key, "column").withColumn("both", F.lit(0))
    keys = a.select(key).join(b.select(key), key).select(key, F.lit(None).cast("string").alias("column"), F.lit(1).alias("both"))
    cell = F.col("column") != "<row>"
    return diffs.unionByName(keys).agg(
        F.sum("both").alias("n_compared"), F.count(F.when(F.col("column") == "<row>", 1)).alias("n_one_sided"),
        F.countDistinct(F.when(cell, F.col(key))).alias("n_rows_different"), F.count(F.when(cell, 1)).alias("n_cells_different"))


def batch_stream_diff(batch: DataFrame, stream: DataFrame) -> DataFrame:
    """Rows whose id, time or amount differ between the two paths."""
    return compare_frames(batch, stream, columns=["event_timestamp", "amount"], atol=0.0)
