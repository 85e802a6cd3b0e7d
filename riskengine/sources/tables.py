"""Reading and writing transaction, feature, score and report tables."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskengine.functions.timing import event_date

MICROS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  # text sinks keep the microseconds


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             timestamp_format: str | None = None) -> DataFrame:
    """CSV with a declared schema: no inference pass over the data."""
    r = spark.read.schema(schema).option("header", True)
    if timestamp_format:
        r = r.option("timestampFormat", timestamp_format)
    return r.csv(path)


def read_transactions(spark: SparkSession, path: str, *, start: str | None = None,
                      end: str | None = None) -> DataFrame:
    """The transaction table, pruned to the event dates in [start, end]."""
    df = spark.read.parquet(path)
    if start is None and end is None:
        return df
    day = F.col("event_date") if "event_date" in df.columns else event_date("event_timestamp")
    if start is not None:
        df = df.filter(day >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(day <= F.lit(end).cast("date"))
    return df


def labelled(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_fraud").isin(0, 1))


def unlabelled(df: DataFrame) -> DataFrame:
    return df.filter(F.col("is_fraud").isNull())


def write_transactions(df: DataFrame, path: str, *, rows_per_file: int = 5_000_000,
                       time_sorted: bool = True) -> None:
    """Drop-and-reload into Parquet partitioned by event date.

    Each day gets as many writers as its row count asks for, so a heavy day is
    not one task; rows are sorted by time inside each file.
    """
    out = df.withColumn("event_date", event_date("event_timestamp"))
    days = out.groupBy("event_date").agg(  # one row per day
        F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_writers"))
    days = days.withColumnRenamed("event_date", "_day")
    out = (out.join(F.broadcast(days), F.col("event_date").eqNullSafe(F.col("_day")))
           .withColumn("_writer", F.pmod(F.xxhash64("transaction_id"), F.col("_writers")))
           .drop("_day", "_writers").repartition("event_date", "_writer"))
    if time_sorted:
        out = out.sortWithinPartitions("event_date", "event_timestamp", "transaction_id")
    out.drop("_writer").write.mode("overwrite").partitionBy("event_date").parquet(path)


def write_sorted(df: DataFrame, path: str, by: Iterable[str] = ("event_timestamp", "transaction_id")) -> None:
    """A globally sorted table: range partitions, each sorted; no single-task sort."""
    by = list(by)
    df.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)


def csv_to_table(spark: SparkSession, csv_path: str, table_path: str, schema: T.StructType | str,
                 timestamp_format: str | None = None) -> None:
    write_transactions(read_csv(spark, csv_path, schema, timestamp_format), table_path)


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("timestampFormat", MICROS_FORMAT).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """Metric rows as JSON lines."""
    df.write.mode("overwrite").option("timestampFormat", MICROS_FORMAT).json(path)


def read_report(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read
    return (r.schema(schema) if schema is not None else r).json(path)


def replace_column(df: DataFrame, source: str, target: str, dtype: str = "string") -> DataFrame:
    """``source`` takes the place of ``target`` (one column, not two of the same name)."""
    return df.withColumn("_new", F.col(f"`{source}`").cast(dtype)).drop(source, target) \
        .withColumnRenamed("_new", target)


def normalize_names(df: DataFrame) -> DataFrame:
    """Hyphens become underscores; ``id-01`` and ``id_01`` merge into one column."""
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(c.replace("-", "_"), []).append(c)
    return df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in cs]).alias(name)
                       for name, cs in groups.items()])


# Fixed patterns of the raw column families.
FAMILIES = {
    "V": r"V\d+", "C": r"C\d+", "D": r"D\d+", "M": r"M\d+", "card": r"card\d+",
    "addr": r"addr\d+", "dist": r"dist\d+", "email": r"[PR]_emaildomain", "id": r"id[-_]\d+",
}


def raw_columns(df: DataFrame, families: Iterable[str] = tuple(FAMILIES)) -> list[str]:
    pattern = re.compile("|".join(f"(?:{FAMILIES[f]})" for f in families))
    return [c for c in df.columns if pattern.fullmatch(c)]


def project_excluding(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def first_by_time(df: DataFrame, n: int) -> DataFrame:
    """The first n rows in (time, id) order."""
    return df.orderBy("event_timestamp", "transaction_id").limit(n)


def top_scores(df: DataFrame, n: int, score: str = "fraud_probability",
               id_col: str = "transaction_id") -> DataFrame:
    return df.orderBy(F.desc(score), id_col).limit(n)


def sample_rows(df: DataFrame, n: int, seed: int = 42, id_col: str = "transaction_id") -> DataFrame:
    """A repeatable random sample: the n smallest hashes of (id, seed).

    Only hashes below a bound that n rows are all but sure to meet are sorted; if they do
    not, all rows are.
    """
    h = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(seed)))
    rows = df.withColumn("_hash", h)
    share = (n + 8 * math.sqrt(n) + 64) / max(1, df.count())
    if share < 1:
        low = rows.where(F.conv(F.substring("_hash", 1, 15), 16, 10).cast("double") < share * float(1 << 60))
        if low.count() >= n:
            rows = low
    return rows.orderBy("_hash", id_col).limit(n).drop("_hash")
