"""Event streams: source, seek, de-duplication, gates, and running a stream to its end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskengine.operators.contracts import event_gate


def read_events(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 16,
                start: str | None = None) -> DataFrame:
    """A Parquet event stream with a declared schema; ``start`` seeks (inclusive)."""
    s = (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path))
    return s if start is None else seek(s, start)


def seek(events: DataFrame, start: str) -> DataFrame:
    return events.filter(F.col("event_timestamp") >= F.lit(start).cast("timestamp"))


def deduplicate(events: DataFrame, lateness: str = "1 hour", key: str = "transaction_id") -> DataFrame:
    """Each id once, repeats recognised as long as they arrive within the lateness."""
    return (events.withWatermark("event_timestamp", lateness).dropDuplicatesWithinWatermark([key]))


def gated(events: DataFrame, passed_path: str, stopped_path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that sends passing and stopped rows to their own tables."""
    def write(batch: DataFrame, batch_id: int) -> None:
        ok = event_gate(batch)
        for path, rows in ((passed_path, batch.filter(ok)), (stopped_path, batch.filter(~ok))):
            rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
    return write


def run_to_end(events: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None],
               mode: str = "append") -> None:
    """Process everything available through a batch writer, then stop."""
    q = (events.writeStream.foreachBatch(write).outputMode(mode)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def append_to(events: DataFrame, checkpoint: str, path: str) -> None:
    """Process everything available into a Parquet table."""
    q = (events.writeStream.format("parquet").outputMode("append").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
