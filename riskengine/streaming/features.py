"""Point-in-time features over a stream, with scores and a table of late rows.

The features come from keyed state (:mod:`keyed`): a micro-batch reads the state of the
entities it mentions and nothing of the history. What it finds is written once, to a folder of
its own, which a replayed micro-batch overwrites.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from riskengine.models.anomaly import IsolationForest
from riskengine.models.supervised import SupervisedModel
from riskengine.operators.alerts import risk_tier
from riskengine.schema import FEATURE_SCHEMA
from riskengine.streaming import keyed, source


@dataclass
class FeatureStream:
    """``path`` holds the rows with their features, and scores.

    ``lateness_seconds``: how far a row may be behind the newest one of its payer or device and
    still get exact features; older rows are read as ``late``. ``labels`` is a stream of frauds
    found later, see :func:`keyed.keyed_rows`.
    """

    spark: SparkSession
    path: str
    lateness_seconds: int = 0
    labels: DataFrame | None = None
    model: SupervisedModel | None = None
    forest: IsolationForest | None = None

    def run(self, events: DataFrame, checkpoint: str) -> None:
        """Process all events that are available, then stop."""
        keyed.use_rocksdb(self.spark)
        source.run_to_end(keyed.keyed_rows(events, self.lateness_seconds, self.labels), checkpoint, self.write)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """``rows``: a micro-batch of :func:`keyed.keyed_rows`, computed once by the write."""
        folder = f"{self.path}/rows/batch_id={batch_id}"
        rows.write.mode("overwrite").parquet(folder)
        if self.model is not None:
            table = self.spark.read.schema(rows.schema).parquet(folder).where(~F.col("is_late")).drop("is_late")
            if self.forest is not None:
                table = self.forest.score(table)
            scores = self.model.predict(table, ("transaction_id", "event_timestamp"))
            scores.withColumn("risk_tier", risk_tier("fraud_probability")).write.mode("overwrite").parquet(f"{self.path}/scores/batch_id={batch_id}")

    def read(self, name: str) -> DataFrame:
        """``features`` (with the number of the micro-batch), ``late`` (the events), ``rows`` or ``scores``."""
        if name not in ("features", "late"):
            return self.spark.read.parquet(f"{self.path}/{name}")
        rows = self.spark.read.parquet(f"{self.path}/rows")
        if name == "features":
            return rows.where(~F.col("is_late")).select(*FEATURE_SCHEMA.names, "batch_id")
        computed = [c for c in FEATURE_SCHEMA.names if c not in ("transaction_id", "event_timestamp")]
        return rows.where("is_late").drop(*computed, "is_late")
