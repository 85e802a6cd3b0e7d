"""Boosted trees on ``pyspark.ml``: training, scoring, importance, persistence."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from riskengine.models.preparation import (Encoder, align_features, class_weight, fit_encoder, load_json,
                                           model_columns, save_json, split_by_type)

# Hyper-parameters existing models were trained with, under their Spark names.
PARAMS = {"maxDepth": 6, "stepSize": 0.1, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8",
          "maxIter": 300, "seed": 42}
ABSENT = -999.0  # Spark trees have no missing branch: sentinel plus a flag column


@dataclass
class SupervisedModel:
    numeric: list[str]
    encoder: Encoder
    flagged: list[str]           # columns with missing values in training
    gbt: GBTClassificationModel
    metadata: dict = field(default_factory=dict)

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *self.encoder.columns]

    def inputs(self, df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        """Aligned, encoded and assembled: the only path from a table to the model."""
        aligned = align_features(self.encoder.transform(df), self.features, None, keep)
        flags = {f"{c}__absent": F.isnan(c).cast("double") for c in self.flagged}
        aligned = aligned.withColumns(flags) if flags else aligned
        aligned = aligned.withColumns({c: F.when(F.isnan(c), F.lit(ABSENT)).otherwise(F.col(c))
                                       for c in self.features})
        cols = [*self.features, *flags]
        return VectorAssembler(inputCols=cols, outputCol="features").transform(aligned)

    def predict(self, df: DataFrame, keep: tuple[str, ...] = ("transaction_id",)) -> DataFrame:
        """``keep`` columns and fraud_probability, for every row of ``df``."""
        scored = self.gbt.transform(self.inputs(df, keep))
        return scored.select(*[k for k in keep if k in df.columns],
                             vector_to_array("probability")[1].alias("fraud_probability"))

    def importance(self) -> DataFrame:
        """(rank, feature, importance), flags counted with their column."""
        spark = SparkSession.active()
        names = [*self.features, *[f"{c}__absent" for c in self.flagged]]
        pairs = [(n.removesuffix("__absent"), float(v))
                 for n, v in zip(names, self.gbt.featureImportances.toArray())]
        df = spark.createDataFrame(pairs, "feature string, importance double")
        df = df.groupBy("feature").agg(F.sum("importance").alias("importance"))
        order = Window.partitionBy(F.lit(0)).orderBy(F.desc("importance"), "feature")  # a few hundred rows
        return df.withColumn("rank", F.row_number().over(order))

    def save(self, spark: SparkSession, path: str) -> None:
        self.gbt.write().overwrite().save(f"{path}/gbt")
        self.encoder.save(f"{path}/encoder")
        save_json(spark, f"{path}/metadata", {
            "numeric": self.numeric, "categorical": list(self.encoder.columns),
            "large": list(self.encoder.large), "flagged": self.flagged,
            "metadata": self.metadata})

    @staticmethod
    def load(spark: SparkSession, path: str) -> "SupervisedModel":
        meta = load_json(spark, f"{path}/metadata")
        enc = Encoder.load(spark, f"{path}/encoder", tuple(meta["categorical"]), tuple(meta["large"]))
        return SupervisedModel(meta["numeric"], enc, meta["flagged"],
                               GBTClassificationModel.load(f"{path}/gbt"), meta["metadata"])


def train_supervised(train: DataFrame, columns: list[str] | None = None, *, label: str = "is_fraud",
                     validation: str | None = None, early_stop: float = 0.001,
                     drop_identity: bool = True, **params) -> SupervisedModel:
    """Fit on the labelled rows; encoders and missing flags come from these rows only.

    ``validation`` names a boolean column (the chronological tail): training stops
    when its loss no longer improves by ``early_stop``.
    """
    rows = train.filter(F.col(label).isNotNull())
    if columns is None:
        columns = [c for c in model_columns(rows, drop_identity) if c != validation]
    numeric, categorical = split_by_type(rows, columns)
    encoder = fit_encoder(rows, categorical)
    holes = rows.agg(*[F.count(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1)).alias(c)
                       for c in numeric]).first() if numeric else {}
    w = class_weight(rows, label).first()
    if not w["n_fraud"] or not w["n_legit"]:
        raise ValueError("training rows need both classes")
    model = SupervisedModel(numeric, encoder, [c for c in numeric if holes[c]], None)
    keep = (label,) + ((validation,) if validation else ())
    ready = model.inputs(rows, keep).select(
        F.col(label).cast("double").alias("_label"), "features",
        F.when(F.col(label) == 1, F.lit(float(w["weight"]))).otherwise(F.lit(1.0)).alias("_weight"),
        *([F.col(validation)] if validation else []))
    stop = {"validationIndicatorCol": validation, "validationTol": early_stop} if validation else {}
    gbt = GBTClassifier(labelCol="_label", featuresCol="features", weightCol="_weight", maxBins=64,
                        **{**PARAMS, **stop, **params})
    model.gbt = gbt.fit(ready)
    model.metadata = {"trees": model.gbt.getNumTrees, "weight": float(w["weight"]),
                      "n_fraud": w["n_fraud"], "n_legit": w["n_legit"]}
    return model
