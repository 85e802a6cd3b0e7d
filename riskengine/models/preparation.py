"""Model inputs: scaling, category codes, alignment to a feature list, class weight."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from riskengine.schema import IDENTITY_COLUMNS, LEAKY_COLUMNS
from riskengine.session import materialise

MISSING = "__MISSING__"   # fixed value: the category of rows without one
MAX_CATEGORIES = 100_000  # the longest category list that becomes part of a plan; columns with more are joined


# -- scaling -------------------------------------------------------------------

@dataclass(frozen=True)
class Scaler:
    """Mean and population deviation per column; a constant column divides by one."""

    stats: dict[str, tuple[float, float]]


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    aggs = []
    for i, c in enumerate(columns):
        v = F.col(c).cast("double")
        aggs += [F.avg(v).alias(f"m{i}"), F.stddev_pop(v).alias(f"s{i}"),
                 F.count(F.when(v.isNull() | F.isnan(v), 1)).alias(f"n{i}")]
    r = df.agg(*aggs).first()
    holes = [c for i, c in enumerate(columns) if r[f"n{i}"]]
    if holes:
        raise ValueError(f"NULL values in {holes}")
    return Scaler({c: (r[f"m{i}"], r[f"s{i}"] or 1.0) for i, c in enumerate(columns)})


def scale(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                           for c, (m, s) in scaler.stats.items()})


# -- columns -------------------------------------------------------------------

def model_columns(df: DataFrame, drop_identity: bool = True) -> list[str]:
    """Everything except identifiers, times and targets, in table order."""
    banned = set(LEAKY_COLUMNS) | (set(IDENTITY_COLUMNS) if drop_identity else set())
    banned |= {"event_date"}
    out = [c for c in df.columns if c not in banned]
    if not out:
        raise ValueError("no model columns left")
    return out


def split_by_type(df: DataFrame, columns: list[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical); columns of other types are left out."""
    types = {f.name: f.dataType for f in df.schema}
    numeric = [c for c in columns if isinstance(types[c], (T.NumericType, T.BooleanType))]
    return numeric, [c for c in columns if isinstance(types[c], T.StringType)]


# -- categories ----------------------------------------------------------------

def category_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code): codes by alphabetical order, NULL as its own value.

    Distinct values lie in ranges, each numbered by itself; a range starts where the ones before it
    end, so no task holds a whole column.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias("value"))
        for c in columns])).alias("p")
    values = df.select(pairs).select("p.*").distinct()
    ranges = materialise(values.repartitionByRange("column", "value").withColumn("_part", F.spark_partition_id()), "categories")
    inside = F.row_number().over(Window.partitionBy("column", "_part").orderBy("value"))
    earlier = Window.partitionBy("column").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = ranges.groupBy("column", "_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "column", "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return ranges.withColumn("_i", inside).join(F.broadcast(starts), ["column", "_part"]).select(
        "column", "value", (F.col("_start") + F.col("_i") - 1).cast("long").alias("code"))


@dataclass(frozen=True)
class Encoder:
    """Category codes fitted on the training rows only.

    Columns with few values are coded from lists inside the plan; those with many (``large``) by a
    join with ``table`` (column, value, code). Values not seen in training take the code of missing,
    else the first one.
    """

    columns: tuple[str, ...]
    model: StringIndexerModel | None
    large: tuple[str, ...] = ()
    table: DataFrame | None = None

    @property
    def small(self) -> tuple[str, ...]:
        return tuple(c for c in self.columns if c not in self.large)

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.columns:
            return df
        df = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING))
                             if c in df.columns else F.lit(MISSING) for c in self.columns})
        if self.small:
            df = self.model.transform(df)
            coded = {}
            for c, labels in zip(self.small, self.model.labelsArray):
                unseen = float(labels.index(MISSING)) if MISSING in labels else 0.0
                code = F.col(f"{c}__code")
                coded[c] = F.when(code >= len(labels), F.lit(unseen)).otherwise(code)
            df = df.withColumns(coded).drop(*[f"{c}__code" for c in self.small])
        for c in self.large:
            own = self.table.filter(F.col("column") == c)
            unseen = own.filter(F.col("value") == MISSING).select("code").first()
            unseen = float(unseen[0]) if unseen else 0.0
            codes = own.filter(F.col("value") != MISSING).select(F.col("value").alias("_value"), F.col("code").cast("double").alias("_code"))
            # rows without a value need no partner
            df = df.withColumn("_key", F.when(F.col(c) != MISSING, F.col(c))).join(codes, F.col("_key") == F.col("_value"), "left").withColumn(
                c, F.coalesce("_code", F.lit(unseen))).drop("_key", "_value", "_code")
        return df

    def save(self, path: str) -> None:
        if self.small:
            self.model.write().overwrite().save(f"{path}/lists")
        if self.large:
            self.table.write.mode("overwrite").parquet(f"{path}/table")

    @staticmethod
    def load(spark: SparkSession, path: str, columns: tuple[str, ...], large: tuple[str, ...]) -> "Encoder":
        few = [c for c in columns if c not in large]
        return Encoder(columns, StringIndexerModel.load(f"{path}/lists") if few else None, large,
                       spark.read.parquet(f"{path}/table") if large else None)


def fit_encoder(df: DataFrame, columns: list[str], max_categories: int = MAX_CATEGORIES) -> Encoder:
    if not columns:
        return Encoder((), None)
    rough = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    near = [c for c in columns if rough[c] > max_categories * 0.5]  # count only these exactly
    sizes = df.agg(*[F.count_distinct(c).alias(c) for c in near]).first() if near else {}
    large = tuple(c for c in near if sizes[c] > max_categories)
    few = [c for c in columns if c not in large]
    model = None
    if few:
        filled = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(MISSING)).alias(c) for c in few])
        model = StringIndexer(inputCols=few, outputCols=[f"{c}__code" for c in few],
                              stringOrderType="alphabetAsc", handleInvalid="keep").fit(filled)
    table = materialise(category_codes(df, list(large)), "category-codes") if large else None
    return Encoder(tuple(columns), model, large, table)


# -- alignment -----------------------------------------------------------------

def align_features(df: DataFrame, names: list[str], fill: float | None = None,
                   keep: tuple[str, ...] = ("transaction_id",)) -> DataFrame:
    """The columns ``names`` as doubles, in that order.

    An absent column, NULL or uncoercible value becomes ``fill`` (NaN when None);
    infinities become zero.
    """
    default = F.lit(float("nan") if fill is None else float(fill))
    out = []
    for n in names:
        if n not in df.columns:
            out.append(default.alias(n))
            continue
        v = F.col(f"`{n}`").try_cast("double")
        v = F.when(F.abs(v) == float("inf"), F.lit(0.0)).otherwise(v)
        if fill is not None:
            v = F.when(F.isnan(v), default).otherwise(v)
        out.append(F.coalesce(v, default).alias(n))
    return df.select(*[k for k in keep if k in df.columns and k not in names], *out)


def class_weight(df: DataFrame, label: str = "is_fraud") -> DataFrame:
    """One row: legitimate and fraud counts and their quotient, the weight of a fraud."""
    g = df.agg(F.count(F.when(F.col(label) == 0, 1)).alias("n_legit"),
               F.count(F.when(F.col(label) == 1, 1)).alias("n_fraud"))
    return g.withColumn("weight", F.when(F.col("n_fraud") > 0, F.col("n_legit") / F.col("n_fraud")))


def save_json(spark: SparkSession, path: str, data: dict) -> None:
    spark.createDataFrame([(json.dumps(data),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r["value"] for r in spark.read.text(path).collect()))
