"""Tree ensembles as tables of nodes, and their scores as joins.

A node table has the columns tree, node, feature (-1 in leaves), threshold, left, right and value
(of a leaf). A row goes left where its feature is at most the threshold. Such a table can be kept
next to the scores, read by any engine and walked there by the same joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskengine.models.anomaly import IsolationForest, mean_path
from riskengine.models.supervised import SupervisedModel


def forest_nodes(spark: SparkSession, forest: IsolationForest) -> DataFrame:
    """Leaves hold the path length that they stand for."""
    schema = "tree int, node int, feature int, threshold double, left int, right int, value double"
    return spark.createDataFrame(forest.nodes.rename(columns={"depth": "value"}), schema)


def boosted_nodes(spark: SparkSession, path: str) -> DataFrame:
    """The trees of a model that :meth:`SupervisedModel.save` wrote; leaves hold their prediction times the tree's weight."""
    data = spark.read.parquet(f"{path}/gbt/data")
    weights = spark.read.parquet(f"{path}/gbt/treesMetadata").toDF("treeID", "_about", "weights").drop("_about")
    n, split = F.col("nodeData"), F.col("nodeData.split")
    leaf = n["leftChild"] < 0
    return data.join(weights, "treeID").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), F.when(leaf, -1).otherwise(split["featureIndex"]).alias("feature"),
        F.when(~leaf, F.get(split["leftCategoriesOrThreshold"], F.lit(0))).alias("threshold"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), F.when(leaf, n["prediction"] * F.col("weights")).alias("value"))


def leaf_totals(rows: DataFrame, nodes: DataFrame, root: int, key: str = "transaction_id", x: str = "x") -> DataFrame:
    """(key, total): the sum of the leaf values that each row reaches; ``x`` is its array of features.

    One join per level of the deepest tree. Rows that have reached a leaf stay there.
    """
    trees = nodes.select("tree").distinct()
    at = rows.select(key, x).join(F.broadcast(trees)).withColumn("node", F.lit(root))  # every row walks every tree
    inner = nodes.filter("feature >= 0").select("tree", "node", "feature", "threshold", "left", "right")
    level, deepest = nodes.filter(F.col("node") == root), 0
    while not level.filter("feature >= 0").isEmpty():
        deepest += 1
        below = level.filter("feature >= 0").select("tree", F.explode(F.array("left", "right")).alias("node"))
        level = nodes.join(below, ["tree", "node"], "left_semi")
    for _ in range(deepest):
        step = F.when(F.get(x, F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
        at = at.join(inner, ["tree", "node"], "left").withColumn("node", F.when(F.col("feature").isNull(), F.col("node")).otherwise(step)).select(key, x, "tree", "node")
    return at.join(nodes.select("tree", "node", "value"), ["tree", "node"]).groupBy(key).agg(F.sum("value").alias("total"))


def forest_scores(df: DataFrame, forest: IsolationForest, nodes: DataFrame, key: str = "transaction_id") -> DataFrame:
    """(key, anomaly_score) as :meth:`IsolationForest.score`, from the node table."""
    rows = df.select(key, F.array(*[F.col(c).cast("double") for c in forest.features]).alias("x"))
    trees = nodes.select("tree").distinct().count()
    raw = F.pow(F.lit(2.0), -(F.col("total") / trees) / mean_path(forest.sample))
    scaled = F.lit(1.0) if forest.low == forest.high else F.least(F.lit(1.0), F.greatest(F.lit(0.0), (raw - forest.low) / (forest.high - forest.low)))
    return leaf_totals(rows, nodes, 1, key).select(key, scaled.alias("anomaly_score"))


def boosted_scores(df: DataFrame, model: SupervisedModel, nodes: DataFrame, key: str = "transaction_id") -> DataFrame:
    """(key, fraud_probability) as :meth:`SupervisedModel.predict`, from the node table."""
    from pyspark.ml.functions import vector_to_array
    rows = model.inputs(df, (key,)).select(key, vector_to_array("features").alias("x"))
    return leaf_totals(rows, nodes, 0, key).select(key, (1 / (1 + F.exp(-2 * F.col("total")))).alias("fraud_probability"))
