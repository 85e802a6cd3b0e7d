"""Isolation forest: trees grown from small hash samples, scores computed in Arrow batches.

Every draw is a hash of the seed, the tree and a row's id or a node's number, so a forest does not
depend on how its table is stored, and the same trees can be grown by any engine that has MD5.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from riskengine.models.preparation import load_json, save_json
from riskengine.operators.ranking import kth_largest
from riskengine.schema import DEVICE_VELOCITY, DISTINCT_COUNTS, PAYER_VELOCITY
from riskengine.session import materialise

REQUIRED = PAYER_VELOCITY + DEVICE_VELOCITY + DISTINCT_COUNTS
# What the unsupervised stage must not see.
FORBIDDEN = ["payer_past_fraud_count_30d", "is_fraud", "label_available_timestamp"]
SLICE_ROWS = 10_000  # rows that one task shuffles for permutation_importance
_NODES = ("tree int, node int, feature int, threshold double, left int, right int, "
          "depth double")


def check_contract(df: DataFrame, features: list[str] | None = None) -> list[str]:
    """Required columns must be there; returns the forbidden ones present (not used)."""
    missing = [c for c in (features or REQUIRED) if c not in df.columns]
    if missing:
        raise ValueError(f"anomaly stage needs {missing}")
    return [c for c in FORBIDDEN if c in df.columns]


def contract_report(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """(column, state): each required column as ``used`` or ``missing``, each forbidden one that is there as ``forbidden``."""
    wanted = list(features or REQUIRED)
    rows = [(c, "used" if c in df.columns else "missing") for c in wanted] + [(c, "forbidden") for c in FORBIDDEN if c in df.columns]
    return df.sparkSession.createDataFrame(rows, "column string, state string")


def mean_path(n: float) -> float:
    """Average depth of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


DRAW_DIGITS = 13  # hexadecimal digits of a hash that make a draw: 52 bits, exact as a double


def drawn(*parts: Column | str | int) -> Column:
    """A whole number below 16^13 from the hash of the parts, joined by colons."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.col(p) if isinstance(p, str) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, DRAW_DIGITS), 16, 10).cast("long")


def _draw(*parts) -> float:
    """The same in [0, 1), for one node."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:DRAW_DIGITS], 16) / 16 ** DRAW_DIGITS


def _grow(x: np.ndarray, seed: int, tree: int, limit: int) -> list[tuple]:
    """Nodes as (node, feature, threshold, left, right, depth); leaves have feature -1.

    The root is node 1, the children of node n are 2n and 2n + 1. A node is parted by one of the
    features that vary in it, at a place between the feature's least and largest value.
    """
    nodes: list[tuple] = []
    todo = [(1, np.arange(len(x)), 0)]
    while todo:
        me, rows, depth = todo.pop()
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        varies = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(varies):
            nodes.append((me, -1, 0.0, -1, -1, depth + mean_path(len(rows))))
            continue
        f = int(varies[int(_draw(seed, tree, me, "feature") * len(varies))])
        cut = float(low[f] + _draw(seed, tree, me, "cut") * (high[f] - low[f]))
        nodes.append((me, f, cut, 2 * me, 2 * me + 1, 0.0))
        v = x[rows, f]
        todo += [(2 * me + 1, rows[~(v <= cut)], depth + 1), (2 * me, rows[v <= cut], depth + 1)]
    return sorted(nodes)


@dataclass
class IsolationForest:
    features: list[str]
    nodes: pd.DataFrame          # at most trees * (2 * sample - 1) rows
    sample: int
    low: float = 0.0             # score range on the training rows
    high: float = 0.0

    def raw_scores(self, df: DataFrame, features: Column | None = None, out: str = "raw_score") -> DataFrame:
        """Add the isolation score in (0, 1]; higher is easier to isolate."""
        trees = []
        for _, g in self.nodes.sort_values(["tree", "node"]).groupby("tree", sort=True):
            node, leaf = g["node"].to_numpy(), g["feature"].to_numpy() < 0
            # nodes by their places, a leaf as its own children: all rows take as many steps as the tree has levels
            child = np.stack([np.where(leaf, np.arange(len(g)), np.searchsorted(node, g[c].to_numpy())) for c in ("left", "right")], axis=1).ravel()
            trees.append((np.where(leaf, 0, g["feature"].to_numpy()), g["threshold"].to_numpy(), child, g["depth"].to_numpy(), int(node.max()).bit_length() - 1))
        shared = df.sparkSession.sparkContext.broadcast(trees)
        scale = mean_path(self.sample)

        def walked(m: np.ndarray) -> pd.Series:
            total, values = np.zeros(len(m)), m.ravel()
            begin = np.arange(len(m)) * m.shape[1]
            for feature, threshold, child, depth, levels in shared.value:
                at = np.zeros(len(m), dtype=np.int64)
                for _ in range(levels):
                    low = values[begin + feature[at]] <= threshold[at]
                    at = child[2 * at + ~low]
                total += depth[at]
            return pd.Series(2.0 ** (-(total / len(shared.value)) / scale))

        @F.pandas_udf("double")
        def of_array(x: pd.Series) -> pd.Series:
            return walked(np.stack(x.to_numpy())) if len(x) else pd.Series([], dtype="float64")

        @F.pandas_udf("double")
        def of_columns(*x: pd.Series) -> pd.Series:
            return walked(np.stack([c.to_numpy(np.float64) for c in x], axis=1))

        if features is not None:
            return df.withColumn(out, of_array(features))
        return df.withColumn(out, of_columns(*[F.col(c).cast("double") for c in self.features]))

    def score(self, df: DataFrame, out: str = "anomaly_score", per_batch: bool = False) -> DataFrame:
        """Scores scaled to [0, 1] by the training range (or by this table's own range)."""
        raw = self.raw_scores(df)
        if per_batch:
            r = raw.agg(F.min("raw_score"), F.max("raw_score")).first()
            return self.scaled(raw, out, r[0], r[1])
        return self.scaled(raw, out, self.low, self.high)

    def scaled(self, raw: DataFrame, out: str, low: float | None, high: float | None) -> DataFrame:
        """``raw_score`` replaced by ``out``: its place between low and high, which have the scores 0 and 1."""
        if low is None or low == high:
            s = F.lit(1.0)
        else:
            s = (F.col("raw_score") - low) / (high - low)
            s = F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))
        return raw.withColumn(out, s).drop("raw_score")

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame(self.nodes, _NODES).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        save_json(spark, f"{path}/metadata", {"features": self.features, "sample": self.sample,
                                              "low": self.low, "high": self.high})

    @staticmethod
    def load(spark: SparkSession, path: str) -> "IsolationForest":
        meta = load_json(spark, f"{path}/metadata")
        nodes = spark.read.parquet(f"{path}/trees").toPandas()
        return IsolationForest(meta["features"], nodes, meta["sample"], meta["low"], meta["high"])


def train_forest(df: DataFrame, features: list[str] | None = None, **options) -> IsolationForest:
    """A forest of ``df`` (see :func:`grow_forest`) and the range of its scores there."""
    forest = grow_forest(df, features, **options)
    forest.low, forest.high = _range(forest.raw_scores(df))
    return forest


def train_and_score(df: DataFrame, features: list[str] | None = None, *, keep: list[str] | None = None, out: str = "anomaly_score",
                    **options) -> tuple[IsolationForest, DataFrame]:
    """:func:`train_forest`, and the rows of ``df`` (their columns ``keep``, or all) with their scores by it.

    Each row walks the trees once: its raw score is stored, and tells both the range and the score.
    """
    forest = grow_forest(df, features, **options)
    raw = materialise(forest.raw_scores(df).select(*(df.columns if keep is None else keep), "raw_score"), "forest-raw")
    forest.low, forest.high = _range(raw)
    return forest, forest.scaled(raw, out, forest.low, forest.high)


def _range(raw: DataFrame) -> tuple[float, float]:
    r = raw.agg(F.min("raw_score"), F.max("raw_score")).first()
    return float(r[0]), float(r[1])


def grow_forest(df: DataFrame, features: list[str] | None = None, *, trees: int = 100, sample: int = 256,
                seed: int = 42, id_col: str = "transaction_id") -> IsolationForest:
    """Grow ``trees`` trees of ``sample`` rows each.

    The trees * sample rows with the smallest draws form one pool (all rows, if there are not as
    many); of the pool, each tree takes the ``sample`` rows with the smallest draws of its own. The
    last draw of the pool is found by counting, not by sorting, among the rows below a draw that about
    twice as many rows lie below (among all rows, if too few do); rows of equal draws belong to it together.
    """
    features = list(features or REQUIRED)
    check_contract(df, features)
    key = F.col(id_col).cast("string")
    rows = df.select(key.alias("_id"), F.array(*[F.col(c).cast("double") for c in features]).alias("x"), drawn(seed, key).alias("_u"))
    most = trees * sample
    n = df.count()
    near = materialise(rows.where(F.col("_u") <= 16 ** DRAW_DIGITS * 2 * most // max(n, 2 * most)), "forest-near")
    if near.count() < min(most, n):  # repeated ids may crowd above that draw
        near = materialise(rows, "forest-near")
    last = kth_largest(near.select((-F.col("_u")).cast("double").alias("_v")), [], "_v",
                       [("k", lambda n: F.least(F.lit(most), n))]).select((-F.col("value")).cast("long").alias("_last"))
    pool = materialise(near.join(F.broadcast(last), F.col("_u") <= F.col("_last")).select("_id", "x"), "forest-pool")  # one number
    size = pool.count()
    each = pool.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))  # at most trees * trees * sample rows
    order = Window.partitionBy("tree").orderBy(drawn(seed, "tree", "_id"), "_id")
    dealt = each.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= sample)
    used = min(sample, size)
    limit = max(1, math.ceil(math.log2(max(used, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf.sort_values("_id")["x"].to_numpy())
        out = pd.DataFrame(_grow(x, seed, tree, limit), columns=["node", "feature", "threshold", "left", "right", "depth"])
        out.insert(0, "tree", tree)
        return out

    nodes = dealt.select("tree", "_id", "x").groupBy("tree").applyInPandas(build, _NODES).toPandas()
    return IsolationForest(features, nodes, used)


def permutation_importance(forest: IsolationForest, df: DataFrame, *, rows: int | None = None, seed: int = 7,
                           id_col: str = "transaction_id") -> DataFrame:
    """Mean absolute score shift when one feature is taken from another row.

    Covers all rows, or a sample of ``rows`` rows if given. Rows are dealt into slices by
    hash; each gets its donor by a second shuffle of its slice.
    """
    key = F.col(id_col).cast("string")
    pool = df.select(key.alias("_id"), F.array(*[F.col(c).cast("double") for c in forest.features]).alias("x"))
    if rows is not None:
        pool = pool.orderBy(F.xxhash64("_id", F.lit(seed)), "_id").limit(rows)
    pool = materialise(pool, "importance-pool")
    slices = max(1, pool.count() // SLICE_ROWS)
    pool = pool.withColumn("_s", F.pmod(F.xxhash64("_id", F.lit(seed + 2)), F.lit(slices)))
    one = Window.partitionBy("_s")
    here = pool.withColumn("_i", F.row_number().over(one.orderBy(F.xxhash64("_id", F.lit(seed)), "_id")))
    donors = pool.select("_s", F.col("x").alias("donor"),
                         F.row_number().over(one.orderBy(F.xxhash64("_id", F.lit(seed + 1)), "_id")).alias("_i"))
    paired = here.join(donors, ["_s", "_i"])
    base = forest.raw_scores(paired, F.col("x"), "base")
    each = base.withColumn("f", F.explode(F.sequence(F.lit(0), F.lit(len(forest.features) - 1))))
    swapped = F.transform("x", lambda v, i: F.when(i == F.col("f"), F.element_at("donor", i + 1)).otherwise(v))
    moved = forest.raw_scores(each.withColumn("y", swapped), F.col("y"), "moved")
    names = F.array(*[F.lit(f) for f in forest.features])
    return (moved.groupBy(F.element_at(names, F.col("f") + 1).alias("feature"))
            .agg(F.avg(F.abs(F.col("base") - F.col("moved"))).alias("importance")))
