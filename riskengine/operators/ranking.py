"""Exact order statistics and rank sums without sorting everything in one task.

Scores are put into ``BUCKETS`` near-equal buckets, whose edges come from a
quantile sketch. Per-bucket counts (small, map-side combined) tell which bucket
holds a wanted rank; only rows of that bucket are looked at closer. A bucket with
more than ``BUCKET_ROWS`` distinct scores is cut again by a sketch of its own, level
by level, so no sort holds more, whatever the size of the input. The edges steer the
balance only: results are exact for any edges.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskengine.session import materialise

BUCKETS = 1024                          # the driver holds this many edges
BUCKETS_CONF = "spark.riskengine.buckets"  # raise it for larger inputs
BUCKET_ROWS = 1_000_000                 # distinct scores that one task sorts
BUCKET_ROWS_CONF = "spark.riskengine.bucketRows"
FINER = 256                             # parts into which a larger bucket is cut
_LOW = float("-inf")


def clean_score(score: Column | str) -> Column:
    """NULL and NaN scores rank below every number."""
    s = (F.col(score) if isinstance(score, str) else score).cast("double")
    return F.when(s.isNull() | F.isnan(s), F.lit(_LOW)).otherwise(s)


def reaches(score: Column | str, threshold: Column | float) -> Column:
    """Whether a usable score is at or above a usable threshold; never NULL."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    s = clean_score(score)
    return F.coalesce((s > F.lit(_LOW)) & ~F.isnan(limit) & (s >= limit), F.lit(False))


def score_edges(df: DataFrame, score: str, buckets: int | None = None) -> list[float]:
    buckets = buckets or int(df.sparkSession.conf.get(BUCKETS_CONF, str(BUCKETS)))
    qs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(clean_score(score), qs, buckets * 10).alias("q")).first()
    return sorted({float(v) for v in (row["q"] or []) if v not in (_LOW, float("inf"))})


def with_bucket(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Add ``_bucket``: the number of edges not above the value."""
    if not edges:
        return df.withColumn("_bucket", F.lit(0))
    splits = [_LOW, *edges, float("inf")]
    return (Bucketizer(splits=splits, inputCol=value, outputCol="_bucket").transform(df)
            .withColumn("_bucket", F.col("_bucket").cast("int")))


def finer(points: DataFrame, cell: list[str], value: str) -> DataFrame | None:
    """``points`` (distinct values of each cell) with the too large cells cut by value; None if there is none.

    ``_bucket`` is one of the cell's columns and keeps its order: bucket b becomes b * FINER + 0, 1, ...
    A cell of one value is as small as it gets.
    """
    most = int(points.sparkSession.conf.get(BUCKET_ROWS_CONF, str(BUCKET_ROWS)))
    sizes = points.groupBy(*cell).agg(F.count(F.lit(1)).alias("_rows"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    large = sizes.filter((F.col("_rows") > most) & (F.col("_lo") < F.col("_hi"))).select(*cell)
    if large.isEmpty():
        return None
    parts = [k / FINER for k in range(1, FINER)]
    edges = points.join(large, cell, "left_semi").groupBy(*cell).agg(
        F.percentile_approx(value, parts, FINER * 10).alias("_edges"), F.max(value).alias("_top"))
    # the highest value is an edge too, so a cut always parts two values
    edges = edges.select(*cell, F.array_distinct(F.concat("_edges", F.array("_top"))).alias("_edges"))
    part = F.coalesce(F.size(F.filter("_edges", lambda e: e <= F.col(value))), F.lit(0))
    cut = points.join(edges, cell, "left").withColumn("_bucket", F.col("_bucket") * (FINER + 1) + part)
    return materialise(cut.drop("_edges"), "points")


def kth_largest(df: DataFrame, groups: list[str], score: str, wanted: list[tuple[str, object]], *,
                sub: Column | None = None, edges: list[float] | None = None,
                buckets: int | None = None) -> DataFrame:
    """The k-th largest score of every group, for each wanted (label, k as a function of n).

    Gives (groups, label, n, k, value[, sub], left): ``left`` is how many rows of
    equal value (and ``sub``) belong to the top k. ``sub`` breaks ties ascending and has
    few values per score. Groups may be few and huge: no group is ever collected, only
    its bucket counts.
    """
    edges = score_edges(df, score, buckets) if edges is None else edges
    rows = with_bucket(df.withColumn("_v", clean_score(score)), "_v", edges).withColumn("_bucket", F.col("_bucket").cast("long"))
    counts = rows.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    # at most buckets + 1 count rows per group
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    total = counts.withColumn("n", F.sum("_c").over(whole))
    label_rank = F.explode(F.array(*[
        F.struct(F.lit(name).alias("label"), k(F.col("n")).cast("long").alias("k"))
        for name, k in wanted]))

    def placed(parts: DataFrame, within: list[str]) -> DataFrame:
        """Of the parts (with counts) of each ``within``, the one that holds the rank ``_left``."""
        w = Window.partitionBy(*within).orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
        above = parts.withColumn("_above", F.coalesce(F.sum("_c").over(w), F.lit(0)))
        held = above.filter((F.col("_above") < F.col("_left")) & (F.col("_left") <= F.col("_above") + F.col("_c")))
        return held.withColumn("_left", F.col("_left") - F.col("_above")).drop("_above", "_c")

    ranks = total.withColumn("_w", label_rank).select(*groups, "_bucket", "n", "_w.label", "_w.k", F.col("_w.k").alias("_left"), "_c")
    # one row per (group, label): groups are calendar days or none at all
    first = materialise(placed(ranks, [*groups, "label"]), "ranks")
    finest = ["_v"] if sub is None else ["_v", "_sub"]
    if sub is not None:
        rows = rows.withColumn("_sub", sub)
    cell = [*groups, "_bucket"]
    inside = (rows.join(F.broadcast(first.select(*cell).distinct()), cell, "left_semi")
              .groupBy(*cell, *finest).agg(F.count(F.lit(1)).alias("_c")))
    inside = materialise(inside, "points")
    while (cut := finer(inside, cell, "_v")) is not None:
        # each old bucket's parts lie next to each other: b * (FINER + 1) and the ones after it
        old = F.floor(F.col("_bucket") / (FINER + 1))
        parts = cut.groupBy(*cell).agg(F.sum("_c").alias("_c")).withColumn("_old", old)
        known = first.withColumnRenamed("_bucket", "_old")
        first = materialise(placed(parts.join(known, [*groups, "_old"]), [*groups, "label"]).drop("_old"), "ranks")
        inside = cut.join(F.broadcast(first.select(*cell).distinct()), cell, "left_semi")
    order = [F.desc("_v")] + ([] if sub is None else [F.asc("_sub")])
    w = (Window.partitionBy(*cell).orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, -1))
    hit = (inside.withColumn("_above", F.coalesce(F.sum("_c").over(w), F.lit(0)))
           .join(F.broadcast(first), cell)
           .filter((F.col("_above") < F.col("_left"))
                   & (F.col("_left") <= F.col("_above") + F.col("_c"))))
    return hit.select(*groups, "label", "n", "k", F.col("_v").alias("value"),
                      *([] if sub is None else [F.col("_sub").alias("sub")]),
                      (F.col("_left") - F.col("_above")).alias("left"))


def exact_quantiles(df: DataFrame, value: str, quantiles: list[float],
                    groups: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation, as (groups, quantile, value)."""
    groups = groups or []
    rows = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))

    def at(q, up):
        def k(n):
            pos = F.lit(float(q)) * (n - 1)
            return n - (F.ceil(pos) if up else F.floor(pos))
        return k

    wanted = [(f"{q!r}|{side}", at(q, side == "hi")) for q in quantiles for side in ("lo", "hi")]
    got = kth_largest(rows, groups, value, wanted)
    parts = F.split("label", r"\|")
    got = got.withColumns({"quantile": parts[0].cast("double"), "_side": parts[1]})
    both = got.groupBy(*groups, "quantile").agg(
        F.first("n").alias("n"),
        F.max(F.when(F.col("_side") == "lo", F.col("value"))).alias("_lo"),
        F.max(F.when(F.col("_side") == "hi", F.col("value"))).alias("_hi"))
    pos = F.col("quantile") * (F.col("n") - 1)
    return both.select(*groups, "quantile", (
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * (pos - F.floor(pos))).alias("value"))


def score_curve(df: DataFrame, score: str, label: str, buckets: int | None = None) -> DataFrame:
    """One row per distinct score, descending: rows and frauds at it and above it.

    Columns: score, n, pos, n_above, pos_above (both including the score itself),
    total_n, total_pos. NULL labels are left out.
    """
    rows = df.filter(F.col(label).isNotNull())
    edges = score_edges(rows, score, buckets)
    points = (with_bucket(rows.withColumn("score", clean_score(score)), "score", edges)
              .groupBy(F.col("_bucket").cast("long").alias("_bucket"), "score")
              .agg(F.count(F.lit(1)).alias("n"),
                   F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos")))
    points = materialise(points, "points")
    while (cut := finer(points, ["_bucket"], "score")) is not None:
        points = cut
    # from here to the join one row per bucket
    per_bucket = points.groupBy("_bucket").agg(F.sum("n").alias("_bn"), F.sum("pos").alias("_bp"))
    whole = Window.partitionBy(F.lit(0))
    above = whole.orderBy(F.desc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        "_bucket", F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_on"),
        F.coalesce(F.sum("_bp").over(above), F.lit(0)).alias("_op"),
        F.sum("_bn").over(whole).alias("total_n"), F.sum("_bp").over(whole).alias("total_pos"))
    w = (Window.partitionBy("_bucket").orderBy(F.desc("score"))
         .rowsBetween(Window.unboundedPreceding, 0))
    return (points.withColumns({"_n": F.sum("n").over(w), "_p": F.sum("pos").over(w)})
            .join(offsets, "_bucket")
            .select("score", "n", "pos", (F.col("_n") + F.col("_on")).alias("n_above"),
                    (F.col("_p") + F.col("_op")).alias("pos_above"), "total_n", "total_pos"))
