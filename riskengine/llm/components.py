"""Connected components of a link table, in rounds of Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskengine.session import materialise


def connected(links: DataFrame, nodes: DataFrame | None) -> DataFrame:
    """(node, component): the smallest node each node is connected with.

    ``links`` has columns a, b; ``nodes`` (one column) adds nodes without links. Each round
    makes every node point at the smallest neighbour of its neighbours (large star,
    then small star), so chains shrink to a logarithm of their length. Rounds end when
    the edges no longer change. Every round is written to the shared folder, which cuts
    lineage; no round holds more edges than the one before it.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        around = both(edges)
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(
            F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select(
                "e.a", "e.b").where("a <> b").distinct()
        edges = materialise(small, "edges")
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0)),
                        F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    found = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    if nodes is None:
        return found
    alone = nodes.toDF("node").distinct().join(found.select("node"), "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))
