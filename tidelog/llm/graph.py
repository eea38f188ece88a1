"""Connected components by alternating large-star and small-star rounds
(Kiveris et al., Connected Components in MapReduce and Beyond, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.operators.ordered import shared_checkpoint


def _digest(edges: DataFrame) -> tuple:
    """Count and sum of hashes: equal for equal edge sets."""
    h = F.xxhash64("u", "v").cast("decimal(20,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(h)).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b), undirected -> (node, component) for each node with an edge.

    ``component`` is the smallest node reachable. Each round halves distances; hot nodes
    are pre-aggregated (minimum per node) before the join. Null ends and loops are left out.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = shared_checkpoint(edges)
    seen = _digest(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        others = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = others.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()
        edges = shared_checkpoint(small)
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
