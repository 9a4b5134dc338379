"""Connected components by alternating large-star and small-star steps (Kiveris et al. 2014).

Each step is one min-aggregate and one equi-join, so a node with very many neighbours is
pre-aggregated before its shuffle and its join side is split by adaptive execution. Every step is
written to the shared folder; nothing but two numbers per step comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize


def connected_components(spark: SparkSession, edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows (node, component): the smallest node reachable, for each node that has an edge.

    Null ends, self-loops and repeated edges are ignored; no edges give no rows.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where(
        F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))
    )
    now = materialize(spark, pairs.distinct(), "cc")
    mark = _mark(now)
    while mark[0]:
        now = materialize(spark, _small_star(_large_star(now)), "cc")
        after = _mark(now)
        if after == mark:
            break
        mark = after
    # Now every edge (u, v) has v the least node of its component.
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node is joined to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))  # w > u
    return up.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below are joined to the least of them. Edges come with v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
