"""Connected components of an edge list, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import deleted, written


def _large_star(e: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the least node around it."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Every node hands itself and its smaller neighbours to the least of them. Edges go from larger to smaller."""
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _is_star_forest(e: DataFrame) -> bool:
    """Whether every node has one edge to a smaller node, and none of those has one."""
    roles = e.select(F.col("u").alias("id"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(e.select(F.col("v").alias("id"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    return roles.groupBy("id").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c + p > 1").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """node, component: the smallest node reachable, for each node of an edge.

    Contraction by stars: neighbours are handed on to ever smaller nodes until each component is a star around its
    smallest one. An edge is never added, repeated ones fall together, so the table shrinks towards one edge a node, in
    a number of rounds like the logarithm of the longest path. Hubs are safe: minima are combined before the shuffle and
    skewed joins are split at run time. Null ends are left out; a self-loop is a node of its own; repeated edges count
    once. Each round's table replaces the one before.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    now = written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    alone, stars = now.where("u = v").select("u", "v"), now.where("u <> v")
    first = now
    while not _is_star_forest(stars):
        large = written(_large_star(stars), "edges")
        new = written(_small_star(large), "edges")
        deleted(large)
        if now is not first:
            deleted(now)
        now, stars = new, new
    whole = stars.unionByName(stars.select(F.col("v").alias("u"), "v")).unionByName(alone)
    return whole.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
