"""Connected components by alternating large-star and small-star steps, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most edges whose nodes' least neighbours are broadcast by hint: some MB, whatever the graph.
SMALL_EDGES = 1 << 16


def _checked(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """``edges`` cut off from their lineage, and a fingerprint of their set."""
    edges = edges.distinct().checkpoint()
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return edges, (row["n"], row["h"])


def components(edges: DataFrame, limit: int = SMALL_EDGES) -> DataFrame:
    """``node`` and ``root`` (smallest node reached) of every node of ``edges`` (u, v: long).

    Each step joins every edge with the smallest neighbour of its node; those
    are found by a pre-aggregated minimum, so no node's neighbours meet in one
    task. Loops and repeated edges don't matter; no edges give no rows.
    """
    edges, mark = _checked(edges.where("u is not null and v is not null and u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v"))

    def star(pairs: DataFrame, larger: bool) -> DataFrame:
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = F.broadcast(least) if mark[0] <= limit else least
        joined = pairs.join(least, "u")
        moved = joined.where("v > u" if larger else "v <> m").selectExpr("v as u", "m as v")
        own = least.selectExpr("u", "m as v")
        return (moved if larger else moved.unionByName(own)).where("u <> v")

    while mark[0]:
        both = edges.unionByName(edges.selectExpr("v as u", "u as v"))
        large = star(both, True).selectExpr("greatest(u, v) as u", "least(u, v) as v")
        edges, new = _checked(star(large.distinct(), False).selectExpr("greatest(u, v) as u", "least(u, v) as v"))
        if new == mark:
            break
        mark = new
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).join(roots.select("node"), "node", "left_anti").distinct())
