"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _star(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Large star: a node's larger neighbours move to its least neighbour. Small star: a node and its
    smaller neighbours move to the least of them."""
    if both_ways:
        pairs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = pairs.filter("v > u").join(least.hint("shuffle_merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = edges.join(least.hint("shuffle_merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.filter("u > v").distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of ``links`` (u, v), where the component is its least node.

    A star needs each node's least neighbour only, which is summed before it is shuffled; no node's
    neighbours meet in one place. Each round is written to the shared folder. Null ends are no links.
    """
    ordered = links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, told = written(ordered, "links"), None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == told:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        told, before = state, edges
        large = written(_star(edges, True), "large-star")
        edges = written(_star(large, False), "small-star")
        drop_written(large)
        drop_written(before)
