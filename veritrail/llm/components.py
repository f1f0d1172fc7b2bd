"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """u, v: each node but the smallest of its component, and that smallest node. edges: u, v of one ordered type, in any direction.

    Self-links and nulls take no part. The minimum of a node's neighbours is aggregated before the shuffle and joined back, so a node
    with very many neighbours is never gathered in one task. It ends when a step changes no edge.
    """
    edges = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    n = edges.count()
    while n:
        before, edges = edges, materialize(_small_star(_large_star(edges)), "edges")
        n, m = edges.count(), n
        if n == m and edges.join(before, ["u", "v"], "left_anti").isEmpty():
            break
    return edges
