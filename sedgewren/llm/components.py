"""Connected components by alternating large-star and small-star steps, each a few aggregations and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewren.llm.common import materialise


def _with_least(edges: DataFrame) -> DataFrame:
    """u, v, m: edges with the smallest neighbour of u. The neighbours are written first, so that both sides of the join
    are dealt out for it alone and adaptive execution can split the edges of a star's centre."""
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    return edges.join(least, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: u, v (longs). Returns node, root for every node of an edge; root is the component's smallest node.

    Every step keeps the components and at most the number of edges; it ends when all components are stars, which takes a
    number of steps that grows with the logarithm of the longest chain. Edges are never collected.
    """
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    # Edges go from larger to smaller nodes, so once no node is both, each component is a star around its smallest node.
    while not e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "edges")
        joined = _with_least(large)
        small = joined.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = materialise(small.distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
