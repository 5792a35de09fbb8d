"""Connected components of a graph held in DataFrames.

Alternating large-star and small-star steps: each replaces the edges by as
many edges to smaller neighbours.  A node's neighbours are never gathered;
their least is found by a partial aggregation and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktum.llm.storage import cut


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of the edges (u, v) but the least of each component, whose id the component bears."""
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct())
    while not _stars(edges):
        edges = cut(_small(_large(edges)))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one edge, to one that has none to a smaller one."""
    if not edges.groupBy("u").count().filter("count > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()
