"""Connected components of a link table, without collecting links or components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _tangled(edges: DataFrame) -> bool:
    """Whether a node has several links down, or links down and up: else every link ends at the smallest of its component."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return bool(nodes.agg(F.max(F.expr("down > 1 OR down = 1 AND up = 1"))).first()[0])


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of `links`; a component is named by its smallest node.

    Alternates two contractions until all links are stars around the smallest nodes: every node hands its larger
    neighbours, then its smaller ones, to the smallest node around it. The rounds grow with the logarithm of the longest
    path. Each round is written to the shared folder. A node with very many links is joined, never gathered.
    """
    edges = links.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u != v").distinct()
    edges = staged(edges, "links")
    while _tangled(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(large.where("u != v").distinct(), "links")
        # Edges point from larger to smaller nodes here.
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = staged(small.where("u != v").distinct(), "links")
    # Now every edge is (node, smallest node of its component).
    named = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return named.unionByName(named.select(F.col("component").alias("node"), "component").distinct())
