"""Connected components of a graph given as an edge table, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import written


def _oriented(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller end, once each, without loops."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for all nodes of edges (a, b): the component is its smallest node.

    A large step links every larger neighbour of a node to the smallest node around it, a small step every smaller one; both
    keep components. They alternate until all edges are stars around smallest nodes, after about the logarithm of the longest
    path. A hub's neighbours are never gathered: its smallest neighbour is an aggregate, joined back to the edges. Edges of
    each round are written to the shared folder.
    """
    edges = written(_oriented(edges), "edges")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(_oriented(large), "large-stars")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        following = written(_oriented(small), "small-stars")
        # all are stars if no node has two smaller neighbours, or one that has a smaller neighbour itself
        several = following.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")
        chained = following.select(F.col("b").alias("a")).distinct().join(following.select("a"), "a", "left_semi")
        if several.union(chained).limit(1).count() == 0:
            break
        edges = following
    return following.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        following.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
