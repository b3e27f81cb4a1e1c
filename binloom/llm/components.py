"""Connected components of an edge table by alternating large and small stars.

Each round ties the larger neighbours of every node to its smallest one, then ties a node's smaller
neighbours together; after a few rounds every node points to the smallest of its component.  Rounds
are joins and minima that Spark combines before its shuffles; nothing is gathered by node.  The minima
are written between, so both sides of a join are plain shuffles whose hot keys Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of edges (a, b: long); component is the smallest node reachable.

    Loops, repeated and null edges are left out; no edges give no rows.
    """
    tied = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    tied = cut(tied, "edges")
    before, now = None, _state(tied)
    while now != before and now[0]:
        both = tied.union(tied.select("b", "a"))
        least = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "stars")
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        least = cut(large.groupBy("a").agg(F.min("b").alias("m")), "stars")
        tied = large.join(least, "a")
        tied = cut(tied.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        before, now = now, _state(tied)
    return tied.select(F.col("a").alias("node"), F.col("b").alias("component")).union(tied.select("b", "b").distinct())
