"""Connected components by alternating large-star and small-star steps; nothing but counts reaches the driver.

The steps go on until the edges don't change, which takes a number of rounds that grows with the logarithm of the longest path.
The join on a node with many neighbours is left to adaptive execution, which splits a skewed partition; a plan that meets such
nodes by broadcasts of their own is too large for a small driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docquarry.session import stash


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: link each node's neighbours to the smallest node near it."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    linked = both.join(low, "a")
    if large:
        out = linked.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
    return out.where("a != b").distinct()


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """node and root (smallest node of its component) for all nodes of edges (a, b); nodes without edges aren't returned."""
    edges = stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), name)
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now, last = state(edges), None
    while now != last:
        edges = stash(_star(_star(edges, True), False), name)
        now, last = state(edges), now
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
