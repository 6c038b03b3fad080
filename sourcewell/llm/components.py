"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, deal_mask, deals, dealt


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u, v), u > v."""
    both = dealt(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), deal_mask())
    # The root of a large component has many links: they meet its row in as many tasks as they are dealt to.
    large = both.join(deals(least, "u", "m"), ["u", "deal"]).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    # Links of a node to its own least neighbour stay: they come from that neighbour's side as (u, v).
    large = dealt(large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct(), "v")
    least = large.groupBy("u").agg(F.min("v").alias("m"), deal_mask())
    small = large.join(deals(least, "u", "m"), ["u", "deal"]).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of its component, for every node of edges (a, b) that isn't the smallest.

    Each round is checkpointed, and rounds grow with the logarithm of the longest path. Loops and repeated edges
    don't matter; nothing but two numbers a round reaches the driver.
    """
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = _state(edges)
    while True:
        edges = cut(_stars(edges))
        before, state = state, _state(edges)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
