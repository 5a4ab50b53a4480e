"""Connected components of an edge list, with alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlake.llm.common import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them. Edges have v < u."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    siblings = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return siblings.unionByName(least.select("u", F.col("m").alias("v"))).filter("u != v")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``edges`` (u, v) reaches.

    Self-loops are ignored. Nodes and edges stay distributed; the driver sees a count and a checksum.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(ordered.filter("u != v").distinct(), "components")
    state, last = _state(now), None
    while state != last:  # a round either changes the edges or they are stars: O(log^2) rounds
        before, now = now, materialize(_small_star(_large_star(now).distinct()).distinct(), "components")
        release(before)
        last, state = state, _state(now)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
