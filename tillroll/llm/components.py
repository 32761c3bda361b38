"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two joins over the edges; the edges are written to the
shared folder after each round, so a lost executor repeats one round at most. Nodes are
never gathered: a node of any degree is reduced by ``min`` before the shuffle, and a skewed
join partition is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (a, b) with a > b."""
    if large:  # every node shows its larger neighbours the smallest node it knows
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges
    least = near.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    if large:
        moved = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:  # and its smaller neighbours; the node itself goes to the smallest too
        moved = near.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        moved = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b")))
        .first()
    )


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every linked node; the component is its smallest reachable node.

    Ends when a round leaves the edges as they were; then each node but the root of its
    component has one edge, to the root. An empty frame gives an empty result.
    """
    edges = written(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct(), "edges"
    )
    state = _state(edges)
    while state[0]:
        after = written(_star(_star(edges, True), False), "edges")
        new = _state(after)
        if new == state:
            break
        edges, state = after, new
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("b").alias("component")))
