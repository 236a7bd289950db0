"""Connected components of a graph by alternating large and small stars.

Every round is a few group-bys and joins; the edges of a round are stored, so a lost executor repeats one
round at most. Group-bys combine before the shuffle and joins come straight from one, so neither a node with
very many links nor a large component has to fit into a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import stored


def _star_round(edges: DataFrame) -> DataFrame:
    """One large star and one small star over edges (u, v) with u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    nearest = large.groupBy("u").agg(F.min("v").alias("low"))
    moved = large.join(nearest, "u").select(
        F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v")
    )
    return moved.distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Edges may repeat, point either way or link a node to itself; edges with a null end are ignored. No edge
    gives no row.
    """
    u, v = F.greatest(left, right), F.least(left, right)
    # the edges are worked out once, also those from a node to itself
    links = stored(
        edges.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(u.alias("u"), v.alias("v")).distinct(), "edges"
    )
    current = links.where("u > v")
    alone = links.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component"))
    before = None
    while True:
        seen = Observation()
        mark = F.xxhash64("u", "v")
        current = stored(
            _star_round(current).observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(mark).alias("mark")), "edges"
        )
        now = (seen.get["n"], seen.get["mark"])
        if now == before or not now[0]:
            break
        before = now
    named = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return named.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
