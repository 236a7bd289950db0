"""Connected groups of fingerprints that meet in buckets, without listing all pairs of a bucket.

First every member of a bucket is compared with the bucket's hub alone. Most members of a group of near copies
are joined that way. Only buckets whose members are then still in several components are looked at again, and
there only pairs of different components, so a group of n near copies costs n comparisons and not n².
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import connected_components

Near = Callable[[Column, Column], Column]


def differing_bits(left: Column, right: Column) -> Column:
    return F.bit_count(left.bitwiseXOR(right))


def hub_pairs(members: DataFrame, near: Near) -> DataFrame:
    """(a, b) of the members (bucket, node, owner) with their bucket's hub, its smallest owner, where near."""
    hubs = members.groupBy("bucket").agg(
        F.min(F.when(F.col("owner"), F.col("node"))).alias("hub"),
        F.min("node").alias("least"), F.max("node").alias("most"),
    ).where("least < most")
    met = members.select("bucket", "node").join(hubs.select("bucket", "hub"), "bucket")
    return met.where((F.col("node") != F.col("hub")) & near(F.col("node"), F.col("hub"))).select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")
    ).distinct()


def split_pairs(members: DataFrame, components: DataFrame, near: Near) -> DataFrame:
    """(a, b, component_a, component_b): near pairs of one bucket whose components differ.

    In each bucket the members of its largest component meet only members of other components.
    """
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    sized = components.join(sizes, "component")
    placed = members.join(sized, "node", "left").select(
        "bucket", "node", "owner", F.coalesce("component", "node").alias("component"),
        F.coalesce("size", F.lit(1)).alias("size"),
    )
    mixed = placed.groupBy("bucket").agg(
        F.min("component").alias("least"), F.max("component").alias("most"),
        F.max(F.struct("size", "component")).alias("main"),
    ).where("least < most").select("bucket", F.col("main.component").alias("main"))
    met = stored(placed.join(mixed, "bucket").drop("size"), "mixed")
    left = met.where("component <> main").select(
        F.col("bucket"), F.col("node").alias("a"), F.col("owner").alias("owner_a"), F.col("component").alias("component_a")
    )
    right = met.select(
        F.col("bucket").alias("bucket_b"), F.col("node").alias("b"), F.col("owner").alias("owner_b"),
        F.col("component").alias("component_b"),
    )
    on = (
        (F.col("bucket") == F.col("bucket_b")) & (F.col("component_a") != F.col("component_b"))
        & (F.col("owner_a") | F.col("owner_b")) & near(F.col("a"), F.col("b"))
    )
    return left.join(right, on).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.when(F.col("a") < F.col("b"), F.col("component_a")).otherwise(F.col("component_b")).alias("component_a"),
        F.when(F.col("a") < F.col("b"), F.col("component_b")).otherwise(F.col("component_a")).alias("component_b"),
    ).distinct()


def merge(components: DataFrame, links: DataFrame) -> DataFrame:
    """Components after links (component_a, component_b) between them."""
    joined = connected_components(links, "component_a", "component_b").select(
        F.col("node").alias("component"), F.col("component").alias("merged")
    )
    loose = joined.select(F.col("component").alias("node"), "merged")
    moved = components.join(joined, "component", "left").select(
        "node", F.coalesce("merged", "component").alias("component")
    )
    fresh = loose.join(components.select("node"), "node", "left_anti").select(
        "node", F.col("merged").alias("component")
    )
    return moved.unionByName(fresh)


def bucket_components(members: DataFrame, near: Near) -> DataFrame:
    """(node, component) of all nodes that are near another one of their bucket, directly or by steps."""
    first = stored(connected_components(hub_pairs(members, near)), "components")
    return stored(merge(first, split_pairs(members, first, near)), "components")
