"""Positions of rows in a sorted order, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, whole_row


def numbered(frame: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """The rows with `position` (from 0 within each group, in the given order) and `total` (rows of the group).

    Rows are dealt to tasks by range over groups and order, so a large group takes many tasks; places within a
    file and the counts of the files before it give the position. Group columns must not be null. Rows that
    agree in groups and order are spread and get any of their positions. The result is stored.
    """
    spread = F.xxhash64(F.monotonically_increasing_id())
    keys = [F.col(g) for g in groups]
    rows = frame.select(whole_row(frame).alias("row"), *keys, *[c.alias(f"order{i}") for i, c in enumerate(order)])
    rows = rows.withColumn("spread", spread)
    sort = [c for c in rows.columns if c != "row"]
    placed = stored(
        rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
        .select("row", *keys, F.monotonically_increasing_id().alias("place"), F.spark_partition_id().alias("part")),
        name,
    )
    parts = placed.groupBy(*keys, "part").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("size"))
    of_group = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    before = F.sum("size").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select(
        *[F.col(g).alias(f"of_{g}") for g in groups], F.col("part").alias("of_part"),
        (F.coalesce(before, F.lit(0)) - F.col("start")).alias("shift"), F.sum("size").over(of_group).alias("total"),
    )
    same = F.col("part") == F.col("of_part")
    for g in groups:
        same &= F.col(g) == F.col(f"of_{g}")
    return placed.join(offsets, same).select("row.*", (F.col("place") + F.col("shift")).alias("position"), "total")
