"""Mean, exact median and size of groups, without gathering a group in one place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from downfield.functions.grouping import join_on_same

RESOLUTION = 64  # buckets per whole number in the first histogram
DIGIT = 1 << 16  # buckets that each further digit cuts one into

_FACTS = ["_start", "_low", "_high", "_known", "_all", "_total"]


def middle_rows(
    counts: DataFrame, keys: Sequence[str], value: str, count: str, resolution: int = RESOLUTION, digits: int = 0
) -> DataFrame:
    """The rows whose values share a bucket with the middle of their group; all that has to be ranked.

    A histogram gives the totals of a group and the bucket that holds the middle rank (two buckets where the middle
    pair straddles a border). Each further digit of the value is a histogram inside these buckets, with counts that
    combine before the shuffle, and leaves about one row in 65,536. A group without any value keeps its NULL rows.

    Added columns: `_digit0` and so on, `_start` (rows before the bucket), `_low` and `_high` (the ranks wanted),
    `_known` (rows with a value), `_all` (all rows), `_total` (their sum).
    """
    first = F.floor(F.col(value) * resolution)
    rows = counts.withColumn("_digit0", first)
    if digits:
        rows = rows.withColumn("_rest", F.col(value) * resolution - first)
    known = F.col("_digit0").isNotNull()
    size = F.when(known, F.col("_size")).otherwise(0)
    group = Window.partitionBy(*keys)
    by_bucket = group.orderBy(F.asc_nulls_last("_digit0")).rowsBetween(Window.unboundedPreceding, 0)
    middle = (
        rows.groupBy(*keys, "_digit0")
        .agg(F.sum(count).alias("_size"), F.sum(F.col(value) * F.col(count)).alias("_amount"))
        .withColumns(
            {
                "_stop": F.sum(size).over(by_bucket),
                "_known": F.sum(size).over(group),
                "_all": F.sum("_size").over(group),
                "_total": F.sum("_amount").over(group),
            }
        )
        .withColumns(
            {
                "_start": F.col("_stop") - size,
                "_low": F.floor((F.col("_known") + 1) / 2),
                "_high": F.floor((F.col("_known") + 2) / 2),
            }
        )
        .where((known & (F.col("_start") < F.col("_high")) & (F.col("_stop") >= F.col("_low"))) | (F.col("_known") == 0))
        .select(*keys, "_digit0", *_FACTS)
    )
    found, bucket = join_on_same(rows, middle, [*keys, "_digit0"]), ["_digit0"]
    for number in range(1, digits + 1):
        # the remainder is in [0, 1], 1 only by rounding; equal values keep equal digits, larger ones no smaller
        name = f"_digit{number}"
        digit = F.least(F.floor(F.col("_rest") * DIGIT), F.lit(DIGIT - 1))
        rows = found.withColumn(name, digit).withColumn("_rest", F.col("_rest") * DIGIT - F.col(name))
        inside = Window.partitionBy(*keys, *bucket).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
        narrowed = (
            rows.groupBy(*keys, *bucket, name).agg(F.sum(count).alias("_size"), *[F.max(f).alias(f) for f in _FACTS])
            .withColumn("_stop", F.col("_start") + F.sum("_size").over(inside))
            .withColumn("_start", F.when(F.col(name).isNull(), F.col("_start")).otherwise(F.col("_stop") - F.col("_size")))
            .where(F.col(name).isNull() | ((F.col("_start") < F.col("_high")) & (F.col("_stop") >= F.col("_low"))))
            .select(*keys, *bucket, name, *_FACTS)
        )
        bucket = [*bucket, name]
        found = join_on_same(rows.drop(*_FACTS), narrowed, [*keys, *bucket])
    return found.drop("_rest")


def summarize(
    counts: DataFrame, keys: Sequence[str], value: str, count: str, resolution: int = RESOLUTION, digits: int = 0
) -> DataFrame:
    """Mean, median and number of values per key, where each row stands for `count` equal values.

    NULL values count towards `size` only; for an even number the two middle values are averaged. Only the rows of
    the middle bucket are ranked, see `middle_rows`: values within 1 / `resolution` of each other, or, with
    `digits`, within 1 / (`resolution` * 65536 ** `digits`).
    """
    bucket = [f"_digit{n}" for n in range(digits + 1)]
    by_value = Window.partitionBy(*keys, *bucket).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = middle_rows(counts, keys, value, count, resolution, digits).withColumn(
        "_upto", F.col("_start") + F.sum(count).over(by_value)
    )

    def holding(rank: str) -> Column:
        first = F.col("_upto") - F.col(count)
        return F.max(F.when((first < F.col(rank)) & (F.col("_upto") >= F.col(rank)), F.col(value)))

    return ranked.groupBy(*keys).agg(
        (F.max("_total") / F.nullif(F.max("_known"), F.lit(0))).alias("mean"),
        ((holding("_low") + holding("_high")) / 2).alias("median"),
        F.max("_all").alias("size"),
    )
