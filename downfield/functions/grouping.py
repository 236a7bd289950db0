"""Grouping patterns that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(df: DataFrame, *columns: str, count: str = "copies") -> DataFrame:
    """The distinct rows over `columns`, each with the number of times it occurs.

    Copies are summed before the shuffle, so a group of copies travels as one row per task.
    """
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(count))


def latest(value: str, order: str = "last_week") -> Column:
    """Aggregate: the value of the highest `order` among the rows that have a value."""
    return F.max(F.when(F.col(value).isNotNull(), F.struct(order, value)))[value]


def totals_with_profile(
    df: DataFrame,
    keys: Sequence[str],
    profile: Mapping[str, str],
    sums: Mapping[str, str],
    week: str = "week",
    weeks: str | None = None,
    partition_by: Sequence[str] | None = None,
) -> DataFrame:
    """Sums per key, plus one descriptive value per profile column: the one of the latest week.

    `profile` and `sums` map output names to input columns. The first grouping includes the profile
    columns, so it sums numbers only and runs as a hash aggregate with map-side combine; choosing
    among texts then happens on the few rows that remain per key. `weeks` names a further output, the
    number of different weeks, for which the first grouping is by week too. `partition_by` names the keys
    that the result is dealt by, where a join needs fewer than all of them.
    """
    by_week = [F.col(week).alias("last_week")] if weeks else []
    parts = df.groupBy(*keys, *[F.col(c).alias(name) for name, c in profile.items()], *by_week).agg(
        *([] if weeks else [F.max(week).alias("last_week")]), *[F.sum(c).alias(name) for name, c in sums.items()]
    )
    if partition_by:
        parts = parts.repartition(*partition_by)
    different = [F.size(F.collect_set("last_week")).cast("long").alias(weeks)] if weeks else []
    return parts.groupBy(*keys).agg(
        *[latest(name).alias(name) for name in profile], *[F.sum(name).alias(name) for name in sums], *different
    )


def join_on_same(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on equal columns where NULL equals NULL; the columns of `left` are kept."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in columns})
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in columns])
    return left.join(renamed, condition, how).drop(*[f"_right_{c}" for c in columns])
