"""Trailing averages over the last rows of a group, for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LANES = 256
BLOCK = 100_000


def trailing_means(
    runs: DataFrame, keys: Sequence[str], order: str, means: Mapping[str, str], rows: int = 3, copies: str = "copies"
) -> DataFrame:
    """Unfold counted rows and add averages over the current and the `rows - 1` preceding rows of a key.

    `runs` holds distinct rows with the number of `copies` of each. `means` maps new column names to
    input columns; rows are ordered by `order`, which should have few values per key (a week), and
    where it ties by a hash of the row. The result equals
    `avg(c) OVER (PARTITION BY keys ORDER BY … ROWS BETWEEN rows - 1 PRECEDING AND CURRENT ROW)`
    over the unfolded rows, but no task has to hold a whole key:

    * From its `rows`-th copy on, a copy sees only copies of itself, so those travel as blocks of at
      most BLOCK rows and unfold at the end.
    * A key is cut into chunks by `order` and a hash lane. Rows past the first `rows - 1` of a chunk
      have their whole frame inside it.
    * The first rows of each chunk need the last rows of the chunk before. Only these edge rows meet
      in one window per key, at most `2 * (rows - 1)` per chunk; the others go past it in lanes.
    """
    columns = [c for c in runs.columns if c != copies]
    reach = rows - 1
    at, weight, mix, lane, nth, edge = "_at", "_weight", "_hash", "_lane", "_nth", "_edge"

    beyond = F.greatest(F.col(copies) - reach, F.lit(0))
    pieces = F.least(F.col(copies), F.lit(reach)) + F.ceil(beyond / BLOCK)
    folded = (
        runs.withColumn(mix, F.xxhash64(*columns))
        .withColumn(lane, F.pmod(mix, F.lit(LANES)))
        .withColumn(at, F.explode(F.sequence(F.lit(1).cast("long"), pieces)))
        .withColumn(
            weight,
            F.when(F.col(at) <= reach, F.lit(1).cast("long")).otherwise(
                F.least(beyond - (F.col(at) - rows) * BLOCK, F.lit(BLOCK))
            ),
        )
        .drop(copies)
    )

    others = [c for c in columns if c not in (*keys, order)]
    chunk = Window.partitionBy(*keys, order, lane).orderBy(mix, *others, at)
    inner = {f"_inner_{name}": F.avg(c).over(chunk.rowsBetween(-reach, 0)) for name, c in means.items()}
    chunked = folded.withColumns(
        {nth: F.row_number().over(chunk), "_follower": F.lead(F.lit(1), reach).over(chunk), **inner}
    ).withColumn(edge, (F.col(nth) <= reach) | F.col("_follower").isNull())

    spread = F.when(F.col(edge), F.lit(-1)).otherwise(F.pmod(F.xxhash64(order, lane, nth), F.lit(LANES)))
    across = (
        Window.partitionBy(*keys, "_spread").orderBy(F.asc_nulls_last(order), lane, nth).rowsBetween(-reach, 0)
    )
    joined = chunked.withColumn("_spread", spread).withColumns(
        {f"_outer_{name}": F.avg(c).over(across) for name, c in means.items()}
    )
    result = joined.select(
        *columns,
        *[
            F.when(F.col(nth) <= reach, F.col(f"_outer_{name}")).otherwise(F.col(f"_inner_{name}")).alias(name)
            for name in means
        ],
        F.explode(F.sequence(F.lit(1).cast("long"), F.col(weight))).alias("_copy"),
    )
    return result.drop("_copy")
