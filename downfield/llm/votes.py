"""SimHash in column expressions: the hashes of a text's terms vote on the 64 bits of its fingerprint.

Terms are unfolded and counted by row, so a task adds up the votes of its texts before anything is shuffled. One
addition counts two bits, 32 bits apart, in the halves of a number.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HALVES = (1 << 32) + 1


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case words of a text, divided by white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def shingle_hashes(text: Column, size: int) -> Column:
    """Hashes of all runs of `size` words; of all words at once where there are fewer, none without words."""

    def runs(own: Column) -> Column:
        last = F.greatest(F.size(own) - size, F.lit(0))
        found = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(size)]))
        return F.when(F.size(own) > 0, found).otherwise(F.array().cast("array<long>"))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), runs)


def majority(hashes: str) -> Column:
    """The bits set in over half of a column of hashes, 0 without hashes, worked out within the row.

    A number holds the counts of every width-th bit side by side, so `width` sums count all bits. The sums are
    8, 16 or 32 bits wide by the number of hashes; two bits of each stay free, so that half of that number can be taken
    off without a carry.
    """
    n = F.size(hashes).cast("long")

    def voted(width: int) -> Column:
        lanes = sum(1 << at for at in range(0, 64, width))
        most = (1 << (width - 2)) - 1
        spare = (F.lit(most) - F.shiftright(n, 1)) * F.lit(lanes)

        def bit(at: int) -> Column:
            count = F.aggregate(
                F.col(hashes), F.lit(0).cast("long"),
                lambda sum_, h: sum_ + F.shiftrightunsigned(h, at).bitwiseAND(F.lit(lanes)),
            )
            return F.shiftleft(F.shiftrightunsigned(count + spare, width - 2).bitwiseAND(F.lit(lanes)), at)

        return reduce(Column.bitwiseOR, [bit(at) for at in range(width)])

    return F.when(n < 64, voted(8)).when(n < 1 << 14, voted(16)).otherwise(voted(32))


def fingerprints(rows: DataFrame, keep: list[str], hashes: Column) -> DataFrame:
    """(keep…, fingerprint): the bits set in over half of each row's hashes, 0 without hashes.

    Repeated hashes vote repeatedly. Rows are told apart by a number of their own.
    """
    keys = [*keep, "row"]
    votes = rows.select(*keep, hashes.alias("votes"), F.monotonically_increasing_id().alias("row")).select(
        *keys, F.explode_outer("votes").alias("vote")
    )
    sums = [
        F.coalesce(F.sum(F.shiftrightunsigned("vote", b).bitwiseAND(F.lit(HALVES))), F.lit(0)).alias(f"c{b}")
        for b in range(32)
    ]
    counted = votes.groupBy(*keys).agg(*sums, F.count("vote").alias("n"))
    bits = []
    for b in range(64):
        sum_ = F.col(f"c{b % 32}")
        own = F.shiftrightunsigned(sum_, 32) if b >= 32 else sum_.bitwiseAND(F.lit((1 << 32) - 1))
        bits.append(F.when(own * 2 > F.col("n"), F.lit(signed(1 << b))).otherwise(F.lit(0)))
    return counted.select(*keep, reduce(Column.bitwiseOR, bits).alias("fingerprint"))
