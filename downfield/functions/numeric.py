"""Rounding, ratios and flag counts, as columns and as SQL text.

Operators with dozens of output columns use the text form: one parse replaces hundreds of calls into
the JVM while the query is put together.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(value: Column, digits: int) -> Column:
    """Round a double by scaling: 1.005 to two digits is 1.0, because 1.005 * 100 is 100.49999…

    `F.round(value, digits)` rounds the decimal text of the double instead and gives 1.01.
    """
    scale = F.lit(float(10**digits))
    return F.round(value * scale) / scale


def half_even(value: Column, digits: int) -> Column:
    """Round the double itself, not its decimal text; only a value exactly between two results goes to the even one.

    The product with the power of ten is split into its rounded part and what rounding left out (digits up to 2).
    Where the rounded part lies between two whole numbers, the rest decides.
    """
    scale = F.lit(float(10**digits))
    high = value * F.lit(134217729.0) - (value * F.lit(134217729.0) - value)
    product = value * scale
    rest = (high * scale - product) + (value - high) * scale
    tie = F.abs(product - F.floor(product) - F.lit(0.5)) == 0
    whole = (
        F.when(tie & (rest > 0), F.ceil(product).cast("double"))
        .when(tie & (rest < 0), F.floor(product).cast("double"))
        .otherwise(F.rint(product))
    )
    return whole / scale


def ratio(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, NULL where the denominator is 0."""
    return numerator / F.nullif(denominator, F.lit(0))


def percent(numerator: Column, denominator: Column, digits: int) -> Column:
    return half_up(ratio(F.lit(100.0) * numerator, denominator), digits)


def half_up_text(value: str, digits: int) -> str:
    scale = f"{10**digits}.0D"
    return f"round(({value}) * {scale}) / {scale}"


def percent_text(numerator: str, denominator: str, digits: int) -> str:
    return half_up_text(f"100.0D * {numerator} / nullif({denominator}, 0)", digits)


def flag_text(condition: str) -> str:
    """1 where the condition holds, 0 where it is false or NULL."""
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"
