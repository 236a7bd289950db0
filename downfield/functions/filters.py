"""Optional filters, ordering and row limits of the question operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 500  # most rows of an answer unless the caller says otherwise


def equals(column: str, value) -> Column | None:
    return F.col(column) == value if value is not None else None


def upper_equals(column: str, value: str | None) -> Column | None:
    return F.col(column) == value.upper() if value is not None else None


def number_equals(column: str, value) -> Column | None:
    return F.col(column) == int(value) if value is not None else None


def contains_text(column: str, value: str | None) -> Column | None:
    """Case-insensitive search for the text anywhere in the column."""
    return F.col(column).ilike(f"%{value}%") if value is not None else None


def same_text(column: str, value: str | None) -> Column | None:
    """Case-insensitive equality."""
    return F.col(column).ilike(value) if value is not None else None


def at_least(column: str, value) -> Column | None:
    return F.col(column) >= value if value is not None else None


def at_most(column: str, value) -> Column | None:
    return F.col(column) <= value if value is not None else None


def where_all(df: DataFrame, conditions: Iterable[Column | None]) -> DataFrame:
    """Keep the rows that meet every condition that was given."""
    for condition in conditions:
        if condition is not None:
            df = df.where(condition)
    return df


def season_conditions(
    season: int | None, season_from: int | None = None, season_to: int | None = None, column: str = "season"
) -> list[Column | None]:
    return [
        number_equals(column, season),
        at_least(column, None if season_from is None else int(season_from)),
        at_most(column, None if season_to is None else int(season_to)),
    ]


def row_limit(limit: int | None) -> int | None:
    """The limit as given, None for all rows; anything but a whole number of at least 0 is an error."""
    if limit is not None and int(limit) < 0:
        raise ValueError(f"A row limit cannot be negative: {limit}")
    return None if limit is None else int(limit)


def top_rows(df: DataFrame, order: Sequence[Column], columns: Sequence[str], limit: int | None = None) -> DataFrame:
    """The first rows in the given order, all without a limit; ties are broken by the columns themselves.

    Sort and limit become one top-k per task and a merge of those, not a full sort.
    """
    ordered = df.orderBy(*order, *[F.asc_nulls_last(c) for c in columns])
    limit = row_limit(limit)
    return (ordered if limit is None else ordered.limit(limit)).select(*columns)
