"""Shaping of incoming rows: column names, stored types, appending by name, play preparation."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from downfield.functions.text import with_description


def safe_names(df: DataFrame) -> DataFrame:
    """Column names with `.`, space and `-` replaced by `_`."""
    return df.toDF(*[re.sub(r"[. \-]", "_", name) for name in df.columns])


def stored_type(data_type: T.DataType) -> T.DataType:
    """The type a column is stored as: whole numbers as long, floats as double, nested values as text."""
    if isinstance(data_type, T.IntegralType):
        return T.LongType()
    if isinstance(data_type, T.FloatType):
        return T.DoubleType()
    kept = (T.DoubleType, T.DecimalType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    return data_type if isinstance(data_type, kept) else T.StringType()


def _stored(field: T.StructField, target: T.DataType) -> str:
    column = f"`{field.name}`"
    if field.dataType == target:
        return column
    nested = isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))
    return f"CAST({f'to_json({column})' if nested else column} AS {target.simpleString()}) AS {column}"


def with_stored_types(
    df: DataFrame, existing: T.StructType | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Cast every column to its stored type, or to the type the existing table has for it; `keep` stay as they are."""
    known = {f.name: f.dataType for f in existing} if existing is not None else {}
    known |= {f.name: f.dataType for f in df.schema if f.name in keep}
    return df.selectExpr(*[_stored(f, known.get(f.name, stored_type(f.dataType))) for f in df.schema])


def merged_schema(existing: T.StructType | None, incoming: T.StructType) -> T.StructType:
    """The existing columns followed by the new ones; nothing is dropped or retyped."""
    fields = list(existing or [])
    names = {f.name for f in fields}
    return T.StructType(fields + [T.StructField(f.name, f.dataType) for f in incoming if f.name not in names])


def append_by_name(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of both; columns missing on one side are NULL there, types follow the existing table."""
    return existing.unionByName(with_stored_types(safe_names(incoming), existing.schema), allowMissingColumns=True)


def prepare_plays(plays: DataFrame) -> DataFrame:
    """Drop rows without both teams and add the description text."""
    if {"posteam", "defteam"} <= set(plays.columns):
        plays = plays.dropna(subset=["posteam", "defteam"])
    return with_description(plays)
