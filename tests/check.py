"""Run registered queries and their SQL side by side: `python tests/check.py <sf_dir> [name …]`."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

import __spark_entry__ as entry_module  # noqa: E402

SOURCES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in SOURCES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows with columns by name, comparable across engines, in a fixed order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(value):
        if isinstance(value, float):
            return "nan" if math.isnan(value) else value + 0.0
        if isinstance(value, pd.Timestamp):
            return value.to_pydatetime()
        return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value

    return sorted([tuple(plain(row[i]) for i in order) for row in rows], key=repr)


def compare(spark, connection, sf_dir: str, name: str) -> str:
    """Empty where both agree, else what differs."""
    frame = entry_module.queries()[name](spark, sf_dir)
    text = entry_module.oracle_sql()[name]
    result = connection.execute(text)
    names = [d[0] for d in result.description]
    expected = rows_of(names, result.fetchall())
    actual = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    if sorted(names) != sorted(frame.columns):
        return f"columns differ: {sorted(set(names) ^ set(frame.columns))}"
    if not expected:
        return "no rows"
    if actual == expected:
        return ""
    different = [(a, e) for a, e in zip(actual, expected) if a != e][:2]
    return f"{len(actual)} rows against {len(expected)}; first differences {different}"


if __name__ == "__main__":
    from conftest import session

    directory, *names = sys.argv[1:]
    spark, connection = session(), connect(directory)
    failures = 0
    for name in names or entry_module.queries():
        start = time.time()
        try:
            problem = compare(spark, connection, directory, name)
        except Exception as error:  # report and go on with the other queries
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failures += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{failures} failures")
