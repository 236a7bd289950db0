"""Free-form read-only SQL over the registered views, with a row cap."""

from __future__ import annotations

import re
from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession

from downfield.operators.answers import Answer


def _each(sequence: JavaObject) -> Iterator[JavaObject]:
    for i in range(sequence.size()):
        yield sequence.apply(i)


def _name(node: JavaObject) -> str:
    return node.getClass().getSimpleName()


def _check_expression(expression: JavaObject) -> None:
    if _name(expression).startswith(("CallMethodViaReflection", "TryReflect")):
        raise PermissionError("The query calls code outside SQL")
    for child in _each(expression.children()):
        _check_expression(child)


def _check_plan(plan: JavaObject) -> None:
    """Refuses relations that are no registered view or table, and functions that call other code.

    What a view was made of is not looked at: whoever registered it chose its files.
    """
    name = _name(plan)
    if name == "View":
        return
    named = {"LogicalRelation": "catalogTable", "DataSourceV2Relation": "identifier", "HiveTableRelation": None}
    if name in named and named[name] and getattr(plan, named[name])().isEmpty():
        raise PermissionError("The query reads files that are no registered table")
    for expression in _each(plan.expressions()):
        _check_expression(expression)
    for child in [*_each(plan.children()), *_each(plan.subqueries())]:
        _check_plan(child)


def check_query(frame: DataFrame) -> None:
    """Looks through the analysed plan of a query; raises PermissionError where it reaches beyond the views."""
    _check_plan(frame._jdf.queryExecution().analyzed())


def capped_query(spark: SparkSession, sql: str, max_rows: int = 100) -> Answer:
    """Run one SELECT as a sub-query, where no command can stand, and cap its rows.

    The text has to parse as a query by itself, so a semicolon in a string does no harm and a second statement does
    not pass. Files and functions are refused by the analysed plan, in any session; see `check_query`.
    """
    text = sql.strip().rstrip("; \n\t")
    if not re.match(r"SELECT\b", text, re.IGNORECASE):
        raise ValueError("A question in SQL starts with SELECT")
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if _name(parsed) == "CompoundBody":
        raise ValueError("A question in SQL is a single statement")

    def limited(rows: int) -> DataFrame:
        found = spark.sql(f"SELECT * FROM (\n{text}\n) AS answer LIMIT {rows}")
        check_query(found)
        return found

    return Answer(limited, max_rows)
