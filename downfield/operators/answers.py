"""Limited answers that know whether they were cut."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from downfield.functions.filters import row_limit


class Answer:
    """The first rows of a question, at most `limit`, and whether there are more.

    One run of the question with a limit one higher gives both; it starts when either is first asked for, and at
    most `limit` + 1 rows come to the driver. `flagged` leaves everything to Spark.
    """

    def __init__(self, question: Callable[[int], DataFrame], limit: int):
        self.limit = row_limit(limit)
        if self.limit is None:
            raise ValueError("An answer needs a limit; the operators themselves give all rows")
        self._probe = question(self.limit + 1)
        self.schema = self._probe.schema

    @cached_property
    def _found(self) -> list[Row]:
        return self._probe.collect()

    @cached_property
    def rows(self) -> DataFrame:
        return self._probe.sparkSession.createDataFrame(self.collect(), self.schema)

    def collect(self) -> list[Row]:
        return self._found[: self.limit]

    def truncated(self) -> bool:
        return len(self._found) > self.limit

    def row_count(self) -> int:
        return len(self.collect())

    def to_dict(self) -> dict:
        return {"rows": [r.asDict() for r in self.collect()], "row_count": self.row_count(), "truncated": self.truncated()}

    def show(self, n: int = 20, truncate: bool | int = True) -> None:
        self.rows.show(n, truncate)
        if self.truncated():
            print(f"only the first {self.limit} rows")

    def flagged(self) -> DataFrame:
        """The rows with a column `truncated`, as one lazy query; an answer without rows has no flag."""
        every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        place = F.row_number().over(Window.orderBy(F.monotonically_increasing_id()))
        # the window holds the limited rows only, which are in one task by then
        marked = self._probe.withColumns({"truncated": F.count(F.lit(1)).over(every) > self.limit, "_place": place})
        return marked.where(F.col("_place") <= self.limit).drop("_place")
