"""Stored tables: Parquet directories, seasonal ones partitioned by season."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from downfield.sources.ledger import Ledger, append_entry, compact_log, read_log, remove_folder, subfolders
from downfield.sources.tables import merged_schema

_SCHEMA_LOG = T.StructType(
    [
        T.StructField("table_name", T.StringType()),
        T.StructField("schema_json", T.StringType()),
        T.StructField("recorded_at", T.TimestampType()),
        T.StructField("location", T.StringType()),
    ]
)

_REJECTED = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("reason", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("rejected_at", T.TimestampType()),
    ]
)


def _newest_schemas(log: DataFrame) -> DataFrame:
    """The newest entry of each table."""
    newest = F.max(F.struct("recorded_at", "schema_json", "location")).alias("newest")
    return log.groupBy("table_name").agg(newest).select("table_name", "newest.*")


class Warehouse:
    """Tables below one root directory on any file system Spark can write to.

    The schema of every table is logged next to the data, so reading needs no look at file footers:
    files written before a column existed give NULL for it. The log also names the directory that holds a
    replaced table; a new version is written beside the old one and named only when it is complete.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.ledger = Ledger(spark, f"{self.root}/_ingest_metadata")
        self._schemas: dict[str, T.StructType] | None = None
        self._locations: dict[str, str] = {}
        self._lock = threading.Lock()  # tables are written from several threads

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def schemas(self) -> dict[str, T.StructType]:
        """Schema per stored table, read once per warehouse object; `refresh` reads it again."""
        with self._lock:
            if self._schemas is None:
                log = read_log(self.spark, self.path("_schemas"), _SCHEMA_LOG)
                newest = _newest_schemas(log).collect()
                self._locations = {r.table_name: r.location for r in newest if r.location}
                self._schemas = {r.table_name: T.StructType.fromJson(json.loads(r.schema_json)) for r in newest}
            return self._schemas

    def refresh(self) -> None:
        self._schemas = None

    def version(self) -> tuple:
        """The newest entries of the schema log and the ledger; another value means that tables have changed."""
        log = read_log(self.spark, self.path("_schemas"), _SCHEMA_LOG).select(F.col("recorded_at").alias("at"))
        both = log.unionByName(self.ledger.log().select(F.col("loaded_at").alias("at")))
        return tuple(both.agg(F.max("at"), F.count(F.lit(1))).first())

    def schema(self, table: str) -> T.StructType | None:
        return self.schemas().get(table)

    def tables(self) -> list[str]:
        return sorted(name for name in self.schemas() if not name.startswith("_"))

    def exists(self, table: str) -> bool:
        return self.schema(table) is not None

    def _record_schema(self, table: str, schema: T.StructType, location: str | None = None) -> None:
        known = self.schemas()
        row = (table, schema.json(), datetime.now(timezone.utc), location)
        append_entry(self.spark.createDataFrame([row], _SCHEMA_LOG), self.path("_schemas"))
        known[table] = schema
        if location:
            self._locations[table] = location

    def read(self, table: str) -> DataFrame:
        schema = self.schema(table)
        if schema is None:
            raise ValueError(f"Stored table {table!r} not found; stored are {', '.join(self.tables())}")
        return self.spark.read.schema(schema).parquet(self.path(self._locations.get(table, table))).select(
            *[f"`{n}`" for n in schema.names]
        )

    def of_seasons(self, rows: DataFrame, table: str) -> DataFrame:
        """The rows of the seasons that the ledger lists for a table; all rows where it lists none.

        The filter names the seasons, so other partitions of a stored table are not read.
        """
        listed = self.ledger.latest().where((F.col("table_name") == table) & F.col("season").isNotNull())
        seasons = sorted(r.season for r in listed.select("season").distinct().collect())
        return rows.where(F.col("season").isin(seasons)) if seasons else rows

    def replace(self, table: str, df: DataFrame, allow_empty: bool = True) -> int:
        """Write the table anew; returns its row count, which the write itself takes.

        Until the new version is complete the old one stays the table, so a write that fails changes nothing.
        Unless `allow_empty`, a version without rows is not taken either.
        """
        location, seen = f"{table}/version-{uuid.uuid4().hex}", Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(self.path(location))
        rows = seen.get["rows"]
        if rows or allow_empty:
            self._record_schema(table, df.schema, location)
        return rows

    def write_seasons(self, table: str, rows: DataFrame, sort_by: Sequence[str] = ()) -> None:
        """Write the seasons present in `rows`; other seasons stay, and repeating the write changes nothing.

        Rows are ordered inside each file by `sort_by`, which lets readers skip pages by their minimum and
        maximum. `extend_schema` makes new columns readable.
        """
        (
            rows.sortWithinPartitions("season", *sort_by)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("season")
            .parquet(self.path(table))
        )

    def extend_schema(self, table: str, schema: T.StructType) -> None:
        """Note the columns that `schema` has beyond the stored ones."""
        existing = self.schema(table)
        merged = merged_schema(existing, schema)
        if merged != existing:
            self._record_schema(table, merged)

    def tidy(self, grace: float = 3600) -> dict[str, int]:
        """Fold the logs and remove table versions that are no longer named; returns how many folders went.

        Only what is older than `grace` seconds is removed, so queries that started before keep their files, and a
        version that is being written keeps its place until it is named. Safe to repeat and to interrupt.
        """
        self.refresh()
        gone = {"ledger": self.ledger.compact(grace)}
        gone["schemas"] = compact_log(self.spark, self.path("_schemas"), _SCHEMA_LOG, _newest_schemas, grace)
        gone["versions"] = 0
        for table in self.schemas():
            named = self._locations.get(table)
            for name, changed in subfolders(self.spark, self.path(table)).items():
                unused = name.startswith("version-") and f"{table}/{name}" != named
                if unused and changed <= time.time() - grace:
                    remove_folder(self.spark, self.path(f"{table}/{name}"))
                    gone["versions"] += 1
        return gone

    def set_aside(self, dataset_id: str, season: int, rows: DataFrame, at: datetime) -> None:
        """Keep (reason, row) of source rows that a load at this time did not take."""
        marked = rows.select(
            F.lit(dataset_id).alias("dataset_id"), F.lit(season).alias("season"), "reason", "row",
            F.lit(at).alias("rejected_at"),
        )
        marked.write.parquet(f"{self.path('_rejected')}/entry={uuid.uuid4().hex}")

    def rejected(self) -> DataFrame:
        """(dataset_id, season, reason, row) that the latest load of each dataset and season set aside.

        A later load of the season, with rows or with rejects, supersedes the rejects of an earlier one.
        """
        rows = read_log(self.spark, self.path("_rejected"), _REJECTED)
        loads = self.ledger.log().select("dataset_id", "season", F.col("loaded_at").alias("at"))
        attempts = loads.unionByName(rows.select("dataset_id", "season", F.col("rejected_at").alias("at")))
        last = attempts.groupBy(F.col("dataset_id").alias("of_id"), F.col("season").alias("of_season")).agg(F.max("at").alias("at"))
        same = (F.col("dataset_id") == F.col("of_id")) & (F.col("season") == F.col("of_season")) & (F.col("rejected_at") == F.col("at"))
        return rows.join(last, same).select("dataset_id", "season", "reason", "row")
