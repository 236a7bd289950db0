"""The log of finished loads."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("dataset_id", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("season", T.IntegerType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("loaded_at", T.TimestampType()),
        T.StructField("loader_fn", T.StringType()),
    ]
)


def latest_loads(log: DataFrame) -> DataFrame:
    """The newest entry per dataset and season (season is NULL for datasets without seasons)."""
    newest = F.max(F.struct("loaded_at", "row_count", "table_name", "loader_fn")).alias("newest")
    return (
        log.groupBy("dataset_id", "season")
        .agg(newest)
        .select("dataset_id", "newest.table_name", "season", "newest.row_count", "newest.loaded_at", "newest.loader_fn")
    )


def pending_seasons(requested: DataFrame, log: DataFrame) -> DataFrame:
    """The requested (dataset_id, season) pairs without a finished load; NULL seasons match each other."""
    done = log.select(F.col("dataset_id").alias("done_id"), F.col("season").alias("done_season")).distinct()
    finished = (F.col("dataset_id") == F.col("done_id")) & F.col("season").eqNullSafe(F.col("done_season"))
    return requested.join(done, finished, "left_anti")


def append_entry(rows: DataFrame, path: str) -> None:
    """Add rows to a log. Every entry has a directory of its own, so entries can be written at the same time."""
    rows.coalesce(1).write.parquet(f"{path}/entry={uuid.uuid4().hex}")


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All entries of a log; none if there is no log yet."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.names)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _folder(spark: SparkSession, path: str):
    """The file system of a path, and the path, as Hadoop knows them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def subfolders(spark: SparkSession, path: str) -> dict[str, float]:
    """Names below a folder with the time of their last change in seconds; none if there is no folder."""
    files, place = _folder(spark, path)
    if not files.exists(place):
        return {}
    return {s.getPath().getName(): s.getModificationTime() / 1000 for s in files.listStatus(place)}


def remove_folder(spark: SparkSession, path: str) -> None:
    files, place = _folder(spark, path)
    files.delete(place, True)


def compact_log(
    spark: SparkSession, path: str, schema: T.StructType, fold: Callable[[DataFrame], DataFrame], grace: float
) -> int:
    """Write what the entries of a log amount to as one new entry; returns how many older ones were removed.

    `fold` keeps the rows that count, so an old entry beside the new one changes nothing. Entries are removed once
    they are older than `grace` seconds, which leaves a reader that has just listed them its files; younger
    ones go with the next compaction. Entries written meanwhile are not touched.
    """
    found = subfolders(spark, path)
    names = sorted(name for name in found if name.startswith("entry="))
    old = [name for name in names if found[name] <= time.time() - grace]
    if len(names) < 2 or not old:
        return 0
    rows = spark.read.schema(schema).parquet(*[f"{path}/{name}" for name in names]).select(*schema.names)
    append_entry(fold(rows).select(*schema.names), path)
    for name in old:
        remove_folder(spark, f"{path}/{name}")
    return len(old)


class Ledger:
    """An append-only Parquet log of loads; a later entry for the same key replaces the earlier one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path

    def log(self) -> DataFrame:
        return read_log(self.spark, self.path, LEDGER_SCHEMA)

    def latest(self) -> DataFrame:
        return latest_loads(self.log())

    def record(
        self, dataset_id: str, table: str, loader: str, rows: dict[int | None, int], at: datetime | None = None
    ) -> None:
        """Note the row count per loaded season (None for a dataset without seasons)."""
        now = at or datetime.now(timezone.utc)
        entries = [(dataset_id, table, season, count, now, loader) for season, count in rows.items()]
        append_entry(self.spark.createDataFrame(entries, LEDGER_SCHEMA), self.path)

    def compact(self, grace: float = 3600) -> int:
        """Fold the log into one entry with the newest row per dataset and season; see `compact_log`."""
        return compact_log(self.spark, self.path, LEDGER_SCHEMA, latest_loads, grace)

    def pending(self, requested: dict[str, list[int | None]]) -> dict[str, list[int | None]]:
        """The seasons still to be loaded per dataset, in the given order."""
        pairs = [(dataset_id, season) for dataset_id, seasons in requested.items() for season in seasons]
        wanted = self.spark.createDataFrame(pairs, "dataset_id string, season int")
        missing = {(row.dataset_id, row.season) for row in pending_seasons(wanted, self.log()).collect()}
        return {d: [s for s in seasons if (d, s) in missing] for d, seasons in requested.items()}

    def is_loaded(self, dataset_id: str, season: int | None = None) -> bool:
        return not self.pending({dataset_id: [season]})[dataset_id]
