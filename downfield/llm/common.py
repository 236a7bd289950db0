"""Stored intermediate tables and text columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: `spark.checkpoint.dir`, else the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_shared"
    if base.startswith("file:/") and not base.startswith("file://"):
        base = f"file://{base[5:]}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(frame: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The frame written as Parquet to the shared folder and read again; later jobs do not depend on its shuffles.

    The files of those shuffles are removed once it is written, and not when the driver collects its garbage.
    """
    spark = frame.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(frame.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Deletes the files of stored frames. Only for frames that no later job reads, also not to repeat a lost task."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        for folder in {file.rsplit("/", 1)[0] for file in frame.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str | Column) -> Column:
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def whole_row(frame: DataFrame) -> Column:
    """All columns of a row as one struct, so that columns an operator adds clash with none of them."""
    return F.struct(*[F.col(f"`{c}`") for c in frame.columns])
