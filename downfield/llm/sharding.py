"""Shards of bounded size by extendible hashing (operator 7).

Documents are addressed by the leading bits of a hash. A bucket that exceeds the byte limit is split on its next
bit; the others stay as they are, so each shard is the shortest hash prefix whose documents fit. Sizes are
added up for 8 more bits at a time, and only rows of buckets that are still too large go on to the next 8 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_path, stored, utf8

STEP = 8
HASH_BITS = 56
TASKS_PER_SHARD, MOST_TASKS = 3, 100_000  # that write
MOST_BITS = 2 * HASH_BITS  # the second half tells rows apart that agree in id and text


def _leading(depth: int | Column) -> Column:
    """The first `depth` bits of a row's address, as text of 0 and 1."""
    return F.substring(F.col("address"), F.lit(1), F.lit(depth) if isinstance(depth, int) else depth)


def _bits(value: Column) -> Column:
    """56 bits of a hexadecimal digest as text."""
    return F.lpad(F.conv(F.substring(value, 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0")


def addressed(documents: DataFrame) -> DataFrame:
    """(address, n_bytes, doc_id, text): the hash bits of id and text as text of 0 and 1."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    return documents.select(
        _bits(F.md5(key.cast("binary"))).alias("address"), F.octet_length(utf8("text")).cast("long").alias("n_bytes"),
        "doc_id", "text",
    )


def _told_apart(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The rows whose whole address is among the prefixes, stored with as many bits more for each row alone.

    These bits come from a row's place. They are stored with the row, so every later job sees the same ones, even if a
    lost task deals the input differently.
    """
    place = F.md5(F.monotonically_increasing_id().cast("string").cast("binary"))
    own = rows.join(prefixes, F.col("address") == F.col("prefix"), "left_semi")
    return stored(own.withColumn("address", F.concat("address", _bits(place))), "copies")


def directory(rows: DataFrame, byte_limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(prefix, shard, shard_bytes): for address prefixes of 8, 16 … bits the shard they belong to.

    A shard is empty text while one bucket holds all. Rows that agree in all bits of the hash and exceed the limit are
    given bits of their own and returned beside the directory, None if there are none. At the end of these a bucket
    stays as it is, so only a single document can exceed the limit.
    """
    done, copies, depth = None, None, 0
    open_ = stored(rows.select("address", "n_bytes"), "sizes")
    while True:
        fine = stored(
            open_.groupBy(_leading(depth + STEP).alias("prefix")).agg(F.sum("n_bytes").alias("bytes")), "directory"
        )
        last = depth + STEP >= MOST_BITS
        # no bucket above the current depth fits, but for the root
        levels = fine.select("prefix", "bytes", F.explode(F.sequence(F.lit(depth), F.lit(depth + STEP))).alias("depth"))
        levels = levels.withColumn("shard", F.substring("prefix", F.lit(1), F.col("depth")))
        totals = levels.groupBy("depth", "shard").agg(F.sum("bytes").alias("shard_bytes"))
        fits = F.col("shard_bytes") <= byte_limit
        if last:
            fits |= F.col("depth") == depth + STEP
        fitting = levels.join(totals.where(fits), ["depth", "shard"])
        leaves = fitting.groupBy("prefix").agg(F.min(F.struct("depth", "shard", "shard_bytes")).alias("leaf")).select(
            "prefix", F.col("leaf.shard").alias("shard"), F.col("leaf.shard_bytes").alias("shard_bytes")
        )
        found = stored(leaves, "directory")
        done = found if done is None else done.unionByName(found)
        large = fine.where(F.col("bytes") > byte_limit).select("prefix")
        if last or large.isEmpty():
            return done, copies
        depth += STEP
        if depth == HASH_BITS:
            copies = _told_apart(rows, large)
            open_ = copies.select("address", "n_bytes")
        else:
            open_ = open_.join(large, _leading(depth) == F.col("prefix"), "left_semi")


def assigned(rows: DataFrame, found: DataFrame, copies: DataFrame | None) -> DataFrame:
    """The rows with shard and shard_bytes: a row belongs to the entry with the prefix of its address."""
    depths = sorted(r["n"] for r in found.select(F.length("prefix").alias("n")).distinct().collect())
    out = None
    for depth in depths:
        own = found.where(F.length("prefix") == depth)
        of_depth = rows if depth <= HASH_BITS else copies
        part = of_depth.join(own, _leading(depth) == F.col("prefix")).drop("prefix")
        out = part if out is None else out.unionByName(part)
    return rows.withColumns({"shard": F.lit(""), "shard_bytes": F.lit(0)}).where("false") if out is None else out


def write_shards(documents: DataFrame, folder: str, byte_limit: int) -> DataFrame:
    """Writes every shard as one Parquet folder below `folder`; returns what was written.

    Columns: doc_id, text, n_bytes, shard_bytes, shard ('b' and the bits of its prefix); other columns are left out.
    """
    rows = addressed(documents)
    found, copies = directory(rows, byte_limit)
    placed = assigned(rows, found, copies).withColumn("shard", F.concat(F.lit("b"), "shard"))
    names = ["doc_id", "text", "n_bytes", "shard_bytes", "shard"]
    placed = placed.select(*names)
    # as many tasks as the directory has shards, and some more, so that few shards meet in one
    tasks = min(TASKS_PER_SHARD * max(found.select("shard").distinct().count(), 1), MOST_TASKS)
    placed.repartition(tasks, "shard").sortWithinPartitions("shard").write.partitionBy("shard").parquet(folder)
    return documents.sparkSession.read.schema(placed.schema).parquet(folder)


def shards(documents: DataFrame, byte_limit: int = 32 << 20) -> DataFrame:
    """(doc_id, n_bytes, shard, local_depth, shard_bytes, shard_docs) of every document, from the shards written.

    n_bytes is the text in UTF-8, 0 for null. A document over the limit is alone in its shard, or with empty ones.
    Rows equal in id and text are spread like others once their bucket is too large. An empty table gives no rows.
    """
    written = write_shards(documents, shared_path(documents.sparkSession, "shards"), byte_limit).drop("text")
    sums = written.groupBy("shard").agg(F.sum("n_bytes").alias("bytes_found"), F.count(F.lit(1)).alias("shard_docs"))
    return written.join(sums, "shard").select(
        "doc_id", "n_bytes", F.substring("shard", 2, 200).alias("shard"),
        (F.length("shard") - 1).cast("int").alias("local_depth"), F.col("bytes_found").alias("shard_bytes"), "shard_docs",
    )
