"""SimHash document fingerprints and their search by permuted block tables (operator 6).

Only column expressions, joins and windows are used. Terms are runs of five words; a term votes as often as it occurs.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .buckets import differing_bits
from .common import stored
from .votes import fingerprints, shingle_hashes, signed

BITS = 64


def _text_key(text: str):
    return F.struct(F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), F.col(text)).alias("y"))


def text_fingerprints(documents: DataFrame, words_per_term: int = 5) -> DataFrame:
    """(text_key, fingerprint) of every distinct text of the column `text`; null counts as empty."""
    rows = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", _text_key("text"))
    found = fingerprints(rows, ["text_key"], shingle_hashes(F.col("text"), words_per_term))
    return found.groupBy("text_key").agg(F.min("fingerprint").alias("fingerprint"))


def block_tables(radius: int, blocks: int) -> list[int]:
    """Masks of the tables: all choices of blocks - radius blocks, as differing bits spoil at most `radius` blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    return [signed(sum(some)) for some in combinations(masks, blocks - radius)]


def find_near(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """(query, fingerprint): all distinct fingerprints within `radius` bits of a distinct query fingerprint.

    Every table orders the bits so that its chosen blocks lead; equal leads meet and are verified.
    """
    masks = block_tables(radius, blocks)

    def in_tables(rows: DataFrame, name: str) -> DataFrame:
        own = rows.select(F.col("fingerprint").alias(name)).distinct()
        tables = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.lit(m).alias("mask")) for i, m in enumerate(masks)]))
        return own.select(name, tables.alias("t")).select(
            name, F.col("t.table").alias("table"), F.col(name).bitwiseAND(F.col("t.mask")).alias("lead")
        )

    met = in_tables(queries, "query").join(
        in_tables(prints, "fingerprint"), ["table", "lead"]
    ).where(differing_bits(F.col("query"), F.col("fingerprint")) <= radius)
    return met.select("query", "fingerprint").distinct()


def _in_ranges(rows: DataFrame, per_bucket: int) -> DataFrame:
    """The rows (doc_id, order, …) with `bucket`, a range number that grows with doc_id, then with order; no id is least.

    Ranges are cut at quantiles of the ids, so they hold about as many rows each however the ids are spread. An id that
    fills several ranges by itself, or rows without id, are cut by the hash `order`.
    """
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.count("doc_id").alias("with_id")).first()
    count = max(1, min(seen.n // per_bucket, 16 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    steps = [k / count for k in range(1, count)]
    points = steps and rows.agg(F.percentile_approx("doc_id", steps, max(10_000, 10 * count))).first()[0] or []
    splits = sorted({float(p) for p in points})
    heavy: dict[int, tuple[int, int]] = {}  # cell -> its id that has several points, and how many
    for id_, times in sorted(Counter(points).items()):
        if times > 1:
            heavy.setdefault(splits.index(float(id_)) + 1, (id_, times))
    span = count + 3

    def part(parts: Column) -> Column:
        share = F.col("order").cast("double") / float(1 << 64) + 0.5
        return F.least(F.floor(share * parts), parts - 1).cast("long")

    sub = F.lit(0)
    if heavy:
        ids = F.element_at(F.create_map(*[F.lit(x) for c, (id_, _) in heavy.items() for x in (c, id_)]), F.col("cell"))
        times = F.element_at(F.create_map(*[F.lit(x) for c, (_, k) in heavy.items() for x in (c, k)]), F.col("cell"))
        sub = F.when(F.col("doc_id") > ids, count + 2).when(F.col("doc_id") == ids, part(times) + 1).otherwise(0)
    cells = Bucketizer(splits=[-math.inf, *splits, math.inf], inputCol="id_number", outputCol="cell")
    placed = (
        cells.transform(rows.withColumn("id_number", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))))
        if splits else rows.withColumns({"id_number": F.lit(0.0), "cell": F.lit(0.0)})
    ).withColumn("cell", F.col("cell").cast("int"))
    without = F.lit(max(1, count * (seen.n - seen.with_id) // max(seen.n, 1)))
    bucket = F.when(F.col("doc_id").isNull(), part(without) - span).otherwise(F.col("cell").cast("long") * span + sub)
    return placed.withColumn("bucket", bucket).drop("id_number", "cell")


def with_next(documents: DataFrame, per_bucket: int = 512) -> DataFrame:
    """(doc_id, text, next_text): each document with the text of the next one by descending doc_id.

    The first follows the last. Documents without id come last; equal ids are ordered by a hash of the text. Ids are
    cut into ranges, each ordered by itself; the first document of a range also stands at the end of the range
    before. Ranges are at most some 16 times the shuffle partitions, and so are the documents that stand twice. Rows
    equal in id and text are in one range.
    """
    own = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    placed = _in_ranges(own.withColumn("order", F.xxhash64("text")), per_bucket)
    firsts = placed.groupBy("bucket").agg(F.max(F.struct("doc_id", "order")).alias("first"))
    downward = Window.orderBy(F.desc("bucket"))  # over one row per range
    moves = firsts.select(
        F.col("first.doc_id").alias("first_id"), F.col("first.order").alias("first_order"),
        F.col("bucket").alias("first_bucket"),
        F.coalesce(F.lag("bucket").over(downward), F.min("bucket").over(Window.partitionBy())).alias("to"),
    )
    extra = placed.join(
        F.broadcast(moves),
        F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("order") == F.col("first_order"))
        & (F.col("bucket") == F.col("first_bucket")),
    ).select("doc_id", "text", F.col("to").alias("bucket"), "order", F.lit(1).alias("again"))
    along = Window.partitionBy("bucket").orderBy("again", F.desc_nulls_last("doc_id"), F.desc("order"))
    both = placed.select("doc_id", "text", "bucket", "order", F.lit(0).alias("again")).unionByName(extra)
    return both.withColumn("next_text", F.lead("text").over(along)).where("again = 0").select("doc_id", "text", "next_text")


def edited_fingerprints(documents: DataFrame, words_per_term: int = 5, radius: int = 3, query_every: int = 100) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_near) of every row.

    The edited text has its last third replaced by the first as many characters of the next document. Likeness is
    the share of equal bits. n_near counts the documents, itself included, within `radius` bits of those
    whose id is divisible by `query_every`, and is null for others. Texts without words have fingerprint 0; a
    single document follows itself. Repeated rows each give a row. Fingerprints are signed 64-bit numbers.
    """
    third = F.floor(F.length("text") / 3).cast("int")
    pairs = with_next(documents).select(
        "doc_id", _text_key("text").alias("text_key"), _text_key("next_text").alias("next_key"),
        F.length("text").cast("long").alias("n_chars"),
        F.concat(
            F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third)
        ).alias("edited"),
    )
    edited = pairs.select(
        "doc_id", "text_key", "next_key", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "edited",
    )
    changed = fingerprints(
        edited, [c for c in edited.columns if c != "edited"], shingle_hashes(F.col("edited"), words_per_term)
    ).withColumnRenamed("fingerprint", "edited_fingerprint")
    prints = stored(text_fingerprints(documents, words_per_term), "prints")
    following = prints.select(F.col("text_key").alias("next_key"), F.col("fingerprint").alias("next_fingerprint"))
    rows = stored(changed.join(prints, "text_key").join(following, "next_key"), "fingerprints")
    asked = F.col("doc_id") % query_every == 0
    copies = rows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("copies"))
    near = find_near(rows.where(asked), copies, radius).join(copies, "fingerprint")
    counts = near.groupBy(F.col("query").alias("fingerprint")).agg(F.sum("copies").alias("n_near"))

    def likeness(other: str):
        return 1 - differing_bits(F.col("fingerprint"), F.col(other)) / BITS

    return rows.join(counts, "fingerprint", "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("edited_fingerprint").alias("near_edited"), likeness("next_fingerprint").alias("near_next"),
        F.when(asked, F.col("n_near")).alias("n_near"),
    )

