import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from downfield.llm.mixing import mixed_documents, mixture, per_row
from downfield.llm.queries import mixing


def brute_targets(sizes, weights, share, most):
    """Targets by dealing the excess again until no source is above its bound."""
    found, bounded, budget = {}, set(), share * sum(sizes.values())
    while True:
        left = budget - sum(most * sizes[s] for s in bounded)
        free = [s for s in sizes if s not in bounded]
        total = sum(weights[s] for s in free)
        found = {s: most * sizes[s] for s in bounded} | {s: left * weights[s] / total for s in free}
        above = {s for s in free if found[s] > most * sizes[s]}
        if not above:
            return found
        bounded |= above


def sizes_of(rows):
    return [len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows]


def test_sources_come_near_their_targets(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    sizes, mean = defaultdict(int), defaultdict(int)
    for r, n in zip(rows, sizes_of(rows)):
        sizes[r.source] += n
        mean[r.source] = max(mean[r.source], n)
    weights = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(sorted(sizes))}
    wanted = brute_targets(sizes, weights, 1.5, 2)
    found = mixing(spark, "/root/testdata/sf0.01").toPandas()
    assert len(found) == len(rows) and (found.taken <= 2 * found["size"]).all()
    of = {r.doc_id: r.source for r in rows}
    taken = found.groupby(found.doc_id.map(of)).agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    for source, row in taken.iterrows():
        assert row["size"] == sizes[source] and row.target == pytest.approx(wanted[source])
        assert abs(row.taken - row.target) < 0.03 * row.target
    again = mixing(spark, "/root/testdata/sf0.01").toPandas()
    assert sorted(again.itertuples(index=False)) == sorted(found.itertuples(index=False))


def test_odd_rows(spark, odd_documents):
    mix = mixture(odd_documents)
    found, rows = per_row(mix).collect(), odd_documents.collect()
    assert sorted((r.doc_id or -1, r.size) for r in found) == sorted((r.doc_id or -1, n) for r, n in zip(rows, sizes_of(rows)))
    assert all(r.copies <= 2 for r in found)
    assert sum(r.copies for r in found) == mixed_documents(odd_documents, mix).count()
    assert mixed_documents(odd_documents, mix).columns == odd_documents.columns
    null_source = [r for r in found if r.source is None]
    assert len(null_source) == 2 and sum(r.copies * r.size for r in null_source) <= 2 * null_source[0].source_size


def test_a_large_group_of_repeated_rows(spark):
    """Equal rows are told apart by number alone, so a sample takes just as many as the target wants."""
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit("s").alias("source"))
    other = spark.range(100).select("id", F.concat(F.lit("x y "), F.col("id").cast("string")).alias("text"), F.lit("t").alias("source"))
    frame = rows.unionAll(other.withColumnRenamed("id", "doc_id"))
    found = per_row(mixture(frame, weights=(4, 1), share=0.5)).groupBy("source").agg(
        F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")
    ).collect()
    assert {r.source: r.n for r in found} == {"s": 3000, "t": 100}
    assert all(abs(r.taken - r.target) <= 5 for r in found)


def test_inclusion_follows_the_odds(spark):
    """Over many sources of one size each document is in the sample with the chance its source has."""
    rows = spark.range(20000).select(
        F.col("id").alias("doc_id"), F.lit("one two").alias("text"), (F.col("id") % 4).cast("string").alias("source")
    )
    weights = spark.createDataFrame([("0", 1.0), ("1", 2.0), ("2", 3.0), ("3", 4.0)], "source string, weight double")
    found = per_row(mixture(rows, weights=weights, share=0.5)).groupBy("source", (F.col("doc_id") % 8 < 4).alias("half")).agg(
        F.avg("copies").alias("share")).collect()
    assert all(abs(r.share - (int(r.source) + 1) * 0.2) < 0.05 for r in found)


def test_no_documents(no_documents):
    assert per_row(mixture(no_documents)).collect() == []
