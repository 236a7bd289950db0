"""Data selection by importance resampling with hashed n-gram models (operator 3).

Two models of hashed uni- and bigrams are counted: one of the raw corpus, from all documents, and one of the target,
from documents labelled good. A document's weight is the logarithm of its probability under the target model over
that under the raw model. Adding Gumbel noise to the weights and taking the largest draws without replacement with
probabilities in proportion to the weights.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, utf8

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]")
SCORES = "doc_id long, log_weight double, noise double, key double, place long"


def hashed_ngrams(text: bytes, buckets: int) -> np.ndarray:
    """Buckets of all words and pairs of neighbouring words; punctuation marks are words."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.int64)
    own = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    pairs = own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    pairs ^= pairs >> np.uint64(29)
    return np.concatenate([own % np.uint64(buckets), pairs % np.uint64(buckets)]).astype(np.int64)


def count_ngrams(documents: DataFrame, target_ids: list[int], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram counts by bucket of the documents with the target ids, and of all documents."""
    shared = documents.sparkSession.sparkContext.broadcast(frozenset(target_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for i, value in enumerate(batch.column(1)):
                own = np.bincount(hashed_ngrams(value.as_py(), buckets), minlength=buckets)
                counts[1] += own
                if batch.column(0)[i].as_py() in shared.value:
                    counts[0] += own
        rows = [pa.array(np.arange(buckets)), pa.array(counts[0]), pa.array(counts[1])]
        yield pa.RecordBatch.from_arrays(rows, ["bucket", "target", "raw"])

    own = documents.select("doc_id", utf8("text").alias("bytes"))
    summed = own.mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(
        F.sum("target").alias("target"), F.sum("raw").alias("raw")
    )
    target, raw = np.zeros(buckets), np.zeros(buckets)
    for r in summed.collect():  # as many rows as there are buckets
        target[r.bucket], raw[r.bucket] = r.target, r.raw
    return target, raw


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Logarithm of target over raw probability per bucket, every bucket counted once more."""
    return np.log((target + 1) / (target.sum() + len(target))) - np.log((raw + 1) / (raw.sum() + len(raw)))


def scored(documents: DataFrame, ratio: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, log_weight, noise, key, place) of every document; place orders keys as whole numbers."""
    shared = documents.sparkSession.sparkContext.broadcast(ratio)
    own = documents.select(
        "doc_id", utf8("text").alias("bytes"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("draw")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            weight = np.array([ratio[hashed_ngrams(b.as_py(), len(ratio))].sum() for b in batch.column(1)], float)
            share = ((batch.column(2).to_numpy().view(np.uint64) >> np.uint64(12)).astype(float) + 0.5) / 2.0**52
            noise = -np.log(-np.log(share))
            key = weight + noise + 0.0
            place = key.view(np.int64)
            place = np.where(place < 0, np.int64(-(2**63)) - place - 1, place)
            columns = [batch.column(0), *(pa.array(c) for c in (weight, noise, key, place))]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SCORES.split(", ")])

    return own.mapInArrow(run, SCORES)


def cutoff(places: DataFrame, count: int) -> int | None:
    """The place of rank `count` from the top, found 16 bits at a time from counts of at most 65,536 values."""
    high, rest = None, count
    for shift in (48, 32, 16, 0):
        part = F.shiftright("place", shift)
        own = places if high is None else places.where(F.shiftright("place", shift + 16) == high)
        found = sorted(((r.part, r.n) for r in own.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
        for value, n in found:
            high = value
            if rest <= n:
                break
            rest -= n
    return high


def resample(
    documents: DataFrame, labels: DataFrame, fraction: float = 0.8, buckets: int = 10_000, target_sample: int = 20_000,
    seed: int = 17,
) -> DataFrame:
    """(doc_id, log_weight, noise, key): the given share of the documents, drawn by Gumbel top-k.

    The target model is counted from at most `target_sample` documents labelled good, those with the smallest id
    hashes; the raw model from all documents. Noise depends on seed, id and text, so repeated rows share a key; rows
    tied with the last one drawn are all kept. A text without words has weight 0. Without good labels all weights
    follow smoothing alone. An empty table gives no rows.
    """
    good = labels.where((F.col("quality") > 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    ids = [r.doc_id for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(target_sample).collect()]
    ratio = log_ratio(*count_ngrams(documents, ids, buckets))
    scores = stored(scored(documents, ratio, seed), "scores")
    total = scores.count()
    if total == 0:
        return scores.drop("place")
    least = cutoff(scores.select("place"), max(1, math.ceil(fraction * total)))
    return scores.where(F.col("place") >= least).drop("place")
