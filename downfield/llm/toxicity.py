"""Toxicity scores from subword vectors averaged into a linear softmax (operator 5).

A word is the bag of its character n-grams, hashed into `buckets` vectors. A text is the mean of the vectors of all
its n-grams, and a linear softmax over two classes reads that mean. Vectors and softmax are trained together
in numpy, on a bounded sample of the labelled documents. Misspelt and inflected words share n-grams with the words
they come from, so they share their vectors.

Scoring is linear up to the softmax: a word adds the same sum for every text, which each task keeps for the words it
has met.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import utf8, whole_row

_SPACED = re.compile(r"[^\w]+|_+")
KNOWN_WORDS = 400_000  # words a task remembers the sums of


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17
    width: int = 8
    shortest: int = 3
    longest: int = 6
    sample: int = 4000  # most labelled documents the model is trained on
    epochs: int = 8
    rate: float = 0.02
    batch: int = 128
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """weights[b]: what an n-gram of bucket b adds to the difference of the two classes; bias: of an empty bag."""

    weights: np.ndarray
    bias: float
    scale: float
    settings: Settings


def words_of(text: str) -> list[str]:
    return _SPACED.sub(" ", text.lower()).split()


def grams(word: str, s: Settings) -> list[int]:
    """Buckets of the word's n-grams, the word's ends marked."""
    marked = f"<{word}>"
    found = [zlib.crc32(marked.encode()) % s.buckets]
    for n in range(s.shortest, min(s.longest, len(marked) - 1) + 1):
        for i in range(len(marked) - n + 1):
            found.append(zlib.crc32(marked[i : i + n].encode()) % s.buckets)
    return found


def bag(text: str, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and the share of its n-grams in each."""
    counts: dict[str, int] = {}
    for word in words_of(text):
        counts[word] = counts.get(word, 0) + 1
    places, weights = [], []
    for word, n in counts.items():
        own = grams(word, s)
        places.extend(own)
        weights.extend([n] * len(own))
    if not places:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    found, at = np.unique(np.array(places, np.int64), return_inverse=True)
    share = np.bincount(at, np.array(weights, float), len(found))
    return found.astype(np.int32), (share / share.sum()).astype(np.float32)


class Bags:
    """Bags that are held compressed and unpacked one at a time."""

    def __init__(self, packed: list[bytes]):
        self.packed = packed

    @staticmethod
    def pack(places: np.ndarray, shares: np.ndarray) -> bytes:
        import zstandard

        steps = np.diff(places.astype(np.int32), prepend=np.int32(0))
        return zstandard.ZstdCompressor(level=3).compress(steps.tobytes() + shares.astype(np.float32).tobytes())

    def __len__(self) -> int:
        return len(self.packed)

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        import zstandard

        plain = zstandard.ZstdDecompressor().decompress(self.packed[i])
        half = len(plain) // 8
        return np.cumsum(np.frombuffer(plain, np.int32, half), dtype=np.int32), np.frombuffer(plain, np.float32, half, 4 * half)


def train(bags: Bags, labels: np.ndarray, s: Settings) -> Model:
    """Vectors and softmax by Adam on the cross entropy; without documents of both classes the base rate."""
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    if len(bags) == 0 or labels.min() == labels.max():
        return Model(np.zeros(s.buckets, np.float32), float(np.log(rate / (1 - rate))), 1.0, s)
    random = np.random.default_rng(s.seed)
    vectors = random.normal(0, 0.1, (s.buckets, s.width)).astype(np.float32)
    out = random.normal(0, 0.1, (s.width, 2)).astype(np.float32)
    bias = np.array([np.log(1 - rate), np.log(rate)], np.float32)
    # means of thousands of n-grams are small; one fixed factor brings them to the size of the weights
    scale = np.float32(50)
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in (("vectors", vectors), ("out", out), ("bias", bias))}
    step = 0

    def adam(name: str, value: np.ndarray, slope: np.ndarray, rows=slice(None)) -> None:
        first, second = moments[name]
        first[rows] = 0.9 * first[rows] + 0.1 * slope
        second[rows] = 0.99 * second[rows] + 0.01 * slope * slope
        value[rows] -= s.rate * (first[rows] / (1 - 0.9**step)) / (np.sqrt(second[rows] / (1 - 0.99**step)) + 1e-6)

    full = [i for i in range(len(bags)) if len(bags[i][0])]
    for _ in range(s.epochs):
        random.shuffle(full)
        for at in range(0, len(full), s.batch):
            own = full[at : at + s.batch]
            some = [bags[i] for i in own]
            sizes = np.array([len(p) for p, _ in some])
            places = np.concatenate([p for p, _ in some])
            shares = np.concatenate([w for _, w in some]) * scale
            doc = np.repeat(np.arange(len(own)), sizes)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            mean = np.add.reduceat(vectors[places] * shares[:, None], starts)
            logits = mean @ out + bias
            logits -= logits.max(axis=1, keepdims=True)
            chance = np.exp(logits)
            chance /= chance.sum(axis=1, keepdims=True)
            chance[np.arange(len(own)), labels[own]] -= 1
            slope = chance / len(own)
            step += 1
            inner = slope @ out.T
            used, where = np.unique(places, return_inverse=True)
            pulled = inner[doc] * shares[:, None]
            moved = np.stack([np.bincount(where, pulled[:, k], len(used)) for k in range(s.width)], axis=1)
            adam("out", out, mean.T @ slope)
            adam("bias", bias, slope.sum(axis=0))
            adam("vectors", vectors, moved.astype(np.float32), used)
    difference = out[:, 1] - out[:, 0]
    return Model((vectors @ difference).astype(np.float32), float(bias[1] - bias[0]), float(scale), s)


def score_bytes(text: bytes, model: Model, known: dict[str, tuple[float, int]]) -> float:
    """Probability of the toxic class; the bias alone decides for a text without words."""
    total, n = 0.0, 0
    s = model.settings
    for word in words_of(text.decode("utf-8", "replace")):
        added = known.get(word)
        if added is None:
            own = grams(word, s)
            added = (float(model.weights[own].sum()), len(own))
            if len(known) >= KNOWN_WORDS:
                known.clear()
            known[word] = added
        total += added[0]
        n += added[1]
    logit = model.bias + (model.scale * total / n if n else 0.0)
    return float(1 / (1 + np.exp(-np.clip(logit, -60, 60))))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text has remainder 2 by 4. No id: it is."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit(documents: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """A model from at most `settings.sample` labelled documents that are not held out.

    The sample is the labelled ids with the smallest hashes. Several labels of one document count as toxic if one
    is; labels without an id or a value are ignored. Whole texts are read; only hashed bags reach the driver.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out()).groupBy(
        F.col("doc_id").alias("_id")
    ).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(settings.sample)
    own = documents.select("doc_id", utf8("text").alias("bytes")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [Bags.pack(*bag(b.as_py().decode("utf-8", "replace"), settings)) for b in batch.column(1)]
            columns = [batch.column(0), batch.column(2), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "toxic", "bag"])

    rows = own.select("doc_id", "bytes", "_toxic").mapInArrow(run, "doc_id long, toxic int, bag binary")
    # repeated documents could exceed the sample; the smallest ids and bags of it are taken
    sample = rows.orderBy("doc_id", "bag").limit(settings.sample).toArrow()
    return train(Bags(sample.column("bag").to_pylist()), (sample.column("toxic").to_numpy() > 0).astype(np.int64), settings)


def scored(documents: DataFrame, model: Model, keep: Column) -> DataFrame:
    """(document, score): the column `keep` of every row with the toxicity of its whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model.weights)
    bias, scale, settings = model.bias, model.scale, model.settings
    rows = documents.select(keep.alias("document"), utf8("text").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = Model(shared.value, bias, scale, settings), {}
        for batch in batches:
            scores = [score_bytes(b.as_py(), model, known) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["document", "score"])

    return rows.mapInArrow(run, rows.select("document", F.lit(0.0).alias("score")).schema)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Null and empty texts and texts without words score the base rate. Repeated rows each give a row. Other
    columns of the documents are never read.
    """
    rows = scored(documents, fit(documents, labels, settings), F.col("doc_id"))
    return rows.select(
        F.col("document").alias("doc_id"), held_out("document").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def without_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """The documents, all columns kept, that score below the threshold."""
    rows = scored(documents, fit(documents, labels, settings), whole_row(documents)).where(F.col("score") < threshold)
    return rows.select(*[F.col(f"document.`{c}`").alias(c) for c in documents.columns])
