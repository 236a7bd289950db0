"""Hard negatives by length buckets and sorted coordinate lists (operator 13).

Vectors of a label stand by falling length and are cut into buckets of bounded size. A search takes the anchors, a
block of bounded size at a time, to every bucket of fitting labels: lengths rule out the tail of a bucket or all of
it; an anchor's focus coordinates, its largest ones, give each a range of values outside which no vector can reach
the wanted score; the rows inside the ranges, found in the bucket's sorted coordinate lists, are then scored exactly.

Scores wanted come first from an anchor's own bucket (positives) and from a few buckets of the other labels
(negatives); they only rule out, so the results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .numbering import numbered

BUCKET = 2048  # vectors in a bucket
BLOCK_BYTES = 16 << 20  # anchors sent to the tasks at once
SEED_BUCKETS = 16  # buckets that give the first scores of negatives
FOCUS = 6
EXACT = 2.0**53

RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
FOUND = "anchor long, slot int, score long, vec_id long, row_key string"
_FOUND = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("vec_id", pa.int64()),
                    ("row_key", pa.string())])


def whole_vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, vector, length, dim) of the rows that take part, components times 256 rounded down.

    Left out: null ids, labels and vectors, vectors with a null or non-finite component. An id divisible by 7 has
    the next label of ten.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull())
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    square = F.aggregate("vector", F.lit(0.0), lambda sum_, x: sum_ + x.cast("double") * x.cast("double"))
    return rows.where(F.coalesce(finite, F.lit(False))).select(
        "vec_id", label.cast("long").alias("label"), vector.alias("vector")
    ).select("*", F.sqrt(square).alias("length"), F.size("vector").alias("dim"))


def bucketed(vectors: DataFrame) -> DataFrame:
    """The vectors with their bucket among those of their label and dimension, longest first, and a key of the row."""
    placed = numbered(vectors, ["label", "dim"], [-F.col("length"), F.col("vec_id"), F.col("vector")], "vector-order")
    key = F.concat_ws("-", "label", "dim", "position")
    return stored(
        placed.select("*", F.floor(F.col("position") / BUCKET).alias("bucket"), key.alias("row_key")).drop("total"), "buckets"
    )


class Bucket:
    """The vectors of a bucket with their sorted coordinate lists; lists are built when a search first needs them."""

    def __init__(self, table: pa.Table):
        vectors = table["vector"].combine_chunks()
        self.vectors = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
        order = np.argsort(-table["length"].to_numpy(), kind="stable")
        self.vectors = self.vectors[order]
        self.length = table["length"].to_numpy()[order]
        self.ids = table["vec_id"].to_numpy()[order]
        self.keys = table["row_key"].to_numpy(zero_copy_only=False)[order]
        self.unit = self.vectors / np.where(self.length > 0, self.length, 1)[:, None]
        self.largest = float(np.abs(self.vectors).max(initial=0))
        self.floats = self.vectors.astype(np.float64)
        self._lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _list(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        if coordinate not in self._lists:
            order = np.argsort(self.unit[:, coordinate])
            self._lists[coordinate] = self.unit[order, coordinate], order
        return self._lists[coordinate]

    def candidates(self, anchor: np.ndarray, length: float, wanted: float) -> np.ndarray:
        """Places of all vectors that may score `wanted` or more with the anchor."""
        everything = np.arange(len(self.length))
        if wanted <= 0 or length == 0 or not len(everything):
            return everything if wanted <= 0 else everything[:0]
        # rounding is far below this slack; scores are whole numbers
        cosine = wanted / (length * self.length[0] + 1e-300) - 1e-9
        if cosine > 1:
            return everything[:0]
        reach = np.searchsorted(-self.length, -(wanted / length) * (1 - 1e-9), side="right")
        width = math.acos(cosine)
        unit = anchor / length
        ranges = []
        for coordinate in np.argsort(-np.abs(unit))[:FOCUS]:
            angle = math.acos(min(1.0, max(-1.0, unit[coordinate])))
            low, high = math.cos(min(math.pi, angle + width)) - 1e-9, math.cos(max(0.0, angle - width)) + 1e-9
            values, order = self._list(coordinate)
            start, stop = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            ranges.append((stop - start, coordinate, low, high, order[start:stop]))
        ranges.sort(key=lambda r: r[0])
        found = ranges[0][4]
        found = found[found < reach]
        for _, coordinate, low, high, _ in ranges[1:]:
            values = self.unit[found, coordinate]
            found = found[(values >= low) & (values <= high)]
        return found

    def scores(self, places: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact integer inner products."""
        top = float(np.abs(anchor).max(initial=0))
        if self.vectors.shape[1] * top * self.largest < EXACT:
            exact = anchor.astype(np.float64)
            if 2 * len(places) > len(self.floats):
                return (self.floats @ exact)[places].astype(np.int64)
            return (self.floats[places] @ exact).astype(np.int64)
        rows = self.vectors[places].astype(object) @ anchor.astype(object)
        return np.array([int(s) for s in rows], dtype=np.int64)

    def best(self, places: np.ndarray, scores: np.ndarray, count: int) -> np.ndarray:
        """Indexes of the first `count`: higher scores, then smaller ids."""
        if len(scores) > count:
            kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
        else:
            kept = np.arange(len(scores))
        order = sorted(kept, key=lambda i: (-scores[i], self.ids[places[i]], self.keys[places[i]]))
        return np.array(order[:count], dtype=np.int64)


@dataclass
class Anchors:
    """A block of anchors: keys, labels, vectors of one dimension, and per slot the range of scores wanted."""

    number: np.ndarray
    keys: np.ndarray
    label: np.ndarray
    vectors: np.ndarray
    length: np.ndarray
    slots: list[list[tuple[int, int]]]  # least and largest score per slot


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, _FOUND.types)], schema=_FOUND)


def searched(bucket: Bucket, label: int, anchors: Anchors, same_label: bool, count: int) -> pa.Table:
    """The bucket's first `count` rows for every slot of the anchors that ask for its label."""
    rows = []
    for i in np.flatnonzero((anchors.label == label) == same_label):
        if not anchors.slots[i]:
            continue
        places = bucket.candidates(anchors.vectors[i], anchors.length[i], min(low for low, _ in anchors.slots[i]))
        if same_label:
            places = places[bucket.keys[places] != anchors.keys[i]]
        if not len(places):
            continue
        scores = bucket.scores(places, anchors.vectors[i])
        for slot, (low, high) in enumerate(anchors.slots[i]):
            inside = np.flatnonzero((scores >= low) & (scores <= high))
            for j in inside[bucket.best(places[inside], scores[inside], count)]:
                place = places[j]
                rows.append((int(anchors.number[i]), slot, int(scores[j]), int(bucket.ids[place]), bucket.keys[place]))
    return _table(rows)


LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def _own_bucket(count: int) -> Callable[[pa.Table], pa.Table]:
    """Per anchor of a bucket, its first rows of the same bucket."""

    def search(table: pa.Table) -> pa.Table:
        chosen = table.filter(pa.compute.is_valid(table["anchor"]))
        if not len(chosen):
            return _table([])
        anchors = _block(chosen, [[(LOWEST, HIGHEST)]] * len(chosen))
        return searched(Bucket(table), int(table["label"][0].as_py()), anchors, True, count)

    return search


def _block(table: pa.Table, slots: list[list[tuple[int, int]]]) -> Anchors:
    vectors = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1)
    columns = [table[c].to_numpy(zero_copy_only=False) for c in ("anchor", "row_key", "label")]
    return Anchors(columns[0].astype(np.int64), columns[1], columns[2], vectors, table["length"].to_numpy(), slots)


def _everywhere(buckets: DataFrame, blocks: Callable[[], Iterator[tuple[int, Anchors]]], same_label: bool, count: int) -> DataFrame | None:
    """What every bucket has for the anchors, block after block; rows are (anchor, slot, score, vec_id, row_key)."""
    def of_block(anchors: Anchors) -> Callable[[pa.Table], pa.Table]:
        return lambda table: searched(Bucket(table), int(table["label"][0].as_py()), anchors, same_label, count)

    found = None
    for dim, anchors in blocks():
        labels = F.col("label").isin(sorted({int(x) for x in anchors.label})) if same_label else F.lit(True)
        chosen = buckets.where((F.col("dim") == dim) & labels)
        rows = chosen.groupBy("label", "dim", "bucket").applyInArrow(of_block(anchors), FOUND)
        rows = stored(_first(rows, count), "searched")
        found = rows if found is None else found.unionByName(rows)
    return found


def _first(found: DataFrame, count: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id", "row_key")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= count)


def _blocks_of(anchors: DataFrame, slots: Callable[[dict], list[tuple[int, int]]]) -> Callable[[], Iterator[tuple[int, Anchors]]]:
    """The anchors block by block; a block has one dimension and a bounded number of bytes."""

    def blocks() -> Iterator[tuple[int, Anchors]]:
        for row in anchors.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy("dim").collect():
            size = max(1, BLOCK_BYTES // (8 * max(1, row["dim"])))
            here = anchors.where(F.col("dim") == row["dim"])
            for number in range(math.ceil(row["n"] / size)):
                table = here.where(F.floor(F.col("position") / size) == number).toArrow()
                if len(table):
                    yield row["dim"], _block(table, [slots(r) for r in table.drop_columns(["vector"]).to_pylist()])

    return blocks


def negatives_range(score: int, least: int, most: int) -> tuple[int, int] | None:
    """The whole scores s with least * score <= 100 s <= most * score, if there may be any."""
    low, high = -(-least * score // 100), most * score // 100
    return (low, high) if low <= high else None


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vectors` are rows (vec_id, label, vector, length, dim) of whole numbers. For each anchor, its first `positives`
    other rows of its label by inner product, ties by smaller id; for each of them, the first `negatives` rows of
    other labels whose score is `least` to `most` percent of the positive's. Rows meet rows of their dimension.
    Scores have to fit into 64 bits, else the search fails. Rows that repeat an id are rows like others, and as
    anchors bring a result each. An empty table gives no rows.
    """
    buckets = bucketed(vectors)
    # positions are dealt per dimension, so blocks of anchors are ranges of them
    listed = stored(numbered(buckets.where(is_anchor).drop("position"), ["dim"], [F.col("row_key")], "anchors").drop("total"), "anchors")
    anchors = listed.withColumn("anchor", F.col("dim").cast("long") * (1 << 40) + F.col("position"))
    marked = buckets.join(anchors.select(F.col("row_key").alias("of"), "anchor"), F.col("row_key") == F.col("of"), "left").drop("of")
    near = marked.groupBy("label", "dim", "bucket").applyInArrow(_own_bucket(positives), FOUND)
    # the last of a full list is a score that the wanted rows reach
    seeds = near.groupBy(F.col("anchor").alias("of")).agg(F.min("score").alias("seed"), F.count(F.lit(1)).alias("n"))
    seeded = stored(
        anchors.join(seeds, F.col("anchor") == F.col("of"), "left")
        .withColumn("seed", F.when(F.col("n") >= positives, F.col("seed"))).drop("of", "n"), "anchors",
    )
    first = _everywhere(
        buckets, _blocks_of(seeded, lambda r: [(LOWEST if r["seed"] is None else r["seed"], HIGHEST)]), True, positives
    )
    if first is None:
        return vectors.sparkSession.createDataFrame([], RESULT)
    chosen = stored(
        first.withColumnsRenamed({"score": "positive_score", "vec_id": "positive_id", "row_key": "positive_key"}).drop("slot", "place"),
        "positives",
    )
    lists = chosen.groupBy(F.col("anchor").alias("of")).agg(
        F.array_sort(F.collect_list(F.struct("positive_score", "positive_id", "positive_key"))).alias("positives")
    )
    asked = stored(anchors.join(lists, F.col("anchor") == F.col("of")).drop("of"), "asked")

    def ranges(row: dict) -> list[tuple[int, int]]:
        nothing = (HIGHEST, LOWEST)
        return [negatives_range(p["positive_score"], least, most) or nothing for p in row["positives"]]

    seeding = buckets.join(
        buckets.select("label", "dim", "bucket").distinct().orderBy("bucket", "label", "dim").limit(SEED_BUCKETS),
        ["label", "dim", "bucket"],
    )
    early = _everywhere(seeding, _blocks_of(asked, ranges), False, negatives)
    floors = early.groupBy("anchor", "slot").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n"))
    by_slot = floors.where(F.col("n") >= negatives).groupBy(F.col("anchor").alias("of")).agg(
        F.map_from_entries(F.collect_list(F.struct("slot", "floor"))).alias("floors")
    )
    raised = stored(asked.join(by_slot, F.col("anchor") == F.col("of"), "left").drop("of"), "asked")

    def narrowed(row: dict) -> list[tuple[int, int]]:
        known = dict(row["floors"] or [])
        return [(max(low, known.get(slot, low)), high) for slot, (low, high) in enumerate(ranges(row))]

    last = _everywhere(buckets, _blocks_of(raised, narrowed), False, negatives)
    pairs = asked.select("anchor", F.col("vec_id").alias("anchor_id"), F.posexplode("positives").alias("slot", "positive"))
    negative = last.select(F.col("anchor").alias("of"), F.col("slot").alias("of_slot"), "place", "score", "vec_id")
    return pairs.join(negative, (F.col("anchor") == F.col("of")) & (F.col("slot") == F.col("of_slot"))).select(
        "anchor_id", F.col("positive.positive_id").alias("positive_id"), F.col("place").alias("rank"),
        F.col("vec_id").alias("negative_id"), F.col("positive.positive_score").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def mined(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of `embeddings` (vec_id, embedding, label); anchors are the ids divisible by 100.

    Columns besides these take no part; see `whole_vectors` for rows that do not.
    """
    return hard_negatives(whole_vectors(embeddings), F.col("vec_id") % 100 == 0)
