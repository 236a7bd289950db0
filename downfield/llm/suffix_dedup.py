"""Removal of repeated byte strings by distributed prefix doubling (operator 8).

A suffix array orders all positions by the text that follows them; to find strings of 100 bytes that occur twice it
is enough to rank positions by their next 100 bytes. The ranks are made by doubling, and a position is dropped as
soon as its rank is unique:

1. Positions are ranked by 32 bytes. Only those with the least hash among the 69 positions where a 32-byte string
   can start within some 100-byte string are ranked. Equal 100-byte strings choose equal positions in them, so none
   is missed, and one position in 35 remains. Unique ranks go.
2. Equal ranks are sorted by their whole surroundings, all 100-byte strings around the 32 bytes. Later positions with
   surroundings that occurred before are settled: everything around them is removed.
3. The first positions of the different surroundings of a rank are ranked on, by growing strings: the string covers
   what a range of 100-byte windows has in common, and each step halves the range. Unique ranks go, ranks
   whose windows are all equal are settled, and the others go on until a range is one window.

So a long repeated passage costs a few rows for each 100 bytes, and only the ends of passages take all steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, utf8

GRAM = 32
NO_ID = -(2**63)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of `size` bytes, from a rolling polynomial; none is 0."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.uint64)
    # the sum of byte * base^place over a string, carried back to place 0
    sums = np.concatenate([[np.uint64(0)], np.add.accumulate((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n))])
    found = (sums[size:] - sums[:-size]) * _powers(_INVERSE, n - size + 1)
    found ^= found >> np.uint64(29)
    found *= np.uint64(0xBF58476D1CE4E5B9)
    found ^= found >> np.uint64(32)
    return found | np.uint64(1)


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (minimum or maximum) of every run of `width` values."""
    span = 1
    while span * 2 <= width:
        values = pick(values[:-span], values[span:])
        span *= 2
    return pick(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def chosen_positions(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, position) of the 32-byte strings that are least within some string of `length` bytes."""
    joined = b"".join(texts)
    width = length - GRAM + 1
    empty = np.zeros(0, np.int64)
    if len(joined) < length:
        return np.zeros(0, np.uint64), empty, empty
    hashes = gram_hashes(np.frombuffer(joined, np.uint8), GRAM)
    sizes = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(sizes)
    least = _sliding(hashes, width, np.minimum)
    # strings that start in one text and end in another do not count
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(least)]
    least[np.arange(len(least)) + length > stops[owner]] = 0
    padding = np.zeros(width - 1, np.uint64)
    best = _sliding(np.concatenate([padding, least, padding]), width, np.maximum)
    places = np.flatnonzero(best[: len(hashes)] == hashes)
    number = np.searchsorted(stops, places, "right")
    return hashes[places], number, places - (stops - sizes)[number]


def _keyed(documents: DataFrame) -> DataFrame:
    """(doc_id, id, mark, bytes): documents are told apart by id and mark, a hash of the text; no id comes first."""
    return documents.select(
        "doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), utf8("text").alias("bytes"),
    )


def _portions(values: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    start, held, size = 0, [], 0
    for i, value in enumerate(values):
        held.append(value.as_py())
        size += len(held[-1])
        if size >= most_bytes:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def anchors(documents: DataFrame, length: int) -> DataFrame:
    """(rank, around, id, mark, place): chosen positions with hashes of their 32 bytes and of their surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        reach = length - GRAM
        for batch in batches:
            ids, marks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for first, texts in _portions(batch.column(2)):
                rank, number, place = chosen_positions(texts, length)
                around = np.fromiter(
                    (
                        xxh3_64_intdigest(texts[k][max(p - reach, 0) : p + length], min(p, reach))
                        for k, p in zip(number.tolist(), place.tolist())
                    ),
                    np.uint64, len(place),
                )
                columns = [
                    pa.array(rank.view(np.int64)), pa.array(around.view(np.int64)), pa.array(ids[first + number]),
                    pa.array(marks[first + number]), pa.array(place.astype(np.int32)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["rank", "around", "id", "mark", "place"])

    own = _keyed(documents).where(F.length("bytes") >= length).select("id", "mark", "bytes")
    return own.mapInArrow(run, "rank long, around long, id long, mark long, place int")


def repeated_anchors(documents: DataFrame, length: int) -> DataFrame:
    """Stored anchors whose rank is not unique; `first`: of their surroundings, `varied`: the rank has several.

    One shuffle by rank serves both sorts. Equal rows come from repeated documents and count as one.
    """
    rank = Window.partitionBy("rank")
    ordered = Window.partitionBy("rank", "around").orderBy("id", "mark", "place")
    counted = anchors(documents, length).select(
        "*", F.count(F.lit(1)).over(rank).alias("n"), (F.min("around").over(rank) < F.max("around").over(rank)).alias("varied")
    ).where("n > 1").drop("n")
    return stored(counted.withColumn("first", F.rank().over(ordered) == 1), "anchors")


def _packed(documents: DataFrame) -> DataFrame:
    """(doc_id, id, mark, packed): texts compressed, as they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            packed = pa.array([packer.compress(v.as_py()) for v in batch.column(3)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], packed], ["doc_id", "id", "mark", "packed"])

    return _keyed(documents).mapInArrow(run, "doc_id long, id long, mark long, packed binary")


def _surroundings(documents: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """(rank, id, mark, place, before, after) of first anchors: up to 68 bytes before, backwards, and 100 from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for id_, mark, packed, places in zip(*(c.to_pylist() for c in batch.columns)):
                text = unpacker.decompress(packed)
                for p in places:
                    at = p["place"]
                    rows.append((p["rank"], id_, mark, at, text[max(at - length + GRAM, 0) : at][::-1], text[at : at + length]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["rank", "id", "mark", "place", "before", "after"])

    by_text = firsts.groupBy("id", "mark").agg(F.collect_set(F.struct("rank", "place")).alias("places"))
    joined = _packed(documents).dropDuplicates(["id", "mark"]).join(by_text, ["id", "mark"])
    return joined.select("id", "mark", "packed", "places").mapInArrow(
        run, "rank long, id long, mark long, place int, before binary, after binary"
    )


def _settled(positions: DataFrame, length: int) -> DataFrame:
    """(id, mark, start, stop): bytes of windows that occurred earlier, by ranks of growing strings.

    A row stands for the windows that start lo to hi bytes before an anchor. `core` is what they share, `whole` all
    their bytes. All steps use one shuffle by the first rank, and sort within it.
    """
    last = length - GRAM
    rows = positions.repartition("rank").withColumns({"lo": F.lit(0), "hi": F.lit(last), "done": F.lit(False)})

    def part(column: str, size: Column) -> Column:
        return F.substring(F.col(column), F.lit(1), size)

    def state(lo: Column, hi: Column, done: bool) -> Column:
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(done).alias("done"))

    none = F.array().cast("array<struct<lo: int, hi: int, done: boolean>>")
    least, most = length - F.length("after"), F.length("before")
    spread = last
    while True:
        complete = ~F.col("done") & (F.col("hi") <= most) & (F.col("lo") >= least)
        core = F.when(~F.col("done"), F.concat(part("before", F.col("lo")), part("after", length - F.col("hi"))))
        rows = rows.withColumn("core", core)
        of_core = Window.partitionBy("rank", "done", "lo", "hi", "core")
        rows = rows.withColumn("met", F.count(F.lit(1)).over(of_core)).where("done OR met > 1")
        whole = F.when(complete, F.concat(part("before", F.col("hi")), part("after", length - F.col("lo"))))
        rows = rows.withColumn("whole", whole)
        of_whole = Window.partitionBy("rank", "done", "lo", "hi", "core", "whole")
        rows = rows.withColumns({
            "alike": F.count(F.lit(1)).over(of_whole),
            "turn": F.rank().over(of_whole.orderBy("id", "mark", "place")),
        })
        middle = ((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.filter(
            F.array(state(F.col("lo"), middle, False), state(middle + 1, F.col("hi"), False)),
            lambda s: (s["lo"] <= s["hi"]) & (s["lo"] <= most) & (s["hi"] >= least),
        )
        follow = (
            F.when(F.col("done"), F.array(state(F.col("lo"), F.col("hi"), True)))
            .when(complete & (F.col("turn") > 1), F.array(state(F.col("lo"), F.col("hi"), True)))
            .when(complete & (F.col("alike") == F.col("met")), none)
            .when(F.col("lo") == F.col("hi"), none)
            .otherwise(halves)
        )
        rows = rows.select("rank", "id", "mark", "place", "before", "after", F.explode(follow).alias("s")).select(
            "rank", "id", "mark", "place", F.when(~F.col("s.done"), F.col("before")).alias("before"),
            F.when(~F.col("s.done"), F.col("after")).alias("after"), "s.lo", "s.hi", "s.done",
        )
        if spread == 0:
            break
        spread //= 2
    return rows.where("done").select(
        "id", "mark", (F.col("place") - F.col("hi")).alias("start"), (F.col("place") - F.col("lo") + length).alias("stop")
    )


def merged(spans: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans, within 0 to size."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        start, stop = max(start, 0), min(stop, size)
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def without_repeats(documents: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]) of every document.

    Removed is each byte within a string of `length` bytes that also starts earlier: in a document of smaller
    doc_id, or earlier in the same one. Documents without id come first, and documents of one id are ordered by a
    hash of the text; rows equal in id and text are one document, and each gives the same row. Null texts are
    empty. Shorter texts stay whole.
    """
    found = repeated_anchors(documents, length)
    reach = length - GRAM
    later = found.where("NOT first").select(
        "id", "mark", (F.col("place") - reach).alias("start"), (F.col("place") + length).alias("stop")
    )
    positions = _surroundings(documents, found.where("first AND varied").select("id", "mark", "rank", "place"), length)
    spans = later.unionByName(_settled(positions, length)).groupBy("id", "mark").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for doc_id, packed, own in zip(*(c.to_pylist() for c in batch.columns)):
                text = unpacker.decompress(packed)
                cuts = merged([(s["start"], s["stop"]) for s in own or ()], len(text))
                edges = [0, *(x for cut in cuts for x in cut), len(text)]
                kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
                rows.append((
                    doc_id, len(text), len(text) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(),
                    [{"start": a, "stop": b} for a, b in cuts], kept if with_text else None,
                ))
            span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.binary()]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            columns = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names)

    joined = _packed(documents).join(spans, ["id", "mark"], "left").select("doc_id", "packed", "spans")
    out = joined.mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<start: long, stop: long>>, kept binary",
    )
    return out if with_text else out.drop("kept")
