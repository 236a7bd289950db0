"""SimHash near-duplicate groups by a generalised pigeonhole search (operator 9).

A fingerprint has one bit per position that is set in over half of the hashes of a document's word shingles.
Two documents are linked if their fingerprints differ in few bits; groups are the connected documents.

The search divides the bits into partitions, each with a threshold of its own. If the thresholds plus one add up to
the radius plus one, two linked fingerprints are within the threshold in some partition. Bits that go together
over the corpus share a partition, and a dynamic programme gives each partition the threshold with which the
expected candidates and probes cost least. Bit counts come from all fingerprints.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import bucket_components, differing_bits
from .common import stored, utf8, whole_row
from .votes import signed

BITS = 64
SEED = 42
MOST_FLIPS = 2  # largest threshold of a partition; probes grow with its power


def shingle_fingerprint(text: bytes, words_per_shingle: int) -> int:
    """Signed 64-bit fingerprint of a text; zero without words."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    stops = ends[min(words_per_shingle, len(words)) - 1 :].tolist()
    counts, step = np.zeros(BITS, np.int64), 65536
    for at in range(0, len(stops), step):
        some = stops[at : at + step]
        hashes = np.fromiter(
            (xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[at : at + step], some)), np.uint64, len(some)
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(stops), bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, words_per_shingle: int = 3, keep: Column | None = None) -> DataFrame:
    """(document, fingerprint): each row of the input as a struct, or the column `keep`, with its fingerprint.

    A-Z are lowered, words are runs of other bytes than white space; a text of fewer words than a shingle is
    one shingle. A null, empty or blank text has fingerprint 0.
    """
    kept = whole_row(documents) if keep is None else keep
    rows = documents.select(kept.alias("document"), utf8("text").alias("bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [shingle_fingerprint(b.as_py(), words_per_shingle) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["document", "fingerprint"])

    return rows.mapInArrow(run, rows.select("document", F.lit(0).cast("long").alias("fingerprint")).schema)


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many of them bits i and j are both set (64 x 64)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, both = 0, np.zeros((BITS, BITS), np.int64)
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1, bitorder="little").astype(np.float32)
            total += len(bits)
            both += np.rint(bits.T @ bits).astype(np.int64)
        places = np.arange(-1, BITS * BITS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(places), pa.array(np.concatenate([[total], both.ravel()]))], ["place", "n"]
        )

    counted = prints.select("fingerprint").mapInArrow(run, "place long, n long")
    found = {r["place"]: r["n"] for r in counted.groupBy("place").agg(F.sum("n").alias("n")).collect()}
    both = np.array([found.get(i, 0) for i in range(BITS * BITS)], float).reshape(BITS, BITS)
    return found.get(-1, 0), both


def correlated_partitions(total: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """The bits in `parts` partitions of nearly equal width, strongly correlated ones together."""
    share = np.diag(both) / max(total, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    related = np.abs((both / max(total, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(related, 0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        start = max(sorted(free), key=lambda b: related[b, sorted(free)].sum())
        own = [start]
        free.remove(start)
        while len(own) < width:
            best = max(sorted(free), key=lambda b: related[b, own].mean())
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def _within(chance: np.ndarray, limit: int) -> float:
    """Probability that at most `limit` independent events of the given chances occur."""
    ways = np.zeros(limit + 2)
    ways[0] = 1
    for p in chance:
        ways[1:] = ways[1:] * (1 - p) + ways[:-1] * p
        ways[0] *= 1 - p
    return float(min(1, ways[: limit + 1].sum()))


def allocate(total: int, both: np.ndarray, radius: int, most_parts: int = 8) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, least costly in expected candidates plus probes; threshold -1 is left out."""
    share = np.diag(both) / max(total, 1)
    differ = 2 * share * (1 - share)
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for parts in range(1, min(most_parts, radius + 1) + 1):
        divided = correlated_partitions(total, both, parts)
        cost = {}  # of (partition, threshold)
        for i, bits in enumerate(divided):
            cost[i, -1] = 0.0
            for limit in range(min(radius, MOST_FLIPS) + 1):
                probes = total * sum(math.comb(len(bits), k) for k in range(limit + 1))
                cost[i, limit] = probes + total * total / 2 * _within(differ[bits], limit)
        # need[s]: least cost with thresholds plus one adding up to s
        need: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for i in range(parts):
            step: dict[int, tuple[float, list[int]]] = {}
            for got, (spent, chosen) in need.items():
                for limit in range(-1, min(radius, MOST_FLIPS) + 1):
                    to = min(got + limit + 1, radius + 1)
                    paid = spent + cost[i, limit]
                    if to not in step or paid < step[to][0]:
                        step[to] = (paid, [*chosen, limit])
            need = step
        if radius + 1 in need and need[radius + 1][0] < best[0]:
            best = (need[radius + 1][0], [(b, t) for b, t in zip(divided, need[radius + 1][1]) if t >= 0])
    if not best[1]:
        raise ValueError(f"no thresholds of at most {MOST_FLIPS} bits in eight partitions cover a radius of {radius} bits")
    return best[1]


def probes(nodes: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """(bucket, node, owner): every fingerprint in the bucket of its own bits, and in those within the threshold."""
    out = None
    for part, (bits, limit) in enumerate(plan):
        mask = signed(sum(1 << b for b in bits))
        flips = [signed(sum(1 << b for b in some)) for k in range(limit + 1) for some in combinations(bits, k)]
        value = F.col("node").bitwiseAND(F.lit(mask))
        rows = nodes.select("node", F.explode(F.array(*[F.lit(x) for x in flips])).alias("flip")).select(
            F.struct(F.lit(part).alias("part"), value.bitwiseXOR(F.col("flip")).alias("value")).alias("bucket"),
            "node", (F.col("flip") == 0).alias("owner"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def fingerprint_groups(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(fingerprint, component): every distinct fingerprint with the smallest one that chains of links reach."""
    nodes = stored(prints.select("fingerprint").distinct(), "prints")
    total, both = bit_counts(nodes)
    members = probes(nodes.select(F.col("fingerprint").alias("node")), allocate(total, both, radius)) if total else None
    if members is None:
        return nodes.select("fingerprint", F.col("fingerprint").alias("component"))
    found = bucket_components(members, lambda a, b: differing_bits(a, b) <= radius)
    return nodes.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", F.coalesce("component", "fingerprint").alias("component")
    )


def near_groups(documents: DataFrame, words_per_shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row; fingerprint as a signed 64-bit number.

    component_id is the smallest doc_id among the documents that links reach. Texts without words share
    fingerprint 0. Repeated rows each give a row. A null doc_id counts as no id: it is never a component_id
    unless no document of the group has one. An empty table gives no rows. Other columns are ignored.
    """
    found = fingerprints(documents, words_per_shingle, F.col("doc_id"))
    prints = stored(found.withColumnRenamed("document", "doc_id"), "prints")
    groups = fingerprint_groups(prints, radius)
    first = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    named = stored(groups.join(first, "fingerprint"), "groups")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_print = named.join(least, "component").select("fingerprint", "component_id")
    return prints.join(of_print, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_digits(fingerprint: str) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def _text_id(id_: str, text: str) -> Column:
    """Tells documents apart by id and text."""
    return F.struct(F.xxhash64(id_, text).alias("x"), F.xxhash64(F.lit(1), id_, text).alias("y"))


def without_near_duplicates(documents: DataFrame, words_per_shingle: int = 3, radius: int = 3) -> DataFrame:
    """The documents, all columns kept, of which one of every group of linked fingerprints remains.

    That is the one of the smallest doc_id, ids missing last, and of equal ids any, but the same in every run. A null
    text counts as empty, and texts without words share fingerprint 0. Of rows repeated in id and text one stays.
    An empty table gives no rows.
    """
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", _text_id("doc_id", "text").alias("text_id"))
    prints = stored(fingerprints(documents, words_per_shingle, place), "prints")
    groups = fingerprint_groups(prints, radius)
    least = prints.groupBy("fingerprint").agg(F.min("document").alias("first")).join(groups, "fingerprint")
    firsts = least.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.text_id").alias("text_id"))
    rows = documents.select(whole_row(documents).alias("document"), _text_id("doc_id", "text").alias("text_id"))
    kept = rows.join(firsts, "text_id").dropDuplicates(["text_id"])
    return kept.select(*[F.col(f"document.`{c}`").alias(c) for c in documents.columns])
