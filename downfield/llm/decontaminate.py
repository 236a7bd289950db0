"""Benchmark decontamination with one Aho-Corasick automaton over word windows (operator 10).

The windows of all benchmark items form one automaton whose alphabet is the benchmark's words. A document is read
once: its words become numbers, the automaton reports every window that ends at a word, and places in the list of
words are carried back to character offsets of the text as it stands.

A benchmark whose windows exceed `block_words` words is cut into blocks of whole items, one automaton each;
documents are then read once per block and their hits are joined. So the driver and a task hold a
bounded automaton however large the benchmark is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, utf8, whole_row

# Fixed by the contract: A-Z are lowered; bytes outside 0-9, a-z and non-ASCII separate words.
_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")

HITS = (
    "doc_id long, text_hash long, n_words long, hits array<struct<first: int, last: int>>, items array<string>, "
    "spans array<struct<start: long, end: long>>"
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """Runs of `size` words; all words at once where there are fewer."""
    if len(words) < size:
        return [tuple(words)] if words else []
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


class WindowAutomaton:
    """Finds the windows of items in lists of words."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        from ahocorasick import KEY_SEQUENCE, STORE_ANY, Automaton

        owners: dict[tuple[bytes, ...], set[str]] = {}
        for name, text in items:
            for window in windows(words_of(text), size):
                owners.setdefault(window, set()).add(name)
        self.numbers: dict[bytes, int] = {}
        self.automaton = Automaton(STORE_ANY, KEY_SEQUENCE)
        for window, names in owners.items():
            key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in window)
            self.automaton.add_word(key, (len(window), names))
        self.any = bool(owners)
        if self.any:
            self.automaton.make_automaton()

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs (first, last) of word places inside windows, merged and in order; and the items found."""
        runs: list[tuple[int, int]] = []
        names: set[str] = set()
        if self.any and words:
            get = self.numbers.get
            for last, (length, owners) in self.automaton.iter(tuple([get(w, 0) for w in words])):
                first = last - length + 1
                while runs and runs[-1][1] >= first - 1:
                    first = min(first, runs.pop()[0])
                runs.append((first, last))
                names |= owners
        return runs, names


def _character_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets (start, end) in the text of runs of words."""
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out, at, characters = [], 0, 0
    for first, last in runs:
        start, end = places[first][0], places[last][1]
        characters += len(text[at:start].decode("utf-8", "replace"))
        length = len(text[start:end].decode("utf-8", "replace"))
        out.append((characters, characters + length))
        characters, at = characters + length, end
    return out


def _scan(documents: DataFrame, items: list[tuple[str, bytes]], size: int) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = WindowAutomaton(shared.value, size)
        for batch in batches:
            counts, hits, found, spans = [], [], [], []
            for value in batch.column(2):
                text = value.as_py()
                words = words_of(text)
                runs, names = automaton.find(words)
                counts.append(len(words))
                hits.append([{"first": a, "last": b} for a, b in runs])
                found.append(sorted(names))
                spans.append([{"start": a, "end": b} for a, b in _character_spans(text, runs)] if runs else [])
            place, span = pa.struct([("first", pa.int32()), ("last", pa.int32())]), pa.struct([("start", pa.int64()), ("end", pa.int64())])
            columns = [
                batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(hits, pa.list_(place)),
                pa.array(found, pa.list_(pa.string())), pa.array(spans, pa.list_(span)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_words", "hits", "items", "spans"])

    own = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), utf8("text").alias("bytes"))
    return own.mapInArrow(run, HITS)


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, bytes]]]:
    """The distinct items, in blocks of about `block_words` words."""
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), utf8("text").alias("bytes")
    ).where(F.length("bytes") > 0).distinct()
    # half the bytes bound the words, as every word but the last is followed by another byte
    total = items.agg(F.sum(F.length("bytes") / 2 + 1)).first()[0] or 0
    blocks = int(total // block_words) + 1
    if blocks == 1:
        yield [(r.item, bytes(r.bytes)) for r in items.collect()]
        return
    numbered = stored(items.withColumn("block", F.pmod(F.xxhash64("item", "bytes"), F.lit(2 * blocks))), "items")
    for block in range(2 * blocks):
        yield [(r.item, bytes(r.bytes)) for r in numbered.where(F.col("block") == block).collect()]


def find_overlaps(
    documents: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 4_000_000
) -> DataFrame:
    """(doc_id, text_hash, n_words, hits, items, spans) of every document.

    hits are the runs of word places inside an occurrence of a window, spans the same as character offsets of the
    text, items the ids of items with such windows, sorted as strings. An item of fewer words than a window is
    one window, one without words has none. Null texts have no words; an item without id has the id ''. Repeated
    items count once, repeated documents each give a row. An empty benchmark gives no hits.
    """
    parts = [_scan(documents, items, window) for items in _blocks(benchmark, block_words)]
    if len(parts) == 1:
        return parts[0]
    from functools import reduce

    numbered = [p.withColumn("block", F.lit(i)) for i, p in enumerate(parts)]
    together = reduce(DataFrame.unionByName, numbered).groupBy("doc_id", "text_hash").agg(
        F.max("n_words").alias("n_words"), F.count_if(F.col("block") == 0).alias("copies"),
        F.array_sort(F.flatten(F.collect_set("hits"))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans"),
    )
    return together.select(
        "doc_id", "text_hash", "n_words", _merged("hits", "first", "last", 1).alias("hits"), "items",
        _merged("spans", "start", "end", 0).alias("spans"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def _merged(runs: str, first: str, last: str, gap: int):
    """Sorted runs with those that overlap or touch made one."""
    kind = f"array<struct<{first}: {'int' if gap else 'long'}, {last}: {'int' if gap else 'long'}>>"

    def step(done, run):
        end = F.try_element_at(done, F.lit(-1))
        joined = F.struct(end[first].alias(first), F.greatest(end[last], run[last]).alias(last))
        touching = (F.size(done) > 0) & (run[first] <= F.try_element_at(done, F.lit(-1))[last] + gap)
        return F.when(
            touching, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined).cast(kind))
        ).otherwise(F.concat(done, F.array(run).cast(kind)))

    return F.aggregate(F.col(runs), F.array().cast(kind), step)


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of every document."""
    found = find_overlaps(documents, benchmark, window)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def remove_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without a hit, with all their columns."""
    hit = find_overlaps(documents, benchmark, window).where(F.size("hits") > 0)
    bad = hit.select("doc_id", "text_hash").distinct()
    rows = documents.select(
        whole_row(documents).alias("document"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")
    )
    clean = rows.join(bad, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("hash") == F.col("text_hash")), "left_anti")
    return clean.select(*[F.col(f"document.`{c}`").alias(c) for c in documents.columns])
