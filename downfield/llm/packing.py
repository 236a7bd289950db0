"""Packing token pieces into sequences by non-negative least squares on length patterns (operator 4).

Tokens are counted and cut into pieces by tasks. Only the histogram of piece lengths, bounded by the sequence
length, reaches the driver. There, patterns of up to three lengths that fill a sequence exactly are enumerated, and
non-negative repeat counts are fitted to the histogram by least squares. Counts are rounded; pieces that no
rounded pattern takes are packed best fit. All this works on lengths with counts, so its cost does not grow
with the number of documents. Pieces then learn their place from their rank among pieces of their length.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, utf8

END = 0  # fixed by the contract: the id after each document's own
KNOWN_WORDS = 500_000  # words a task remembers the ids of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, task int, slot long"

_STOP = re.compile(rb"([.,])(?=[ \n]|$)(?<=[a-z].)")  # the sign first: most places fail at once
_PIECE_WORD = re.compile(r"[^\W\d_]+")
_LATIN = rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"  # of a to z and the letters from U+00C0 to U+00FF
_LATIN_WORD = re.compile(_LATIN)
# no apostrophe, which may belong to the letters after it
_WORD_AND_SIGNS = re.compile(rb"(" + _LATIN + rb")([!-&(-/:-@\[-`{-~]+)")


def _words_only(path: str):
    """The file's tokenizer for lower-case Latin words between spaces, without the steps that leave these as they are."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer = Tokenizer.from_file(path)
    tokenizer.normalizer = normalizers.Sequence([])
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
        [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
    )
    return tokenizer


class WordTokenizer:
    """Token ids of whole texts, from the ids of their words.

    The tokenizer of the file must drop white space and never join what white space divides. Each distinct word is
    given to it once; texts with a special token's mark go to it whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.latin = _words_only(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _learn(self, words: list[bytes]) -> None:
        latin, plain, odd, signed = [], [], [], []
        for w in words:
            if _LATIN_WORD.fullmatch(w):
                latin.append(w)
            elif parts := _WORD_AND_SIGNS.fullmatch(w):
                signed.append((w, *parts.groups()))
            else:
                (plain if _PIECE_WORD.fullmatch(w.decode("utf-8", "replace")) else odd).append(w)
        odd += self._learn_joined(self.latin, latin) + self._learn_joined(self.tokenizer, plain)
        for w in odd:
            self.known[w] = self._whole(w.decode("utf-8", "replace"))
        if signed:
            self._learn([p for p in {p for _, *parts in signed for p in parts} if p not in self.known])
            for w, letters, signs in signed:
                self.known[w] = self.known[letters] + self.known[signs]

    def _learn_joined(self, tokenizer, words: list[bytes]) -> list[bytes]:
        """Gives the tokenizer many words at once; returns those it has to be given one by one."""
        odd = []
        for at in range(0, len(words), 2000):
            some = words[at : at + 2000]
            text = b" ".join(some).decode("utf-8", "replace")
            text = text.lower() if tokenizer is self.latin else text
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):  # a word fell into several parts
                odd.extend(some)
                continue
            data, start = ids.tobytes(), 0
            for w, stop in zip(some, (4 * stops).tolist()):
                self.known[w] = data[start:stop]
                start = stop
        return odd

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers."""
        split = [None if b"<|" in t else _STOP.sub(rb" \1", t.lower()).split() for t in texts]
        if len(self.known) > KNOWN_WORDS:
            self.known = {}
        missing = set().union(*(words for words in split if words))
        self._learn([w for w in missing if w not in self.known])
        take = self.known.__getitem__
        for text, words in zip(texts, split):
            yield self._whole(text.decode("utf-8", "replace")) if words is None else b"".join(map(take, words))


def encoder(path: str) -> WordTokenizer:
    """The tokenizer of a file, one for each Python process: tasks that follow in a worker go on with the words it knows.

    Tasks get this function by value, so what it keeps is with the interpreter and not in this module.
    """
    held = vars(sys).setdefault("_downfield_encoders", {})
    if path not in held:
        held[path] = WordTokenizer(path)
    return held[path]


def _portions(values: pa.Array, most_bytes: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of a few MB, with the place of the first."""
    start, held, size = 0, [], 0
    for i, value in enumerate(values):
        held.append(value.as_py())
        size += len(held[-1])
        if size >= most_bytes:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def pieces(documents: DataFrame, tokenizer: str, most_tokens: int, with_ids: bool = False) -> DataFrame:
    """Stored pieces of all documents. `slot` numbers the pieces of one length within a task.

    A text's ids are followed by id 0; only longer texts are cut. `tokenizer` is the path of a tokenizer file,
    the same on every machine.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        own_encoder, met = encoder(tokenizer), np.zeros(most_tokens + 1, np.int64)
        end = np.array([END], np.uint32).tobytes()
        for batch in batches:
            ids_of = batch.column(0)
            for first, texts in _portions(batch.column(1)):
                rows = []
                for i, ids in enumerate(own_encoder.encode(texts)):
                    ids += end
                    doc_id = ids_of[first + i].as_py()
                    for k, at in enumerate(range(0, len(ids), 4 * most_tokens)):
                        own = ids[at : at + 4 * most_tokens]
                        n = len(own) // 4
                        rows.append((doc_id, k, at // 4, n, zlib.crc32(own), own if with_ids else None, task, int(met[n])))
                        met[n] += 1
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
                names = [f.split()[0] for f in PIECES.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    own = documents.select("doc_id", utf8("text").alias("bytes"))
    return stored(own.mapInArrow(run, PIECES), "pieces")


def patterns(lengths: list[int], total: int) -> list[tuple[int, ...]]:
    """All patterns of one, two or three of the lengths that add up to the total, longest first."""
    have = set(lengths)
    out = [(total,)] if total in have else []
    for a in sorted(have, reverse=True):
        rest = total - a
        if rest <= 0:
            continue
        if rest <= a and rest in have:
            out.append((a, rest))
        out.extend((a, b, rest - b) for b in range(min(a, rest - 1), (rest + 1) // 2 - 1, -1) if b in have and rest - b in have)
    return out


def fit_counts(found: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 8) -> list[float]:
    """Repeat counts x >= 0 of the patterns that bring their lengths close to the histogram, in least squares.

    Coordinate descent from zero: the first patterns of a sweep take what they can, so few counts are positive.
    """
    left = [float(v) for v in histogram]
    x = [0.0] * len(found)
    # few patterns have a length twice; the others need no counts, which would take most of the driver's memory here
    twice = {i: {n: p.count(n) for n in p} for i, p in enumerate(found) if len(set(p)) < len(p)}
    for _ in range(sweeps):
        most = 0.0
        for i, p in enumerate(found):
            own = twice.get(i)
            if own is None:
                pull = sum([left[n] for n in p]) / len(p)
            else:
                pull = sum(m * left[n] for n, m in own.items()) / sum(m * m for m in own.values())
            move = max(pull, -x[i])
            if move > 1e-3 or move < -1e-3:
                x[i] += move
                most = max(most, abs(move))
                for n, m in own.items() if own else ((n, 1) for n in p):
                    left[n] -= m * move
        if most < 0.25:
            break
    return x


SHARES = (1.0, 0.75, 0.5, 0.25, 0.0)  # of the fitted counts


def plan(histogram: np.ndarray, total: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many sequences) that hold every piece of the histogram once.

    The fitted counts are rounded down and the pieces they leave go to best fit. Full patterns may take the short pieces
    that best fit needs beside long ones, so smaller shares of the counts are tried as well, down to best fit alone,
    and the plan with the fewest sequences is kept.
    """
    pieces_ = histogram.astype(np.int64)
    found = patterns([int(n) for n in np.flatnonzero(pieces_)], total)
    counts = fit_counts(found, pieces_)
    order = sorted((i for i, count in enumerate(counts) if count >= 1), key=lambda i: -counts[i])
    plans = []
    for share in SHARES:
        left, out = pieces_.copy(), []
        for i in order:
            own = found[i]
            n = min(int(counts[i] * share), *(int(left[m]) // own.count(m) for m in own))
            if n > 0:
                out.append((own, n))
                for m in own:
                    left[m] -= n
        plans.append(out + best_fit(left, total))
    return min(plans, key=lambda p: sum(n for _, n in p))


def best_fit(left: np.ndarray, total: int) -> list[tuple[tuple[int, ...], int]]:
    """Packs pieces, longest first, each into the fullest open sequence that has room; equal ones at once."""
    room: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    spaces = np.zeros(total + 1, np.int64)  # open sequences by room
    for length in range(total, 0, -1):
        n = int(left[length])
        while n:
            fits = np.flatnonzero(spaces[length:])
            if len(fits) == 0:
                fill = min(total // length, n)
                many = max(n // fill, 1)
                _open(room, spaces, total - fill * length, ((length,) * fill, many))
                n -= fill * many
                continue
            space = int(fits[0]) + length
            content, open_ = room[space].pop()
            # as many as fit go into each of these sequences, none of which another length could fill better
            fill = min(space // length, n)
            used = min(open_, n // fill)
            spaces[space] -= open_
            if open_ > used:
                _open(room, spaces, space, (content, open_ - used))
            _open(room, spaces, space - fill * length, (content + (length,) * fill, used))
            n -= fill * used
    return [x for group in room.values() for x in group]


def _open(room: dict, spaces: np.ndarray, space: int, group: tuple[tuple[int, ...], int]) -> None:
    room.setdefault(space, []).append(group)
    spaces[space] += group[1]


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: first ranks, first sequence ids and offsets of the runs of ranks that go to like places."""
    runs: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for content, n in planned:
        offset = 0
        for length in content:
            rank = taken.get(length, 0)
            runs.setdefault(length, []).append((rank, sequence, offset))
            taken[length] = rank + n
            offset += length
        sequence += n
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in runs.items()}


def pack(documents: DataFrame, tokenizer: str, most_tokens: int = 2048, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece of every document.

    A null or empty text is the one token that ends a document. Repeated rows and null ids are documents of their
    own. An empty table gives no rows. Other columns are ignored.
    """
    cut = pieces(documents, tokenizer, most_tokens, with_ids)
    counts = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = np.zeros(most_tokens + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        histogram[r["length"]] = r["n"]
    shared = documents.sparkSession.sparkContext.broadcast(slots(plan(histogram, most_tokens)))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = cut.join(bases, ["task", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "ids", (F.col("base") + F.col("slot")).alias("rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(6).to_numpy()
            sequence, offset = np.zeros(len(ranks), np.int64), np.zeros(len(ranks), np.int64)
            order = np.argsort(lengths, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(order) else []:
                first, base, at = places[int(lengths[some[0]])]
                run_ = np.searchsorted(first, ranks[some], "right") - 1
                sequence[some] = base[run_] + ranks[some] - first[run_]
                offset[some] = at[run_]
            columns = [*batch.columns[:5], pa.array(sequence), pa.array(offset), batch.column(5)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    placed = ranked.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary"
    )
    return placed if with_ids else placed.drop("ids")
