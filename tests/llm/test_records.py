"""WARC bundles, packing, sharding: exact round trips."""

import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from check import connect, rows_of
from pyspark import cloudpickle
from pyspark.sql import functions as F

from downfield.llm import packing, sharding, warc
from downfield.llm.common import shared_path
from downfield.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    frame = QUERIES[name](spark, SF)
    result = connect(SF).execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(names, result.fetchall())


PAGES = "page_id long, url string, html string, payload string, bundle string"


def test_warc_round_trip_and_random_access(spark):
    big = "é" * 700
    rows = [
        (1, "http://a/\r\nX: y?q=1%20", big), (2, None, big), (3, "http://c/ü", big), (3, "http://c/ü", big),
        (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"), (None, "u", big), (8, "u", "\r\n\r\nWARC/1.1\r\n"),
    ]
    pages = spark.createDataFrame([(*r, "p", "b") for r in rows], PAGES)
    index = warc.write_bundles(pages, shared_path(spark, "warc"), frame_bytes=2000, bundle_bytes=3000)
    found = warc.read_bundles(index).collect()
    assert Counter((r.page_id, r.url, bytes(r.payload).decode()) for r in found if r.record_type == "response") == Counter(
        (i, u, h or "") for i, u, h in rows if h != big or i == 3
    ) - Counter({(4, "u", ""): 0})
    revisits = {(r.page_id, r.refers_to, r.payload_bytes) for r in found if r.record_type == "revisit"}
    assert revisits == {(1, 3, 1400), (2, 3, 1400), (None, 3, 1400)}
    assert index.count() == len(rows)
    wanted = spark.createDataFrame([(6,), (8,), (99,), (None,)], "page_id long")
    assert {(r.page_id, bytes(r.payload).decode()) for r in warc.fetch(index, wanted).collect()} == {
        (6, "small"), (8, "\r\n\r\nWARC/1.1\r\n")
    }


def test_warc_without_ids_and_empty(spark):
    pages = spark.createDataFrame([(None, "u", "x" * 2000, "", "")] * 2, PAGES)
    assert [r.record_type for r in warc.round_trip(spark, pages).collect()] == ["response"] * 2
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_bundle_is_plain_zstandard(spark):
    import zstandard
    from pyarrow import fs

    pages = spark.createDataFrame([(i, "u", f"page {i}", "", "") for i in range(50)], PAGES).coalesce(1)
    index = warc.write_bundles(pages, shared_path(spark, "warc"), frame_bytes=500)
    (bundle,) = [r.bundle for r in index.select("bundle").distinct().collect()]
    store, path = fs.FileSystem.from_uri(bundle)
    data = store.open_input_file(path).read()
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == 50 and index.select("frame").distinct().count() > 5


def test_bundles_are_read_by_many_tasks(spark):
    """Fifteen bundles or more, one of a very long page; the reading tasks are counted by partition."""
    long_page = "<p>" + "lorem ipsum dolor " * 200_000
    rows = [(i, "u", f"page {i} " * 200, "", "") for i in range(200)] + [(500, "u", long_page, "", ""), (501, "u", long_page, "", "")]
    index = warc.write_bundles(spark.createDataFrame(rows, PAGES).coalesce(2), shared_path(spark, "warc"), frame_bytes=2000, bundle_bytes=1500)
    bundles = index.select("bundle").distinct().count()
    found = warc.read_bundles(index, with_payload=False).withColumn("task", F.spark_partition_id()).collect()
    assert bundles >= 15 and len({r.task for r in found}) >= max(4, bundles // 2)
    assert Counter(r.page_id for r in found) == Counter(r[0] for r in rows)
    whole = {r.page_id: r for r in found}
    assert whole[501].payload_bytes == len(long_page) and whole[500].refers_to == 501


def check_packing(rows, documents, most):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    expected = Counter()
    for doc_id, text in documents:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), most)):
            own = ids[at : at + most]
            expected[doc_id, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    return len(sequences), sum(r.length for r in rows)


def test_packing_is_exact_and_tight(spark):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack(documents, tokenizer_path()).collect()
    used, tokens = check_packing(rows, [(r.doc_id, r.text) for r in documents.collect()], 2048)
    assert used <= 1.02 * -(-tokens // 2048)


def test_tasks_of_a_worker_share_the_tokenizer():
    """A task gets its functions by value; the next one in the process goes on with the words the tokenizer knows."""
    first = packing.encoder(tokenizer_path())
    ids = list(first.encode([b"a few words", b""]))
    shipped = cloudpickle.loads(cloudpickle.dumps(packing.encoder))
    assert shipped is not packing.encoder and shipped(tokenizer_path()) is first and b"words" in first.known
    assert ids == list(packing.WordTokenizer(tokenizer_path()).encode([b"a few words", b""]))


def test_words_with_signs_need_no_tokenizing_of_their_own():
    words = packing.WordTokenizer(tokenizer_path())
    seen, whole = [], words._whole
    expected = whole("\u00e9t\u00e9, l\u00e0. \u00c9\u00e7, o\u00f9$$$ de $$$")
    words._whole = lambda text: seen.append(text) or whole(text)
    text = "\u00e9t\u00e9, l\u00e0. \u00c9\u00e7, o\u00f9$$$ de $$$".encode()
    assert list(words.encode([text])) == [expected] and sorted(seen) == ["$$$", ",", "."]


def test_ids_of_words_of_odd_letters_and_signs():
    words, chance = packing.WordTokenizer(tokenizer_path()), random.Random(4)
    letters = "abs\u00e9\u00c9\u00df\u00ff\u0130\u0131\u03a3\u03c3\u03c2\u00b2\u00aa\u00b5\u00d7\ufb01\uac00\u0301_'\u2019.,!$-<>` \t\u00a0"
    texts = ["".join(chance.choice(letters) for _ in range(chance.randint(1, 12))) for _ in range(3000)]
    assert list(words.encode([t.encode() for t in texts])) == [words._whole(t) for t in texts]


def test_packing_of_odd_documents(spark, odd_documents, no_documents):
    rows = packing.pack(odd_documents, tokenizer_path(), 64).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in odd_documents.collect()], 64)
    assert packing.pack(no_documents, tokenizer_path()).count() == 0


def test_plan_holds_every_piece_once():
    random = np.random.default_rng(3)
    for scale in (1, 50, 100_000):
        histogram = np.zeros(257, np.int64)
        histogram[1:] = random.integers(0, 2 * scale, 256)
        planned = packing.plan(histogram, 256)
        back = np.zeros(257, np.int64)
        for content, n in planned:
            assert sum(content) <= 256 and n > 0
            np.add.at(back, list(content), n)
        assert (back == histogram).all()
        least = -(-int((histogram * np.arange(257)).sum()) // 256)
        assert sum(n for _, n in planned) <= 1.02 * least + 2
        assert sum(n for _, n in planned) <= sum(n for _, n in packing.best_fit(histogram.copy(), 256))


def test_patterns_beat_best_fit_where_pieces_fill_sequences():
    """Pieces cut from full sequences: the patterns find as many full ones, or nearly so, and never more than best fit."""
    random = np.random.default_rng(8)
    for _ in range(5):
        histogram = np.zeros(65, np.int64)
        for _ in range(3000):
            a, b = sorted(random.integers(1, 64, 2))
            for n in (a, b - a, 64 - b):
                histogram[n] += n > 0
        planned = sum(n for _, n in packing.plan(histogram, 64))
        assert 3000 <= planned <= min(3000 * 1.01, sum(n for _, n in packing.best_fit(histogram.copy(), 64)))


def brute_shards(rows, limit):
    """Leaves of the trie over (address, bytes)."""
    def split(some, prefix):
        if sum(n for _, n in some) <= limit or len(prefix) == sharding.MOST_BITS or not some:
            return {a: (prefix, sum(n for _, n in some)) for a, n in some}
        out = {}
        for bit in "01":
            out |= split([x for x in some if x[0][len(prefix)] == bit], prefix + bit)
        return out
    return split(rows, "")


def test_sharding_against_trie(spark, odd_documents, no_documents):
    documents = spark.read.parquet(f"{SF}/documents.parquet").union(odd_documents.select("doc_id", "text", "lang", "source", "n_chars")).coalesce(3)
    limit = 30_000
    rows = sharding.addressed(documents)
    found_directory, copies = sharding.directory(rows, limit)
    deep = [(r.address, r.n_bytes) for r in copies.collect()]
    heads = {a[: sharding.HASH_BITS] for a, _ in deep}
    expected = brute_shards([(r.address, r.n_bytes) for r in rows.collect() if r.address not in heads] + deep, limit)
    found = sharding.assigned(rows, found_directory, copies).collect()
    assert {r.address: (r.shard, r.shard_bytes) for r in found} == expected and len(found) == rows.count()
    out = sharding.shards(documents, limit).collect()
    assert Counter((r.doc_id, r.n_bytes) for r in out) == Counter((r.doc_id, r.n_bytes) for r in rows.collect())
    assert max(r.local_depth for r in out) > 8
    for r in out:
        assert r.shard_bytes <= limit or r.n_bytes > limit
    assert sharding.shards(no_documents).count() == 0


def test_sharding_splits_copies(spark):
    copies = spark.createDataFrame([(1, "x" * 100)] * 40, "doc_id long, text string")
    out = sharding.shards(copies, 1000).collect()
    assert len(out) == 40 and max(r.shard_bytes for r in out) <= 1000


def test_copies_that_are_dealt_differently_are_not_lost(spark):
    # every job deals the rows to other tasks, as after a lost executor
    copies = spark.createDataFrame([(1, "x" * 100)] * 400 + [(2, "y")], "doc_id long, text string")
    dealt = copies.repartition(7, F.rand())
    out = sharding.shards(dealt, 1000).collect()
    assert Counter(r.doc_id for r in out) == {1: 400, 2: 1} and max(r.shard_bytes for r in out) <= 1000


def test_signs_at_the_end_of_words_are_found_from_the_sign():
    """As from the letter before it, but in less time: most places of a text are no sign."""
    before = re.compile(rb"(?<=[a-z])([.,])(?=[ \n]|$)")
    odd = [b"", b".", b"a.", b"a.\n", b"a,\nb. c.d 1, e., f,. \xc3\xa9, g,", b"\n. h.\r\n,"]
    assert all(packing._STOP.sub(rb" \1", t) == before.sub(rb" \1", t) for t in odd)
    text = b"one of them, and the other one. " * 20_000

    def seconds(pattern):
        took = []
        for _ in range(5):
            start = time.process_time()
            pattern.sub(rb" \1", text)
            took.append(time.process_time() - start)
        return min(took)

    assert seconds(packing._STOP) < 0.8 * seconds(before)


def test_fitting_patterns_keeps_no_counts_of_each():
    lengths = np.bincount(np.clip(np.random.default_rng(3).lognormal(4, 0.9, 4000).astype(int), 1, 512), minlength=513)
    found = packing.patterns([int(n) for n in np.flatnonzero(lengths)], 512)
    tracemalloc.start()
    packing.fit_counts(found, lengths, 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) > 5000 and most < 120 * len(found)
