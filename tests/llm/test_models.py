"""Toxicity, importance resampling, decontamination."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from downfield.llm import decontaminate, importance, toxicity

SF = "/root/testdata/sf0.1"


def ranked_above(scores, labels):
    """Probability that a row of label 1 scores above one of label 0."""
    order = np.argsort(np.argsort(scores, kind="stable"))
    ones = labels.sum()
    return (order[labels == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(labels) - ones))


def test_toxicity_on_held_out_rows(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(documents, labels).collect()
    assert len(rows) == documents.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in truth]
    scores, y = np.array([r.score for r in own]), np.array([truth[r.doc_id] for r in own])
    predicted = np.array([r.predicted for r in own])
    print("held out", len(own), "ranked", ranked_above(scores, y), "accuracy", (predicted == y).mean(), "recall", predicted[y == 1].mean(), "precision", y[predicted == 1].mean())
    # measured: 0.951 and 0.939
    assert ranked_above(scores, y) > 0.93 and (predicted == y).mean() > 0.92


def test_toxicity_of_misspelt_words_and_odd_rows(spark, odd_documents, no_documents):
    made = []
    for i in range(300):
        words = [f"word{(i * 7 + k * 13) % 90}" for k in range(40)]
        if i % 3 == 0:
            words[5], words[20] = "horribleinsult", "nastyinsult"
        made.append((i, " ".join(words), int(i % 3 == 0)))
    frame = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame, frame.select("doc_id", "toxic"), toxicity.Settings(epochs=20))
    known: dict = {}
    clean = " ".join(f"word{k}" for k in range(40))
    assert toxicity.score_bytes(clean.encode(), model, known) < 0.3
    assert toxicity.score_bytes((clean + " horibleinsult nastyinsulter").encode(), model, known) > 0.3
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 0, 0), (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(no_documents, labels).count() == 0
    assert all(r.predicted == int(r.score >= 0.3) for r in toxicity.toxicity(odd_documents, labels.where("false")).collect())
    assert toxicity.without_toxic(odd_documents, labels).columns == odd_documents.columns


def test_labels_of_held_out_rows_do_not_matter(spark):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    from pyspark.sql import functions as F

    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = ({r.doc_id: r.score for r in toxicity.toxicity(documents, x).collect()} for x in (labels, turned))
    assert a == b


def test_resampling_equals_brute_force(spark, odd_documents, no_documents):
    documents, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    found = importance.resample(documents, labels, fraction=0.5).collect()
    good = {r.doc_id for r in labels.collect() if r.quality}
    counts = np.zeros((2, 10_000))
    grams = {}
    for r in documents.collect():
        words = re.findall(rb"[0-9a-z\x80-\xff]+|[^\s0-9a-z\x80-\xff]", r.text.encode().lower())
        h = [zlib.crc32(w) for w in words]
        own = [x % 10_000 for x in h]
        for a, b in zip(h, h[1:]):
            x = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F) % 2**64
            own.append((x ^ x >> 29) % 10_000)
        grams[r.doc_id] = own
        for g in own:
            counts[1, g] += 1
            counts[0, g] += r.doc_id in good
    ratio = np.log((counts[0] + 1) / (counts[0].sum() + 10_000)) - np.log((counts[1] + 1) / (counts[1].sum() + 10_000))
    rows = importance.resample(documents, labels, fraction=1.0).collect()
    keys = {r.doc_id: r.key for r in rows}
    for r in rows:
        assert abs(r.log_weight - ratio[grams[r.doc_id]].sum()) < 1e-6 and abs(r.key - r.log_weight - r.noise) < 1e-9
    # noise depends on id and text, so copies differ; no two keys tie here
    assert {r.doc_id for r in found} == set(sorted(keys, key=keys.get)[-500:])
    assert importance.resample(no_documents, labels).count() == 0
    assert importance.resample(odd_documents, labels.where("false"), fraction=1.0).count() == odd_documents.count()


def test_resampling_prefers_good_documents(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = importance.resample(documents, labels, fraction=1.0).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    own = [r for r in rows if r.doc_id in truth]
    assert ranked_above(np.array([r.key for r in own]), np.array([truth[r.doc_id] for r in own])) > 0.8


def test_noise_is_gumbel(spark):
    rows = spark.range(20_000).selectExpr("id AS doc_id", "'' AS text")
    noise = np.array([r.noise for r in importance.scored(rows, np.zeros(10), 17).collect()])
    assert abs(noise.mean() - 0.5772) < 0.03 and abs(noise.var() - np.pi**2 / 6) < 0.08


# operator 10


def brute_hits(documents, items, size=10):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    windows = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - size + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in documents:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


BENCHMARK = "item_id long, text string, hits string"


@pytest.mark.parametrize("block_words", [4_000_000, 60])
def test_decontamination_equals_brute_force(spark, odd_documents, no_documents, block_words, monkeypatch):
    find = decontaminate.find_overlaps
    monkeypatch.setattr(decontaminate, "find_overlaps", lambda d, b, w=10: find(d, b, w, block_words))
    items = [
        (1, "Quick brown FOX jumps over the lazy dog while seven wizards brew a fine potion", "x"), (10, "one", "x"), (2, "ßtraße", "x"),
        (3, None, "x"), (4, "!!! ---", "x"), (5, "first ending is here", "x"), (5, "first ending is here", "x"), (None, "another text under", "x"),
        (7, "potion of moss and ember tonight the quick brown fox jumps", "x"),
    ]
    benchmark = spark.createDataFrame(items, BENCHMARK)
    found = decontaminate.contamination(odd_documents, benchmark).collect()
    expected = brute_hits([(r.doc_id, r.text) for r in odd_documents.collect()], [i[:2] for i in items])
    assert Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in found) == expected
    assert decontaminate.contamination(no_documents, benchmark).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(odd_documents, benchmark.where("false")).collect())
    clean = decontaminate.remove_contaminated(odd_documents, benchmark)
    assert clean.columns == odd_documents.columns
    assert clean.count() == sum(n for row, n in expected.items() if not row[-1])


def test_spans_are_places_in_the_text(spark):
    text = "Größe: A b-c, D e f G h i J!  und mehr"
    documents = spark.createDataFrame([(1, text)], "doc_id long, text string")
    benchmark = spark.createDataFrame([(1, "a B c d E f g h I j", "")], BENCHMARK)
    (row,) = decontaminate.find_overlaps(documents, benchmark).collect()
    assert [text[s.start : s.end] for s in row.spans] == ["A b-c, D e f G h i J"]
