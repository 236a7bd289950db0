import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from downfield.llm import hard_negatives as hard
from downfield.llm.hard_negatives import Bucket, mined

COLUMNS = "vec_id long, embedding array<double>, label int"


def brute(rows):
    """Per anchor its first positives, per positive its first negatives in the range, by sorting all rows."""
    usable = []
    for r in rows:
        v = r["embedding"]
        if r["vec_id"] is None or r["label"] is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        usable.append((r["vec_id"], label, [math.floor(x * 256) for x in v]))
    found = []
    for i, (anchor, label, v) in enumerate(usable):
        if anchor % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), other, at) for j, (other, at, w) in enumerate(usable) if j != i and len(w) == len(v)]
        for ps, positive, _ in sorted(s for s in scored if s[2] == label)[:5]:
            inside = sorted(s for s in scored if s[2] != label and 30 * -ps <= 100 * -s[0] <= 90 * -ps)[:10]
            found += [(anchor, positive, k + 1, n, -ps, -ns) for k, (ns, n, _) in enumerate(inside)]
    return sorted(found)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def clustered(count, seed, dim=16):
    random.seed(seed)
    centres = [[random.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [x * random.lognormvariate(0, 0.5) + random.gauss(0, 0.4) for x in centres[random.randrange(6)]], random.randrange(5))
            for i in range(count)]


def test_equals_sorting_all_rows(spark, monkeypatch):
    """Many small buckets and blocks of anchors, so that thresholds from other buckets rule rows out."""
    monkeypatch.setattr(hard, "BUCKET", 64)
    monkeypatch.setattr(hard, "BLOCK_BYTES", 8 * 16 * 3)
    rows = spark.createDataFrame(clustered(1500, 3), COLUMNS)
    assert rows_of(mined(rows)) == brute(rows.collect())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = clustered(300, 5, dim=4) + [
        (None, [1.0, 1.0, 1.0, 1.0], 1), (1000, None, 1), (1001, [1.0, None, 1.0, 1.0], 1), (1100, [1.0, nan, 1.0, 1.0], 1),
        (1200, [inf, 0.0, 0.0, 0.0], 1), (1300, [1.0, 1.0, 1.0, 1.0], None), (1400, [], 1), (1401, [], 1), (1402, [], 2), (1500, [1.0], 1),
        (1501, [2.0], 1), (1502, [1.5], 3), (1600, [0.0, 0.0, 0.0, 0.0], 1), (1700, [-1.0, -1.0, -1.0, -1.0], 9),
        (700, [2.0, 2.0, 2.0, 2.0], 9), (700, [2.0, 2.0, 2.0, 2.0], 9),
    ] + [(2000 + i, [0.5, 0.25, -0.25, 0.5], 2) for i in range(40)]
    extra = spark.createDataFrame(rows, COLUMNS).withColumns({"row": F.lit(1), "position": F.lit("x"), "bucket": F.lit(2), "length": F.lit(0)})
    assert rows_of(mined(extra)) == brute(rows_as_dicts(rows))


def rows_as_dicts(rows):
    return [dict(zip(("vec_id", "embedding", "label"), r)) for r in rows]


def test_large_values_are_exact(spark):
    rows = [(i, [float((i * 37) % 11 - 5) * 2.0**17, float((i * 53) % 13 - 6) * 2.0**18 + i / 256], i % 2) for i in range(250)]
    assert rows_of(mined(spark.createDataFrame(rows, COLUMNS))) == brute(rows_as_dicts(rows))


def test_no_rows(spark):
    assert mined(spark.createDataFrame([], COLUMNS)).collect() == []


def test_candidates_hold_every_row_that_reaches_the_score():
    """Ranges of focus coordinates lose none, and rule out most where the wanted score is high."""
    random_ = np.random.default_rng(1)
    vectors = np.floor(random_.normal(0, 100, (500, 24)) * random_.lognormal(0, 0.7, (500, 1))).astype(np.int64)
    length = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-length)
    vectors, length = vectors[order], length[order]
    table = pa.table({"vector": pa.array(list(vectors), pa.list_(pa.int64())), "length": length, "vec_id": np.arange(500),
                      "row_key": [str(i) for i in range(500)]})
    bucket, considered = Bucket(table), 0
    for anchor in vectors[::25]:
        scores = vectors @ anchor
        for wanted in (np.sort(scores)[-5], np.sort(scores)[-50], 1, 0, -10):
            places = bucket.candidates(anchor, math.sqrt(float((anchor.astype(float) ** 2).sum())), int(wanted))
            assert set(np.flatnonzero(scores >= wanted)) <= set(places)
            considered += len(places) if wanted == np.sort(scores)[-5] else 0
    assert considered < 0.5 * 500 * len(vectors[::25])
