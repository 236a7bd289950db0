import hashlib
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from downfield.llm.merkle import documents_manifest, folded, leaf_digest, manifest

H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(r, text):
    return H(*[field(v) for v in (r.doc_id, r.source, r.lang, r.n_chars, text)])


def climb(nodes):
    """The root and, per node, the siblings before and after it at each level."""
    places, proofs = list(range(len(nodes))), [[] for _ in nodes]
    while len(nodes) > 1:
        for i, place in enumerate(places):
            start = place - place % 3
            proofs[i].append(("".join(nodes[start:place]), "".join(nodes[place + 1 : start + 3])))
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        places = [p // 3 for p in places]
    return nodes[0], proofs


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.source].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[s] = climb([leaf(r, r.text) for r in groups[s]])
    root, tops = climb([trees[s][0] for s in order])
    found = []
    for s, top in zip(order, tops):
        for r, proof in zip(groups[s], trees[s][1]):
            steps, text = proof + top, r.text
            if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            node = leaf(r, text)
            for before, after in steps:
                node = H(before, node, after)
            found.append((r.doc_id, leaf(r, r.text), trees[s][0], root, H(*[b + a for b, a in steps]), node, node == root))
    return sorted(found, key=repr)


def rows_of(frame):
    return sorted([tuple(r) for r in frame.collect()], key=repr)


def test_odd_rows(odd_documents):
    assert rows_of(documents_manifest(odd_documents)) == brute(odd_documents.collect())


def test_trees_of_many_sizes(spark):
    """Around every power of three and block border, so that runs of one and two nodes occur at each level."""
    sizes = [1, 2, 3, 4, 9, 10, 27, 28, 81, 82, 242, 243, 244, 486, 487, 729, 730]
    rows = spark.createDataFrame(
        [(1000 * s + i, f"text {i}\nof {s}", "en", f"s{s:04}", i) for s in sizes for i in range(s)],
        "doc_id long, text string, lang string, source string, n_chars long",
    )
    found = rows_of(documents_manifest(rows))
    assert found == brute(rows.collect())
    assert not all(r[-1] for r in found) and any(r[-1] for r in found)


def test_one_source_and_one_row(spark):
    one = spark.createDataFrame([(1, "a\nb", None, None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    assert rows_of(documents_manifest(one)) == brute(one.collect())


def test_many_sources(spark):
    rows = spark.createDataFrame([(i, f"t{i}", "en", f"src{i}", 1) for i in range(800)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert rows_of(documents_manifest(rows)) == brute(rows.collect())


def test_any_table(spark):
    """The manifest of another table; each proof leads to the one root, and a changed leaf does not."""
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("part"))
    proofs = manifest(rows, F.col("part"), [F.col("id")], leaf_digest([F.col("id")]), F.struct("id"))
    found = proofs.select("root", folded(F.col("leaf"), F.col("proof")).alias("again"), folded(F.sha2(F.lit("x"), 256), F.col("proof")).alias("other"))
    assert found.where("root = again").count() == 500 and found.where("root = other").count() == 0


def test_no_documents(no_documents):
    assert documents_manifest(no_documents).collect() == []
