import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "fingerprint string, bucket string, key string, size long, `row` long, node long, spans string, id long, document string, component long, mark string, label string"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns named as operators name theirs."""
    long_text = " ".join(f"w{i % 977}x{i % 389}" for i in range(40_000))
    passage = "the quick brown fox jumps over the lazy dog while seven wizards brew a fine potion of moss and ember tonight " * 2
    rows = [
        (1, passage + "\nfirst ending is here for all to see today", "en", "a", 10),
        (2, passage + "\nsecond ending is here for all to see today", "en", "a", 10),
        (2, "another text under the same id, with enough words to count as one", "en", "a", 10),
        (3, passage + "\nfirst ending is here for all to see today", None, None, None),
        (3, passage + "\nfirst ending is here for all to see today", None, None, None),
        (4, None, "en", "a", 0), (5, "", "en", "a", 0), (6, "   \n\t ", "en", "a", 6), (None, "", "en", "a", 0),
        (None, passage, "en", "a", 5), (None, passage, "en", "a", 5), (7, "one", "en", "a", 3), (8, "One", "en", "a", 3),
        (100, long_text, "en", "a", 1), (101, long_text + " tail", "en", "a", 1), (9, "Ünïcödé ßtraße — ñandú " * 30, "de", "b", 2),
        (10, "aaaa" * 200, "en", "a", 1), (11, "<|endoftext|> Mixed <|startoftext|>, don't stop... é  x", "en", "a", 1),
    ]
    wide = [(*r, "f", "b", "k", 1, 2, 3, "s", 4, "d", 5, "m", "l") for r in rows]
    return spark.createDataFrame(wide, f"{DOCUMENTS}, {CLASHING}")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def groups_of(nodes, links):
    """The least member reachable from each node."""
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return {n: root(n) for n in nodes}
