"""Near-duplicate operators against brute force over all pairs."""

import hashlib
import re
import struct
import time
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from conftest import groups_of
from downfield.llm import buckets, common, components, fingerprint, line_dedup, simhash_groups, suffix_dedup, votes
from pyspark.sql import functions as F


def majority(hashes):
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def unsigned(value):
    return value & (1 << 64) - 1


def chained(hashes):
    seed = 42
    for h in hashes:
        seed = xxh64_intdigest(struct.pack("<Q", h), seed)
    return seed


# operator 9


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    return majority([xxh64_intdigest(g, 42) for g in grams])


def brute_groups(rows):
    prints = [(i, d, brute_print(t)) for i, (d, t) in enumerate(rows)]
    links = [(i, j) for (i, _, p), (j, _, q) in combinations(prints, 2) if (p ^ q).bit_count() <= 3]
    roots = groups_of(range(len(rows)), links)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[roots[i]] = min(least.get(roots[i], d), d)
    return Counter((d, p, least.get(roots[i])) for i, d, p in prints)


def test_groups_equal_all_pairs(spark, odd_documents, no_documents):
    small = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 500")
    for documents in (small, odd_documents):
        found = simhash_groups.near_groups(documents).collect()
        expected = brute_groups([(r.doc_id, r.text) for r in documents.collect()])
        assert Counter((r.doc_id, unsigned(r.fingerprint), r.component_id) for r in found) == expected
    assert simhash_groups.near_groups(no_documents).count() == 0


def test_search_finds_all_links_among_close_prints(spark):
    random = np.random.default_rng(1)
    values = set()
    for _ in range(60):
        centre = int(random.integers(0, 2**63))
        for _ in range(12):
            flips = random.integers(0, 64, random.integers(0, 4))
            values.add(centre ^ sum(1 << int(b) for b in set(flips.tolist())))
    values = sorted(votes.signed(v & (1 << 64) - 1) for v in values)
    prints = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    for radius in (1, 3, 5, 7):
        found = {r.fingerprint: r.component for r in simhash_groups.fingerprint_groups(prints, radius).collect()}
        links = [(a, b) for a, b in combinations(values, 2) if unsigned(a ^ b).bit_count() <= radius]
        assert found == groups_of(values, links)


def test_allocation_covers_the_radius():
    random = np.random.default_rng(2)
    bits = random.random((500, 64)) < 0.4
    bits[:, 1] = bits[:, 0]
    both = (bits.T.astype(float) @ bits)
    assert any({0, 1} <= set(p) for p in simhash_groups.correlated_partitions(500, both, 4))
    for total in (500, 10**6, 10**9):
        for radius in (0, 1, 3, 7):
            plan = simhash_groups.allocate(total, both, radius)
            assert sum(t + 1 for _, t in plan) >= radius + 1
            assert len({b for p, _ in plan for b in p}) == sum(len(p) for p, _ in plan)


def kept_of_groups(rows):
    """The rows that stay, one of each group of linked fingerprints, by brute force."""
    prints = [brute_print(t) for _, t in rows]
    links = [(i, j) for i, j in combinations(range(len(rows)), 2) if (prints[i] ^ prints[j]).bit_count() <= 3]
    groups = defaultdict(list)
    for i, root in groups_of(range(len(rows)), links).items():
        groups[root].append(rows[i])
    return [min((d is None, d or 0) for d, _ in group) for group in groups.values()]


def test_near_duplicates_keep_one_of_each_group(spark, small, odd_documents, no_documents):
    words = [f"word{i}" for i in range(400)]
    changed = [*words[:200], "other", *words[201:]]
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, " ".join(words)), (3, " ".join(words)), (4, " ".join(reversed(words)))]
    made = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for documents in (made, small, odd_documents):
        kept = simhash_groups.without_near_duplicates(documents)
        found = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
        assert found == sorted(kept_of_groups([(r.doc_id, r.text) for r in documents.collect()]))
        assert kept.columns == documents.columns
        groups = simhash_groups.near_groups(documents).where("component_id IS NOT NULL")
        assert {i for missing, i in found if not missing} == {r.component_id for r in groups.select("component_id").distinct().collect()}
    assert simhash_groups.without_near_duplicates(no_documents).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (300, 300), (None, 5)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 300}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# operator 6


def brute_fingerprint(text, size=5):
    words = [xxh64_intdigest(w.encode(), 42) for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    return majority([chained(words[i : i + size]) for i in range(max(1, len(words) - size + 1))] if words else [])


def brute_edits(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, votes.signed(chained_text(r[1]))), reverse=True)
    out = []
    for i, (doc_id, text) in enumerate(order):
        follow = order[(i + 1) % len(order)][1]
        n = len(text) // 3
        edited = text[: len(text) - n] + follow[:n]
        a, b, c = brute_fingerprint(text), brute_fingerprint(edited), brute_fingerprint(follow)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, 1 - (a ^ b).bit_count() / 64, 1 - (a ^ c).bit_count() / 64))
    return Counter(out)


def chained_text(text):
    return xxh64_intdigest(text.encode(), 42)


@pytest.mark.parametrize("per_bucket", [7, 10_000])
def test_edited_fingerprints(spark, small, odd_documents, no_documents, per_bucket, monkeypatch):
    with_next = fingerprint.with_next
    monkeypatch.setattr(fingerprint, "with_next", lambda d: with_next(d, per_bucket))
    for documents in (small, odd_documents):
        found = fingerprint.edited_fingerprints(documents).collect()
        expected = brute_edits([(r.doc_id, r.text or "") for r in documents.collect()])
        got = Counter((r.doc_id, r.n_chars, r.edited_sha256, unsigned(r.fingerprint), unsigned(r.edited_fingerprint), r.near_edited, r.near_next) for r in found)
        assert got == expected
        for r in found:
            near = sum((unsigned(r.fingerprint) ^ unsigned(x.fingerprint)).bit_count() <= 3 for x in found)
            assert r.n_near == (near if r.doc_id is not None and r.doc_id % 100 == 0 else None)
    assert fingerprint.edited_fingerprints(no_documents).count() == 0


def test_ranges_are_even_however_ids_are_spread(spark):
    ids = [*range(3000), 10**12, 10**17, 10**17 + 1, *[1234] * 1500, *[None] * 1500, -5]
    rows = [(d, f"text {i}") for i, d in enumerate(ids)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    placed = fingerprint._in_ranges(documents.withColumn("order", F.xxhash64("text")), 100)
    assert max(r["count"] for r in placed.groupBy("bucket").count().collect()) <= 300
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, votes.signed(chained_text(r[1]))), reverse=True)
    expected = {text: order[(i + 1) % len(order)][1] for i, (_, text) in enumerate(order)}
    assert {r.text: r.next_text for r in fingerprint.with_next(documents, 100).collect()} == expected


def test_likeness_tells_edits_from_strangers(spark):
    rows = fingerprint.edited_fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert np.mean([r.near_edited for r in rows]) > np.mean([r.near_next for r in rows]) + 0.15


# operator 8


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for doc_id, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, votes.signed(chained_text(r[1])))):
        data = text.encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            if data[i : i + length] in seen:
                gone[i : i + length] = True
            seen.add(data[i : i + length])
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[doc_id, text] = (doc_id, len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return Counter(out[r] for r in rows)


def test_repeats_equal_brute_force(spark, small, odd_documents, no_documents):
    random = np.random.default_rng(5)
    passages = ["".join(chr(97 + c) for c in random.integers(0, 3, n)) for n in (99, 100, 101, 130, 167, 168, 250, 600)]
    made = []
    for i in range(120):
        own = ["".join(chr(97 + c) for c in random.integers(0, 4, random.integers(0, 90))) for _ in range(3)]
        picked = [passages[k][random.integers(0, 20) :] for k in random.integers(0, len(passages), 2)]
        made.append((i % 110, own[0] + picked[0] + own[1] + picked[1] + own[2]))
    made += [(500, "ab" * 400), (501, "b" + "ab" * 300), (502, "abab" * 30 + "c")]
    tables = [small, odd_documents.where("doc_id IS NULL OR doc_id < 100"), spark.createDataFrame(made, "doc_id long, text string")]
    for documents in tables:
        found = suffix_dedup.without_repeats(documents, with_text=True).collect()
        got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found)
        assert got == brute_repeats([(r.doc_id, r.text or "") for r in documents.collect()])
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)
    assert suffix_dedup.without_repeats(no_documents).count() == 0


# operator 2


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_equal_all_pairs(spark, small):
    base = "a line of quite ordinary words that will come back again and again in other texts of this table"
    made = [(1000 + i, f"{base} {i}\nshort line\n{base.replace('ordinary', f'odd{i % 3}')}") for i in range(20)]
    documents = small.select("doc_id", "text").where("doc_id < 120").union(spark.createDataFrame(made, "doc_id long, text string"))
    found = line_dedup.repeated_lines(documents).collect()
    expected = all_pair_lines([(r.doc_id, r.text) for r in documents.collect()], 1)
    assert {(r.doc_id, r.place, r.first_id, r.first_place) for r in found} == expected


def test_different_words_never_count_as_equal(spark):
    """Two words of five differ between any two of these lines, whatever their hashes have in common."""
    texts = [f"alpha beta gamma q{i} q{j}" for i, j in ((4622, 7914), (21778, 72908), (4622, 72908), (35, 36))]
    documents = spark.createDataFrame(list(enumerate([texts[0], texts[1], texts[3]])), "doc_id long, text string")
    assert line_dedup.repeated_lines(documents).collect() == []
    linked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.first_id) for r in line_dedup.repeated_lines(linked).collect()} == {(1, 0), (2, 0)}


def test_stored_tables_leave_no_shuffle_files(spark):
    """Files of a shuffle go once the table it was for is written, not when the driver collects its garbage."""
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        names = {f.rsplit("/", 1)[-1] for f in blocks.getAllFiles().mkString("\n").split("\n")}
        return {n for n in names if n.startswith("shuffle_")}

    setting, before = spark.conf.get(common.CLEANUP, None), held()
    table = common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("key")).count(), "counted")
    for _ in range(50):
        if held() <= before:
            break
        time.sleep(0.2)
    assert held() <= before
    assert table.count() == 7 and spark.conf.get(common.CLEANUP, None) == setting


def test_documents_without_repeated_lines(spark, odd_documents, no_documents):
    out = line_dedup.without_repeated_lines(odd_documents)
    assert out.columns == odd_documents.columns
    rows = out.collect()
    assert len(rows) == odd_documents.count()
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r.text)
    assert by_id[1][0].count("quick") == 2 and "second ending" not in by_id[2][0]
    assert by_id[3] == ["", ""] and by_id[4] == [None] and by_id[5] == [""] and by_id[7] == ["one"]
    assert all(r.n_chars == len(r.text) for r in rows if r.doc_id == 3)
    assert line_dedup.without_repeated_lines(no_documents).count() == 0


def test_hub_and_split_pairs_grow_with_the_group(spark):
    # 400 members of one bucket, each one bit from the next: hub pairs join the near ones, the rest by components
    nodes = [(("x", 0), i, True) for i in range(400)]
    members = spark.createDataFrame(nodes, "bucket struct<t: string, v: int>, node long, owner boolean")
    near = lambda a, b: F.abs(a - b) <= 300
    first = components.connected_components(buckets.hub_pairs(members, near))
    assert buckets.split_pairs(members, first, near).count() <= 100 * 400
    found = buckets.bucket_components(members, near).collect()
    assert {r.component for r in found} == {0} and len(found) == 400


def all_pair_lines(rows, least_words, similarity=0.8):
    """As brute_lines, but every two lines are compared."""
    places = defaultdict(list)
    for doc_id, text in rows:
        for place, line in enumerate((text or "").split("\n")):
            norm = re.sub(r"(?:_|[^\w])+", " ", line.lower()).strip()
            if norm and len(norm.split(" ")) >= least_words:
                places[norm].append((doc_id, place))
    split = {norm: norm.split(" ") for norm in places}
    links = []
    for a, b in combinations(sorted(places), 2):
        x, y = split[a], split[b]
        allowed = int(max(len(x), len(y)) * (1 - similarity) + 1e-9)
        if abs(len(x) - len(y)) <= allowed and len(set(x) - set(y)) <= allowed and edit_distance(x, y) <= allowed:
            links.append((a, b))
    groups = defaultdict(list)
    for norm, root in groups_of(places, links).items():
        groups[root] += places[norm]
    return {(d, p, *min(g)) for g in groups.values() for d, p in g if (d, p) != min(g)}


def edited_lines(random, lengths):
    """Pairs of lines (line, edited line) with the largest number of edits that 0.8 allows."""
    out = []
    for n in lengths:
        line = [f"w{random.integers(0, 3000)}" for _ in range(n)]
        other = list(line)
        for _ in range(int(n * 0.2 + 1e-9)):
            at = int(random.integers(0, len(other)))
            kind = random.integers(0, 3)
            if kind == 0:
                other[at] = f"v{random.integers(0, 3000)}"
            elif kind == 1 and len(other) > 1:
                del other[at]
            else:
                other.insert(at, f"v{random.integers(0, 3000)}")
        out.append((" ".join(line), " ".join(other)))
    return out


def test_no_similar_line_is_missed(spark, small):
    random = np.random.default_rng(7)
    pairs = edited_lines(random, [*range(5, 45)] * 3) + [("the " * 9 + "end", "the " * 7 + "other end"), ("a b " * 10, "b a " * 10)]
    made = [(5000 + i, "\n".join(pair)) for i, pair in enumerate(pairs)]
    documents = small.select("doc_id", "text").where("doc_id < 40").union(spark.createDataFrame(made, "doc_id long, text string"))
    found = {(r.doc_id, r.place, r.first_id, r.first_place) for r in line_dedup.repeated_lines(documents).collect()}
    assert found == all_pair_lines([(r.doc_id, r.text) for r in documents.collect()], 1)
    assert {(d, 1) for d, _ in made} <= {f[:2] for f in found}


def test_second_ending_is_found(spark, odd_documents):
    rows = line_dedup.without_repeated_lines(odd_documents).collect()
    assert "second ending" not in "".join(r.text for r in rows if r.doc_id == 2)


def test_lines_of_few_words_and_undivided_scripts(spark):
    chinese = "今天天气很好我们一起去公园散步然后回家吃饭"
    texts = ["Read more", "read  more!", "one", "Two", "two", "alpha beta gamma delta", "alpha beta gamma delta epsilon", chinese, chinese.replace("公园", "海边"), "***", "***"]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {(r.doc_id, r.first_id) for r in line_dedup.repeated_lines(documents).collect()}
    assert found == {(1, 0), (4, 3), (6, 5), (8, 7)}


def test_long_lines_are_compared_by_edits(spark):
    random = np.random.default_rng(11)
    texts, expected = [], set()
    for n, share, alike in ((1990, 0.05, True), (2001, 0.05, True), (2500, 0.19, True), (6000, 0.005, True), (2500, 0.21, False)):
        line = [f"w{random.integers(0, 30_000)}" for _ in range(n)]
        other = list(line)
        for at in random.choice(n, int(n * share), replace=False):
            other[at] = f"v{random.integers(0, 30_000)}"
        if alike:
            expected.add((len(texts) + 1, len(texts)))
        texts += [" ".join(line), " ".join(other)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {(r.doc_id, r.first_id) for r in line_dedup.repeated_lines(documents).collect()} == expected


def test_words_of_lines_are_stored_as_text_and_buckets_with_their_hub(spark, monkeypatch):
    kept, store = {}, line_dedup.stored
    monkeypatch.setattr(line_dedup, "stored", lambda frame, name, *more: kept.setdefault(name, frame.columns) and store(frame, name, *more))
    text = "one two three four five six seven eight nine ten"
    documents = spark.createDataFrame([(1, text), (2, text + " eleven"), (2, text + " eleven")], "doc_id long, text string")
    assert [(r.doc_id, r.first_id) for r in line_dedup.repeated_lines(documents).collect()] == [(2, 1)]
    assert kept["words"] == ["node", "n", "kinds", "norm"] and kept["met"] == ["bucket", "node", "n", "hub"]


def test_lines_that_share_pairs_of_words_alone_rarely_meet(spark, monkeypatch):
    """Buckets of pairs held most of these lines with others; their number grew with the square of the lines."""
    random, kept, store = np.random.default_rng(5), {}, line_dedup.stored

    def keep(frame, name, *more):
        out = store(frame, name, *more)
        kept.setdefault(name, out)
        return out

    monkeypatch.setattr(line_dedup, "stored", keep)
    monkeypatch.setattr(line_dedup, "discard", lambda *frames: None)
    lines = [" ".join(f"left{i} right{i}" for i in random.choice(200, 10, replace=False)) for _ in range(200)]
    documents = spark.createDataFrame([*enumerate(lines), (200, lines[0] + " more")], "doc_id long, text string")
    assert [(r.doc_id, r.first_id) for r in line_dedup.repeated_lines(documents).collect()] == [(200, 0)]
    assert kept["met"].count() < 400 and kept["words"].count() < 201


def kept_tables(monkeypatch):
    """What line dedup stores, by name, in the order of storing; nothing is deleted."""
    kept, store = defaultdict(list), line_dedup.stored

    def keep(frame, name, *more):
        kept[name].append(store(frame, name, *more))
        return kept[name][-1]

    monkeypatch.setattr(line_dedup, "stored", keep)
    monkeypatch.setattr(line_dedup, "discard", lambda *frames: None)
    return kept


def test_buckets_are_searched_in_parts_and_those_with_the_same_lines_become_one(spark, monkeypatch):
    """All members of all buckets were shuffled at once, and each bucket of a group of near copies was kept."""
    kept = kept_tables(monkeypatch)
    base = [f"word{i}" for i in range(40)]
    texts = [" ".join([*base[:-1], f"last{i}"]) for i in range(10)]
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = line_dedup.repeated_lines(documents).collect()
    assert sorted((r.doc_id, r.first_id) for r in found) == [(i, 0) for i in range(1, 10)]
    rows = [part.count() for part in kept["met"]]
    assert len(rows) == line_dedup.PARTS and all(rows) and kept["sets"][0].count() == 10
    assert kept["sets"][0].groupBy("node").sum("weight").first()[1] == sum(rows) / 10


def test_lines_that_share_one_passage_are_not_compared(spark, monkeypatch):
    """Lines of one bucket were joined with their kinds of words however few buckets they shared."""
    kept = kept_tables(monkeypatch)
    lines = [" ".join([*[f"left{i}x{k}" for k in range(30)], "some longish passage", *[f"right{i}x{k}" for k in range(30)]]) for i in range(40)]
    documents = spark.createDataFrame([*enumerate(lines), (40, lines[0] + " more")], "doc_id long, text string")
    assert [(r.doc_id, r.first_id) for r in line_dedup.repeated_lines(documents).collect()] == [(40, 0)]
    assert sum(part.count() for part in kept["met"]) > 40 and kept["words"][0].count() == 2
    assert [(r.a, r.b) for r in kept["first"][0].collect()] == [(r.a, r.b) for r in kept["pairs"][0].collect()]
    assert kept["first"][0].count() == 1 and kept["pairs"][1].count() == 0


def test_similar_lines_of_repeated_words_are_found(spark):
    """Repeated runs count singly, and more buckets are asked for of long lines; no similar line may be missed."""
    random = np.random.default_rng(13)
    pairs = []
    for n in (5, 6, 9, 10, 14, 15, 20, 25, 39, 40, 60, 80, 120, 200, 320):
        for words, most in ((4, 6), (12, 1), (12, 9), (400, 1)):
            line = []
            while len(line) < n:
                line += [f"q{n}w{random.integers(0, words)}"] * int(random.integers(1, most + 1))
            line, other = line[:n], list(line[:n])
            for k, at in enumerate(random.choice(n, n // 5, replace=False)):
                other[at] = f"new{k}" if random.integers(0, 2) else line[int(random.integers(0, n))]
            pairs.append((" ".join(line), " ".join(other)))
    pairs += [(a, " ".join(a.split(" ") + ["x"] * (len(a.split(" ")) // 4))) for a, _ in pairs]  # the longer one has a fifth more
    documents = spark.createDataFrame([(i, "\n".join(p)) for i, p in enumerate(pairs)], "doc_id long, text string")
    found = {(r.doc_id, r.place) for r in line_dedup.repeated_lines(documents).collect()}
    assert {(i, 1) for i in range(len(pairs))} <= found
    few = documents.where(F.length("text") < 400)
    found = {(r.doc_id, r.place, r.first_id, r.first_place) for r in line_dedup.repeated_lines(few).collect()}
    assert found == all_pair_lines([(r.doc_id, r.text) for r in few.collect()], 1)
