"""The operators' registered queries, and SQL for those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contamination
from .fingerprint import edited_fingerprints
from .hard_negatives import mined
from .importance import resample
from .line_dedup import repeated_lines
from .merkle import documents_manifest
from .mixing import mixture, per_row
from .packing import pack
from .sharding import shards
from .simhash_groups import hex_digits, near_groups
from .suffix_dedup import without_repeats
from .toxicity import toxicity
from .warc import round_trip


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "place", "first_id", "first_place")


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edited_fingerprints(table(spark, sf_dir, "documents"))
    return rows.withColumns({c: hex_digits(c) for c in ("fingerprint", "edited_fingerprint")})


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))


def repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).drop("spans")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).withColumn("fingerprint", hex_digits("fingerprint"))


def contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = per_row(mixture(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_manifest(table(spark, sf_dir, "documents"))


def negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mined(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc, "op2_line_dedup": lines, "op3_importance": importance, "op4_packing": packing,
    "op5_toxicity": toxic, "op6_fingerprint": prints, "op7_sharding": sharding, "op8_suffix_dedup": repeats,
    "op9_simhash_groups": groups, "op10_decontamination": contaminated, "op11_mixing": mixing,
    "op12_merkle": merkle, "op13_hard_negatives": negatives,
}


def _merkle_sql(row_levels: int = 12, source_levels: int = 8) -> str:
    """Level by level; a tree that is down to one node passes it on."""

    def level(before: str, name: str) -> str:
        return f"""
        {name} AS MATERIALIZED (SELECT g, i // 3 AS i, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h
                   FROM {before}_n GROUP BY g, i // 3), {sized(name)}"""

    def sized(name: str) -> str:
        run = "PARTITION BY g, i // 3 ORDER BY i ROWS BETWEEN"
        return f"""
        {name}_n AS MATERIALIZED (SELECT g, i, h, count(*) OVER (PARTITION BY g) AS n,
                     coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS b,
                     coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS a FROM {name})"""

    def paths(name: str, count: int) -> str:
        joins = " ".join(f"JOIN {name}{k}_n n{k} ON n{k}.g = x.g AND n{k}.i = x.i // {3 ** k}" for k in range(count))
        steps = ", ".join(f"{{'n': n{k}.n, 'b': n{k}.b, 'a': n{k}.a}}" for k in range(count))
        return f"SELECT x.g, x.i, x.h, list_filter([{steps}], lambda s: s.n > 1) AS steps FROM {name}0 x {joins}"

    def field(column: str) -> str:
        return f"coalesce(strlen(CAST({column} AS VARCHAR)) || ':' || {column}, '-')"

    head = " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    rows = "".join("," + level(f"d{k}", f"d{k + 1}") for k in range(row_levels))
    sources = "".join("," + level(f"s{k}", f"s{k + 1}") for k in range(source_levels))
    return f"""
        WITH RECURSIVE bits(c, v, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL
                     SELECT c, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
        crc AS (SELECT list(v ORDER BY c) AS t FROM bits WHERE k = 8),
        r AS (SELECT doc_id, coalesce('=' || source, '') AS g, sha256({head} || {field("text")}) AS h,
                     sha256({head} || {field("replace(text, chr(10), '')")}) AS tampered,
                     xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                         lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8)), 4294967295) AS crc32 FROM documents, crc),
        d0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS i, h, doc_id, tampered, crc32 FROM r),
        {sized("d0")}{rows},
        s0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h, g AS source FROM d{row_levels}),
        {sized("s0")}{sources},
        dp AS ({paths("d", row_levels)}), sp AS ({paths("s", source_levels)}),
        p AS (SELECT d0.*, s0.h AS subroot, top.h AS root, list_concat(dp.steps, sp.steps) AS steps
              FROM d0 JOIN dp USING (g, i) JOIN s0 ON s0.source = d0.g JOIN sp ON sp.i = s0.i JOIN s{source_levels} top ON top.i = 0),
        f AS (SELECT *, list_reduce(list_concat([{{'b': '', 'a': '', 'v': CASE WHEN crc32 % 2 = 0 THEN tampered ELSE h END}}],
                       list_transform(steps, lambda s: {{'b': s.b, 'a': s.a, 'v': ''}})),
                       lambda x, y: {{'b': '', 'a': '', 'v': sha256(y.b || x.v || y.a)}}).v AS folded_root FROM p)
        SELECT doc_id, h AS leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda s: s.b || s.a), '')) AS proof_sha256,
               folded_root, folded_root = root AS verified FROM f"""


ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
        d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
        w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last,
                     count(*) OVER (PARTITION BY payload_digest) AS n FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND n > 1 AND page_id <> last THEN last END AS refers_to
        FROM w""",
    "op7_sharding": """
        WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n_bytes,
                          lpad(bin(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 14))::UBIGINT), 56, '0') AS address
                   FROM documents),
        t AS (SELECT depth, substr(address, 1, depth) AS shard, sum(n_bytes) AS shard_bytes, count(*) AS shard_docs
              FROM d, (SELECT unnest(range(0, 33)) AS depth) GROUP BY ALL),
        m AS (SELECT d.doc_id, d.n_bytes, d.address, min(t.depth) AS local_depth
              FROM d JOIN t ON t.shard = substr(d.address, 1, t.depth) WHERE t.shard_bytes <= 33554432 GROUP BY ALL)
        SELECT m.doc_id, m.n_bytes, t.shard, CAST(m.local_depth AS INTEGER) AS local_depth,
               CAST(t.shard_bytes AS BIGINT) AS shard_bytes, t.shard_docs
        FROM m JOIN t ON t.depth = m.local_depth AND t.shard = substr(m.address, 1, m.local_depth)""",
    "op10_decontamination": """
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        x AS (SELECT DISTINCT item, size, array_to_string(w[i:i + size - 1], ' ') AS gram
              FROM (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
                    FROM b WHERE len(w) > 0)),
        s AS (SELECT DISTINCT size FROM x),
        p AS (SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS gram
              FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, s WHERE len(w) >= size)),
        f AS (SELECT p.doc_id, p.i, p.size, x.item FROM p JOIN x USING (size, gram)),
        h AS (SELECT doc_id, count(DISTINCT place) AS n_hit
              FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM f) GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, item FROM f) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op11_mixing": """
        WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                          md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(source, ''), coalesce(text, ''))) AS mark FROM documents),
        u AS (SELECT *, (CAST(('0x' || substr(mark, 1, 13))::UBIGINT AS DOUBLE) + 0.5) / 4503599627370496.0::DOUBLE AS draw FROM d),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 2.0::DOUBLE * sum(size) AS bound,
                     [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS weight
              FROM d GROUP BY source),
        -- sources by how soon they reach their bound; the level is right where the next bound is above it
        o AS (SELECT *, row_number() OVER (ORDER BY bound / weight, source NULLS LAST) AS k FROM s),
        l AS (SELECT a.k, (1.5::DOUBLE * (SELECT sum(source_size) FROM s) - coalesce((SELECT sum(bound) FROM o WHERE o.k < a.k), 0))
                          / (SELECT sum(weight) FROM o WHERE o.k >= a.k) AS level, a.bound / a.weight AS reach FROM o a),
        t AS (SELECT source, source_size, least(weight * (SELECT level FROM l WHERE level < reach ORDER BY k LIMIT 1), bound) AS target FROM s),
        g AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio, floor(ratio) AS whole,
                     target - whole * source_size AS rest, ratio - whole AS chance FROM t),
        r AS (SELECT doc_id, size, mark, draw, g.*, CASE WHEN chance > 0 THEN (draw / (1 - draw)) / (chance / (1 - chance)) END AS odds,
                     floor(odds / (1 + odds) * 4503599627370496.0::DOUBLE) AS rank
              FROM u JOIN g ON u.source IS NOT DISTINCT FROM g.source),
        c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, mark ROWS UNBOUNDED PRECEDING) AS upto FROM r),
        m AS (SELECT *, upto <= rest AS first, min(CASE WHEN upto > rest THEN rest - (upto - size) END) OVER (PARTITION BY source) AS unused,
                     max(CASE WHEN upto <= rest THEN upto ELSE 0 END) OVER (PARTITION BY source) AS filled FROM c),
        n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN first OR size = 0 OR abs(rest - filled - size) >= rest - filled THEN 1 ELSE 0 END,
                            abs(rest - filled - size), rank, mark) = 1
                     AND NOT first AND size > 0 AND abs(rest - filled - size) < rest - filled AS filler FROM m)
        SELECT doc_id, size, source_size, target,
               CAST(size * (whole + CASE WHEN chance > 0 AND (first OR filler) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM n""",
    "op12_merkle": _merkle_sql(),
    "op13_hard_negatives": """
        WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                          list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
                   FROM embeddings WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
        a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
        s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
              FROM a JOIN v b ON a.vec_id <> b.vec_id),
        p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
               p.score AS positive_score, s.score AS negative_score
        FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
        WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id)
        QUALIFY row_number() OVER w <= 10""",
}
