"""A Merkle manifest of a dataset: a hash per row, per group of rows and for all (operator 12).

Rows of a group stand in order; three neighbours at a time are hashed into a parent until one node, the group's
root, is left. The group roots form one more tree. An aligned block of 3 ** 5 neighbours is one row that keeps each
of its levels as one string of digests of fixed width: substrings of a level are hashed into the next one, and the
substrings to the left and right of a node in its run are its siblings. Block roots are the nodes of a tree above,
built alike. Hashing is Spark's own; no group has to fit into a task, as a block holds 243 rows at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .numbering import numbered

FAN_OUT, LEVELS = 3, 5
BLOCK = FAN_OUT**LEVELS
WIDTH = 64  # a digest in hex
SIBLINGS = "array<struct<before:string,after:string>>"


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def leaf_digest(fields: Sequence[Column]) -> Column:
    """The digest of a row: each field as its length in UTF-8 bytes, a colon and its text, or a dash for null."""

    def framed(field: Column) -> Column:
        text = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return digest(F.concat(*[framed(f) for f in fields]).cast("binary"))


def _cut(level: Column, first: Column, nodes: int | Column) -> Column:
    """The digests of a level from node `first` (from 0) on; levels are ASCII bytes, so a cut is a copy."""
    size = F.lit(nodes * WIDTH) if isinstance(nodes, int) else nodes * WIDTH
    return F.substring(level, (first * WIDTH + 1).cast("int"), size.cast("int"))


def _parents(level: Column) -> Column:
    runs = F.ceil(F.length(level) / F.lit(FAN_OUT * WIDTH))
    hashed = F.transform(F.sequence(F.lit(0).cast("long"), runs - 1), lambda run: digest(_cut(level, run * FAN_OUT, FAN_OUT)))
    return F.array_join(hashed, "").cast("binary")


def _depth() -> Column:
    """Levels above a block's nodes: all of them if the tree goes on above it, else up to the one that is left."""
    depth = F.lit(LEVELS)
    for level in reversed(range(LEVELS)):
        depth = F.when(F.col("total") <= FAN_OUT**level, level).otherwise(depth)
    return depth


def _blocks(nodes: DataFrame) -> DataFrame:
    """(tree, block, total, members, depth, level0 … level5, root) of nodes (tree, position, total, node, row)."""
    members = F.array_sort(F.collect_list(F.struct("position", "node", "row")))
    rows = nodes.groupBy("tree", F.floor(F.col("position") / BLOCK).alias("block")).agg(
        members.alias("members"), F.max("total").alias("total")
    )
    rows = rows.withColumns({"depth": _depth(), "level0": F.array_join("members.node", "").cast("binary")})
    for k in range(1, LEVELS + 1):
        rows = rows.withColumn(f"level{k}", F.when(F.col("depth") >= k, _parents(F.col(f"level{k - 1}"))))
    top = F.coalesce(*[F.col(f"level{k}") for k in reversed(range(LEVELS + 1))])
    return rows.withColumn("root", top.cast("string"))


def _siblings(position: Column) -> Column:
    """The proof of a node inside its block: per level, the digests before and after it in its run."""
    inside, steps = position % BLOCK, []
    for k in range(LEVELS):
        place = F.floor(inside / F.lit(FAN_OUT**k))
        start = place - place % FAN_OUT
        level = F.col(f"level{k}")
        before = _cut(level, start, place % FAN_OUT)
        after = _cut(level, place + 1, start + (FAN_OUT - 1) - place)
        steps.append(F.when(F.col("depth") > k, F.struct(before.cast("string").alias("before"), after.cast("string").alias("after"))))
    return F.filter(F.array(*steps), lambda step: step.isNotNull())


def _tree(leaves: DataFrame, name: str) -> list[DataFrame]:
    """The blocks of all levels, from the leaves to the one block that is left of each tree. Stored."""
    found, nodes = [], leaves
    while True:
        blocks = stored(_blocks(nodes), name)
        found.append(blocks)
        if not blocks.agg(F.max("total").alias("n")).where(F.col("n") > BLOCK).count():
            return found
        nodes = blocks.select(
            "tree", F.col("block").alias("position"), F.ceil(F.col("total") / BLOCK).alias("total"),
            F.col("root").alias("node"), F.lit(None).cast("string").alias("row"),
        )


def _proved(blocks: list[DataFrame], above: DataFrame) -> DataFrame:
    """(tree, row, node, proof, subroot, root) of the leaves; `above` has (tree, proof, subroot, root) of the tree tops."""
    proofs = above.withColumn("block", F.lit(0).cast("long"))
    for level in reversed(blocks):
        joined = level.drop("root").join(proofs.withColumnsRenamed({"tree": "of_tree", "block": "of_block", "proof": "above"}),
                                         (F.col("tree") == F.col("of_tree")) & (F.col("block") == F.col("of_block")))
        members = joined.withColumn("member", F.explode("members"))
        proof = F.concat(_siblings(F.col("member.position")), "above")
        found = members.select(
            "tree", F.col("member.position").alias("block"), F.col("member.row").alias("row"),
            F.col("member.node").alias("node"), proof.alias("proof"), "subroot", "root",
        )
        proofs = found.drop("row", "node")
    return found.drop("block")


def tree_key(group: Column) -> Column:
    """Text that sorts like the group's text by UTF-8 bytes, null first, and is never null."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))


def manifest(rows: DataFrame, group: Column, order: Sequence[Column], leaf: Column, carried: Column) -> DataFrame:
    """(row, leaf, proof, subroot, root): the proof of every row of a table.

    `leaf` is the digest of a row, `group` the column whose values have a tree each, `order` the order inside.
    `carried` comes back as `row`. A proof lists, from the leaf up to the root of all, the siblings before and after
    the node; a run of one node has an empty step, a tree of one node none. `folded` recomputes the root from it.

    A null group is a group of its own and comes first. Nulls in the order come first. Rows that agree in order
    and leaf have neighbouring places. An empty table gives no rows.
    """
    leaves = stored(rows.select(tree_key(group).alias("tree"), leaf.alias("node"), carried.alias("row"),
                                *[c.alias(f"key{i}") for i, c in enumerate(order)]), "leaves")
    keys = [F.col(c) for c in leaves.columns if c.startswith("key")] + [F.col("node")]
    placed = numbered(leaves, ["tree"], keys, "leaf-order").select("tree", "position", "total", "node", "row")
    blocks = _tree(placed, "merkle")
    subroots = blocks[-1].select("tree", F.col("root").alias("node"))
    ordered = numbered(subroots, [], [F.col("tree")], "group-order")
    tops = _tree(ordered.select(F.lit("").alias("tree"), "position", "total", "node", F.col("tree").alias("row")), "merkle-top")
    root = tops[-1].select("tree", F.lit(None).cast("string").alias("subroot"), "root",
                           F.array().cast(SIBLINGS).alias("proof"))
    above = _proved(tops, root).select(F.col("row").alias("tree"), F.col("node").alias("subroot"), "root", "proof")
    return _proved(blocks, stored(above, "merkle-proofs")).select("row", F.col("node").alias("leaf"), "proof", "subroot", "root")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, step: digest(F.concat(step["before"], node, step["after"])))


def document_fields(text: Column) -> list[Column]:
    return [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]


def documents_manifest(documents: DataFrame) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of documents, some of them tampered with.

    Rows whose id has an even checksum lose the line ends of their text before their leaf is recomputed and folded
    with the proof of the untampered tree; null texts stay null, and null ids are left alone. Columns besides
    doc_id, source, lang, n_chars and text take no part. Repeated rows are leaves of their own. Very long texts only
    pass through the hash of their row.
    """
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(changed, leaf_digest(document_fields(F.replace("text", F.lit("\n"), F.lit("")))))
    proofs = manifest(
        documents, F.col("source"), [F.col("doc_id")], leaf_digest(document_fields(F.col("text"))),
        F.struct("doc_id", tampered.alias("tampered")),
    )
    siblings = F.array_join(F.transform("proof", lambda step: F.concat(step["before"], step["after"])), "")
    found = proofs.withColumn("folded_root", folded(F.coalesce("row.tampered", "leaf"), F.col("proof")))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "leaf", "subroot", "root", digest(siblings.cast("binary")).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )
