"""Merkle manifest of a table in blocks of van Emde Boas layout.

Every row is a leaf.  The leaves of one language form a binary tree in the
order of ``doc_id``; the roots of the languages form the tree above.  A tree is
cut into aligned subtrees of ``HEIGHT`` levels below their root.  A block holds
one subtree, its nodes ordered by splitting it at half height, the upper half
first and the lower subtrees behind it one by one, each split in turn: any path
to a leaf lies in few runs of bytes, whatever the size of a page.  ``address``
computes a node's place; nothing stores child pointers.

The roots of the blocks are the leaves of the next tier, until a tree is one
block.  Paths go the other way: a block hands each of its leaves the siblings
above it, so a leaf meets one block of its own and one list of siblings.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wearline.llm.common import store

#: Levels below the root of a block: 4096 leaves, 8191 digests of 32 bytes.
HEIGHT = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: The tree of the language roots; languages are ``-`` (null) or ``=`` and the name, in the order asked for.
TOP = "*"

_BLOCK = "tree string, block long, n long, height int, nodes binary, root binary"
_PATH = "tree string, block long, above binary"


def address(levels: int, depth: int, index):
    """Place of node ``index`` of ``depth`` (root: 0) in the layout of a complete tree of ``levels`` levels."""
    at = 0
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        bottom, depth = levels - top, depth - top
        at = at + (1 << top) - 1 + (index >> depth) * ((1 << bottom) - 1)
        index = index & ((1 << depth) - 1)
        levels = bottom
    return at + index * 0


def _join(nodes: list[bytes]) -> bytes:
    return sha256("".join(x.hex() for x in nodes).encode()).digest()


def _height(n: int) -> int:
    """Levels below the root of a tree of ``n`` leaves."""
    return (n - 1).bit_length()


def build_subtree(leaves: list[bytes], height: int) -> tuple[np.ndarray, bytes]:
    """Nodes of an aligned subtree in its layout (absent ones are zero), and its root."""
    nodes = np.zeros(((2 << height) - 1, 32), np.uint8)
    level = leaves
    for depth in range(height, -1, -1):
        nodes[address(height + 1, depth, np.arange(len(level)))] = np.frombuffer(b"".join(level), np.uint8).reshape(-1, 32)
        if depth:
            level = [_join(level[i : i + 2]) for i in range(0, len(level), 2)]
    return nodes, level[0]


def sibling_lists(nodes: np.ndarray, height: int, count: int) -> list[list[bytes]]:
    """Of each of the ``count`` leaves: the siblings on its path inside the block, from below."""
    index, live = np.arange(count), count
    found = [[] for _ in range(count)]
    for depth in range(height, 0, -1):
        other = index ^ 1
        there = other < live
        rows = nodes[address(height + 1, depth, other)]
        for i in np.flatnonzero(there):
            found[i].append(rows[i].tobytes())
        index, live = index >> 1, (live + 1) >> 1
    return found


def fold(digest: bytes, position: int, n: int, siblings: list[bytes]) -> tuple[bytes, list[bytes]]:
    """Root of a tree of ``n`` leaves from one leaf and its siblings; also the siblings not used."""
    at = 0
    while n > 1:
        if position ^ 1 < n:
            pair = [siblings[at], digest] if position & 1 else [digest, siblings[at]]
            at += 1
            digest = _join(pair)
        else:
            digest = _join([digest])
        position, n = position >> 1, (n + 1) >> 1
    return digest, siblings[at:]


def _leaf(**changed: Column) -> Column:
    def field(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.encode(F.concat(*[field(c) for c in FIELDS]), "UTF-8"), 256))


def _placed(leaves: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``pos``, from 0 in each tree by ``order``, and ``n``, the leaves of the tree.

    A tree may hold any share of the rows: Spark deals sorted ranges, each is
    numbered by itself and shifted by the tree's rows in earlier ranges.
    """
    ranged = leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "_tie")
    ranged = store(ranged.withColumn("_range", F.spark_partition_id()), "merkle-ranges")
    sizes = ranged.groupBy("tree", "_range").agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy("tree").orderBy("_range")
    starts = sizes.select(
        "tree", "_range", (F.sum("_size").over(earlier) - F.col("_size")).alias("_from"),
        F.sum("_size").over(Window.partitionBy("tree")).alias("n"))
    own = Window.partitionBy("tree", "_range").orderBy(*order, "_tie")
    numbered = ranged.withColumn("_rank", F.row_number().over(own) - 1).join(starts, ["tree", "_range"])
    return numbered.withColumn("pos", F.col("_from") + F.col("_rank")).drop("_tie", "_range", "_rank", "_from")


def _blocks(leaves: DataFrame, height: int) -> DataFrame:
    """The blocks over ``leaves`` (tree, pos, n, digest)."""
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n, block = table.column("n")[0].as_py(), table.column("block")[0].as_py()
        levels = height if n > 1 << height else _height(n)
        nodes, root = build_subtree(table.column("digest").to_pylist(), levels)
        return pa.table({
            "tree": pa.array([table.column("tree")[0].as_py()], pa.string()), "block": pa.array([block], pa.int64()),
            "n": pa.array([n], pa.int64()), "height": pa.array([levels], pa.int32()),
            "nodes": pa.array([nodes.tobytes()], pa.binary()), "root": pa.array([root], pa.binary())})

    keyed = leaves.select("tree", F.shiftright("pos", height).alias("block"), "pos", "n", "digest")
    return keyed.groupBy("tree", "block").applyInArrow(build, _BLOCK)


def _tiers(leaves: DataFrame, height: int) -> list[DataFrame]:
    """Blocks of the trees, tier by tier; a tree ends with the tier in which it is one block."""
    tiers = [store(_blocks(leaves, height), "merkle-tier")]
    while not (tall := tiers[-1].where(F.col("n") > 1 << height)).isEmpty():
        above = F.ceil(F.col("n") / F.lit(1 << height)).cast("long")
        roots = tall.select("tree", F.col("block").alias("pos"), above.alias("n"), F.col("root").alias("digest"))
        tiers.append(store(_blocks(roots, height), "merkle-tier"))
    return tiers


def _roots(tiers: list[DataFrame], height: int) -> DataFrame:
    out = None
    for tier in tiers:
        done = tier.where(F.col("n") <= 1 << height).select("tree", F.col("root").alias("subroot"))
        out = done if out is None else out.unionByName(done)
    return out


def _hand_down(blocks: DataFrame, height: int) -> DataFrame:
    """(tree, block, above): blocks (with the siblings ``above`` them) give each of their leaves its own."""
    def hand_down(batches):
        for batch in batches:
            for row in batch.to_pylist():
                nodes = np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32)
                first = row["block"] << height
                lists = sibling_lists(nodes, row["height"], min(1 << height, row["n"] - first))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["tree"]] * len(lists), pa.string()), pa.array(np.arange(first, first + len(lists))),
                     pa.array([b"".join(s) + row["above"] for s in lists], pa.binary())], names=["tree", "block", "above"])

    return blocks.select("tree", "block", "n", "height", "nodes", "above").mapInArrow(hand_down, _PATH)


def _paths(tiers: list[DataFrame], tops: DataFrame, height: int) -> DataFrame:
    """The blocks of the lowest tier with the siblings ``above`` each, from below, one after the other.

    ``tops`` (tree, above): the siblings above each tree.
    """
    handed = None
    for k in range(len(tiers) - 1, -1, -1):
        above = tiers[k].where(F.col("n") <= 1 << height).select("tree", "block").join(tops, "tree")
        if handed is not None:
            above = above.unionByName(handed)
        blocks = tiers[k].join(above, ["tree", "block"])
        if k == 0:
            return blocks
        handed = store(_hand_down(blocks, height), "merkle-paths")
    raise ValueError("no tier")


@dataclass
class Manifest:
    """``leaves``: tree, pos, n, digest and the columns kept; ``tiers`` and ``top``: blocks of the
    language trees and of the tree above; ``languages``: tree, subroot, top_pos, top_n, root."""

    leaves: DataFrame
    tiers: list[DataFrame]
    top: list[DataFrame]
    languages: DataFrame
    height: int


def build(docs: DataFrame, height: int = HEIGHT, also: dict[str, Column] | None = None) -> Manifest:
    """Manifest of ``docs`` (the columns of documents; others are not covered).

    Null, empty and long values are leaves like others.  Leaves of one
    ``doc_id`` (null first) are ordered by digest, so repeated rows have equal
    digests at neighbouring places.  A table without rows has no tree.
    ``also``: further columns to keep with the leaves.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("-"))
    leaves = docs.select(tree.alias("tree"), "doc_id", _leaf().alias("digest"), *[c.alias(name) for name, c in (also or {}).items()])
    leaves = store(_placed(leaves, ["doc_id", "digest"]), "merkle-leaves")
    tiers = _tiers(leaves, height)
    roots = _roots(tiers, height)
    named = roots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("lang_tree"), F.col("subroot").alias("digest"))
    named = store(_placed(named, ["lang_tree"]), "merkle-languages")
    top = _tiers(named, height)
    root = _roots(top, height).select(F.col("tree").alias("_top"), F.col("subroot").alias("root"))
    languages = named.join(root, F.col("tree") == F.col("_top")).select(
        F.col("lang_tree").alias("tree"), F.col("digest").alias("subroot"), F.col("pos").alias("top_pos"), F.col("n").alias("top_n"), "root")
    return Manifest(leaves, tiers, top, store(languages, "merkle-roots"), height)


def verify(manifest: Manifest, claimed: str = "digest") -> DataFrame:
    """Proof of every leaf, and the root that its digest in column ``claimed`` (null: its own) folds to.

    doc_id, leaf, subroot, root, proof_sha256, folded_root (lower-case hex) and
    ``verified``; rows repeated come as often as they are in the table.
    """
    height = manifest.height
    bare = manifest.top[0].select("tree").distinct().withColumn("above", F.lit(b""))
    above = _hand_down(_paths(manifest.top, bare, height), height).select(F.col("block").alias("top_pos"), "above")
    languages = store(manifest.languages.join(above, "top_pos"), "merkle-paths")
    blocks = _paths(manifest.tiers, languages.select("tree", "above"), height).drop("root")
    blocks = blocks.join(languages.select("tree", "subroot", "root", "top_pos", "top_n"), "tree")
    leaves = manifest.leaves.select(
        "tree", F.shiftright("pos", height).alias("block"), "pos", "doc_id", "digest", F.coalesce(claimed, "digest").alias("claimed"))
    id_type = leaves.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def prove(rows: pa.Table, block: pa.Table) -> pa.Table:
        rows, b = rows.sort_by("pos"), block.to_pylist()[0]
        lists = sibling_lists(np.frombuffer(b["nodes"], np.uint8).reshape(-1, 32), b["height"], rows.num_rows)
        higher = [b["above"][i : i + 32] for i in range(0, len(b["above"]), 32)]
        proofs, folded = [], []
        for own, position, digest in zip(lists, rows.column("pos").to_pylist(), rows.column("claimed").to_pylist(), strict=True):
            siblings = own + higher
            proofs.append(_join(siblings).hex())
            digest, left = fold(digest, position, b["n"], siblings)
            folded.append(fold(digest, b["top_pos"], b["top_n"], left)[0].hex())
        root, count = b["root"].hex(), rows.num_rows
        return pa.table({
            "doc_id": rows.column("doc_id"), "leaf": pa.array([x.hex() for x in rows.column("digest").to_pylist()], pa.string()),
            "subroot": pa.array([b["subroot"].hex()] * count, pa.string()), "root": pa.array([root] * count, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(folded, pa.string()),
            "verified": pa.array([x == root for x in folded], pa.bool_())})

    return leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(prove, schema)


def tampered_by_one(divisor: int) -> Column:
    """Leaf with 1 added to ``n_chars`` where ``divisor`` divides the CRC-32 of the decimal doc_id; else null.

    A null ``n_chars`` stays null, so its leaf is the same; a null doc_id is left alone.
    """
    hit = F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(divisor)) == 0
    return F.when(hit, _leaf(n_chars=F.col("n_chars").cast("decimal(20,0)") + 1))
