"""A Merkle manifest of a table: a tree of hashes for each group of rows, their roots under one more tree, and proofs.

Leaves of a group stand in order; every two nodes in a row become one until one is left, and a last one without a
neighbour is hashed alone. Ranks come range by range, so a group with most of the rows is no task of its own. A tree is
cut into aligned blocks of HEIGHT levels, and the roots of its blocks are the leaves of the next layer of blocks.

A block is stored as one row whose nodes lie in van Emde Boas order: the upper half of the levels, then the trees
below it from left to right, each stored alike. Where a node lies follows from its level and number alone, and a walk
from a leaf to the root touches few stretches of memory whatever their size. Building and proofs use that address.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import written
from rollbook.operators.ranges import ranked

#: Levels of a block above its leaves.
HEIGHT = 12
ROWS_PER_RANGE = 8192
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
BLOCKS = "tree string, block long, total long, leaves int, nodes binary, root binary"
ALONE, LEFT, RIGHT = b"\0", b"\1", b"\2"


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where nodes `index` of a level (0: the root's) lie in a tree of so many levels."""
    at = np.zeros(len(index), np.int64)
    while levels > 1:
        upper = levels // 2
        if depth < upper:
            levels = upper
            continue
        levels -= upper
        depth -= upper
        at += (1 << upper) - 1 + (index >> depth) * ((1 << levels) - 1)
        index = index & ((1 << depth) - 1)
    return at


def joined(*digests: bytes) -> bytes:
    """The hash of digests one after another, each as hexadecimal text."""
    return sha256(b"".join(d.hex().encode() for d in digests)).digest()


def tree_height(total: int) -> int:
    """Levels above the leaves of a tree with so many of them."""
    return (total - 1).bit_length()


def block_height(total: int, layer: int, height: int) -> int:
    """Levels above the leaves of a block in a layer of blocks of so many levels."""
    return min(height, tree_height(total) - layer * height)


def built(digests: list[bytes], height: int) -> tuple[bytes, bytes]:
    """Nodes of a block over these leaves, in their stored order (zeros where there is none), and its root."""
    nodes = np.zeros(((2 << height) - 1, 32), np.uint8)
    for depth in range(height, -1, -1):
        nodes[address(height + 1, depth, np.arange(len(digests)))] = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
        root = digests[0]
        digests = [joined(*digests[i:i + 2]) for i in range(0, len(digests), 2)]
    return nodes.tobytes(), root


def paths(nodes: bytes, height: int, leaves: int, index: np.ndarray) -> list[bytes]:
    """For each leaf of `index` its neighbours up to the block's root: for every level a byte for their side, then the digest."""
    stored = np.frombuffer(nodes, np.uint8).reshape(-1, 32)
    out = [[] for _ in index]
    for level in range(height):
        own = index >> level
        other = own ^ 1
        there = other < -(-leaves // (1 << level))
        found = stored[address(height + 1, height - level, np.where(there, other, 0))]
        for path, has, digest, odd in zip(out, there.tolist(), found, (own & 1).tolist(), strict=True):
            path.append((LEFT if odd else RIGHT) + digest.tobytes() if has else ALONE)
    return [b"".join(x) for x in out]


def stepped(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(side, digest) of each level of a path."""
    at = 0
    while at < len(path):
        side = path[at:at + 1]
        yield side, path[at + 1:at + 33] if side != ALONE else b""
        at += 1 if side == ALONE else 33


def folded(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf has with these neighbours."""
    for side, digest in stepped(path):
        leaf = joined(leaf) if side == ALONE else joined(digest, leaf) if side == LEFT else joined(leaf, digest)
    return leaf


def proof(path: bytes) -> bytes:
    """The hash of all neighbours of a path."""
    return joined(*(digest for side, digest in stepped(path) if side != ALONE))


def leaf(**values: Column) -> Column:
    """The hash (binary) of values in their order: '-' for null, else the number of bytes, ':', and the value as text."""
    text = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.unhex(F.sha2(F.concat(*map(text, values.values())), 256))


@dataclass
class Manifest:
    """leaves: tree, key, digest, place (from 1), total, and what was carried; layers of blocks (tree, block, total, leaves,
    nodes, root) of the trees, lowest first; roots: tree, name, digest, place, total; top: the layers over the roots; blocks
    have `height` levels above their leaves."""

    leaves: DataFrame
    layers: list[DataFrame]
    roots: DataFrame
    top: list[DataFrame]
    height: int


def in_block(height: int) -> Column:
    return F.shiftright(F.col("place") - 1, height)


def blocks_of(layer: int, height: int):
    """One block of a layer from its leaves."""
    types = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("place")
        total, first = table["total"][0].as_py(), table["place"][0].as_py()
        nodes, root = built(table["digest"].to_pylist(), block_height(total, layer, height))
        row = (table["tree"][0].as_py(), (first - 1) >> height, total, len(table), nodes, root)
        return pa.table([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["tree", "block", "total", "leaves", "nodes", "root"])

    return run


def built_layers(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Layers of blocks over nodes (tree, place from 1, total of the tree's leaves, digest), each written once."""
    layers: list[DataFrame] = []
    while True:
        own = nodes.select("tree", "place", "total", "digest", in_block(height).alias("block"))
        layers.append(written(own.groupBy("tree", "block").applyInArrow(blocks_of(len(layers), height), BLOCKS), "blocks"))
        larger = layers[-1].where(~topmost(len(layers) - 1, height))
        if larger.isEmpty():
            return layers
        nodes = larger.select("tree", (F.col("block") + 1).alias("place"), "total", F.col("root").alias("digest"))


def topmost(layer: int, height: int) -> Column:
    """Whether a block of a layer is its tree's last one."""
    return F.col("total") <= F.lit(1 << (layer + 1) * height) if (layer + 1) * height < 62 else F.lit(True)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, by: str = "lang", order: str = "doc_id", carried: dict[str, Column] | None = None, height: int = HEIGHT) -> Manifest:
    """The trees over docs: one for each value of `by` (null is one), leaves in the order of `order` (nulls first), hashes of `fields`.

    Rows that agree in `order` stand in the order of their hashes; repeated rows stay, as leaves of their own. `carried`
    adds columns to leaves; blocks have `height` levels. An empty table gives no leaves, roots or blocks. Other columns are not read. Trees are known
    by their value behind a mark, so that null has a name (an empty one) and stands first.
    """
    carried = carried or {}
    name = F.col(by).cast("string")
    own = docs.select(F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("tree"), F.col(order).alias("key"), leaf(**{f: F.col(f) for f in fields}).alias("digest"), *(c.alias(k) for k, c in carried.items()))
    own = own.withColumn("_row", F.monotonically_increasing_id())
    leaves = written(ranked(own, ["tree"], ["key", "digest", "_row"], ROWS_PER_RANGE).drop("_row"), "leaves")
    layers = built_layers(leaves, height)
    tops = [layer.where(topmost(i, height)).select(F.col("tree").alias("name"), F.col("root").alias("digest")) for i, layer in enumerate(layers)]
    roots = written(ranked(reduce(DataFrame.unionAll, tops), [], ["name"], ROWS_PER_RANGE).withColumn("tree", F.lit("")), "roots")
    return Manifest(leaves, layers, roots, built_layers(roots, height), height)


def lifted(blocks: DataFrame, layer: int, height: int) -> DataFrame:
    """(tree, place, path, and the columns subroot and root) of each leaf of blocks that have path, subroot and root."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = row["leaves"]
                own = paths(row["nodes"], block_height(row["total"], layer, height), n, np.arange(n))
                place = (row["block"] << height) + np.arange(n) + 1
                yield pa.record_batch([pa.array([row["tree"]] * n), pa.array(place), pa.array([p + row["path"] for p in own], pa.binary()), pa.array([row["subroot"]] * n, pa.binary()), pa.array([row["top"]] * n, pa.binary())], ["tree", "place", "path", "subroot", "top"])

    return blocks.mapInArrow(run, "tree string, place long, path binary, subroot binary, top binary")


def with_paths(layers: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """The lowest blocks, with the path from their root to the top. above: tree, path, subroot, top of each tree's root."""
    blocks = None
    for i in range(len(layers) - 1, -1, -1):
        last = layers[i].where(topmost(i, height)).join(above, "tree")
        if blocks is not None:
            of_blocks = lifted(blocks, i + 1, height).withColumn("block", F.col("place") - 1).drop("place")
            last = last.unionByName(layers[i].where(~topmost(i, height)).join(of_blocks, ["tree", "block"]))
        blocks = last
    return blocks


def proofs(tree: Manifest, claimed: str = "digest") -> DataFrame:
    """Each leaf (key and carried columns, digest) with subroot, root, the hash of its neighbours (proof), and folded, the
    root that its column `claimed` has with those neighbours. All hashes are binary; nothing is left out."""
    height, one = tree.height, F.lit(None).cast("binary")
    start = tree.top[-1].where(topmost(len(tree.top) - 1, tree.height)).select("tree", F.lit(b"").alias("path"), one.alias("subroot"), F.col("root").alias("top"))
    of_roots = lifted(with_paths(tree.top, start, tree.height), 0, tree.height).drop("subroot", "tree")
    above = tree.roots.drop("tree").join(of_roots, "place").select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "top")
    blocks = with_paths(tree.layers, above, tree.height).select("tree", "block", "total", "leaves", "nodes", "path", "subroot", F.col("top").alias("root"))
    leaves = tree.leaves.withColumn("block", in_block(height))
    kept = [c for c in tree.leaves.columns if c not in ("tree", "place", "total")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tree.leaves.schema if f.name in kept)

    def run(rows: pa.Table, block: pa.Table) -> pa.Table:
        b = block.to_pylist()[0]
        index = rows["place"].to_numpy() - 1 - (b["block"] << height)
        whole = [p + b["path"] for p in paths(b["nodes"], block_height(b["total"], 0, height), b["leaves"], index)]
        out = rows.select(kept)
        for name, values in (("subroot", [b["subroot"]] * len(rows)), ("root", [b["root"]] * len(rows)), ("proof", map(proof, whole)), ("folded", map(folded, rows[claimed].to_pylist(), whole))):
            out = out.append_column(name, pa.array(list(values), pa.binary()))
        return out

    return leaves.groupBy("tree", "block").cogroup(blocks.groupBy("tree", "block")).applyInArrow(run, schema + ", subroot binary, root binary, proof binary, folded binary")
