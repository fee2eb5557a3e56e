"""Merkle manifest of a dataset: a digest of every row, a tree of digests per language, one root over all.

A row's digest is the SHA-256 of its columns, each as ``-`` if null, else as its number of UTF-8 bytes, ``:`` and value. Digests
are hashed as lower-case hexadecimal text. The rows of a language ascend by ``doc_id``; while several nodes remain, each run of
``ARITY`` becomes their digest (the last run may be shorter, even a single node). The languages' subroots, null first and then
bytewise, make the root likewise.

* *Positions.* Digests are range-partitioned by (language, ``doc_id``, digest), sorted in their range and written; counts per range
  and language turn the place in a range into a position in the language. No task sees more than its range.
* *Blocks.* ``ARITY ** HEIGHT`` consecutive nodes with all levels above them up to one root are a block: an aligned subtree that one
  task builds. Its nodes are a single array in van Emde Boas order: the tree is split at half its height, the top part is
  stored first and then each bottom part, all of them by the same rule. ``addresses`` gives the place of a node by
  arithmetic alone, for building as for reading siblings, and any size of cache line or page holds whole subtrees.
* *Recursion.* Block roots are the nodes of the next level of blocks, ``ARITY ** HEIGHT`` times fewer, until a tree is one block.
* *Proofs.* From the top down each block gets the siblings of its own root; a row's proof is the siblings in its block and
  those of the block. A task reads a block once for all its rows; no row carries a proof through a shuffle.

Defined results: a null ``lang`` is a language of its own; null ids come first; rows that repeat an id are ordered by their digest; equal
rows are leaves of their own; other columns take no part; an empty table gives no rows and no root.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .common import cut, numbered

ARITY, HEIGHT = 8, 4
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def row_digest(values: dict[str, Column]) -> Column:
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values.values()]
    return F.sha2(F.concat(*parts), 256)


def digest(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


@functools.cache
def addresses(height: int, arity: int = ARITY) -> tuple[np.ndarray, ...]:
    """Places in van Emde Boas order of the nodes of a complete tree, by levels from the root to ``height`` below it."""
    def place(levels: int, depth: int, i: np.ndarray) -> np.ndarray:
        if levels == 1:
            return np.zeros(len(i), np.int64)
        top = levels // 2
        if depth < top:
            return place(top, depth, i)
        below = arity ** (depth - top)
        return nodes_of(top - 1, arity) + i // below * nodes_of(levels - top - 1, arity) + place(levels - top, depth - top, i % below)

    return tuple(place(height + 1, d, np.arange(arity ** d)) for d in range(height + 1))


def nodes_of(height: int, arity: int = ARITY) -> int:
    return (arity ** (height + 1) - 1) // (arity - 1)


def levels_of(n: int, arity: int = ARITY) -> int:
    """Levels above ``n`` nodes until one remains."""
    count = 0
    while n > 1:
        n, count = -(-n // arity), count + 1
    return count


class Block:
    """An aligned subtree of ``height`` levels over ``n`` nodes; ``store`` holds 32 bytes a node in van Emde Boas order."""

    def __init__(self, height: int, n: int, store: np.ndarray):
        self.at, self.height, self.n, self.store = addresses(height), height, n, store

    @classmethod
    def build(cls, nodes: list[str], height: int) -> Block:
        at, store, level = addresses(height), np.zeros((nodes_of(height), 32), np.uint8), nodes
        for depth in range(height, -1, -1):
            store[at[depth][:len(level)]] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, 32)
            level = [digest(level[i:i + ARITY]) for i in range(0, len(level), ARITY)] if depth else level
        return cls(height, len(nodes), store)

    def siblings(self) -> Iterator[str]:
        """For each node of the lowest level the digests of its siblings up to the root of the block, as one text."""
        paths = [""]
        for depth in range(1, self.height + 1):
            n = -(-self.n // ARITY ** (self.height - depth))
            text = self.store[self.at[depth][:n]].tobytes().hex()
            hexes = [text[i:i + 64] for i in range(0, 64 * n, 64)]
            paths = [self._rest(hexes, i) + paths[i // ARITY] for i in range(n)]
        yield from paths

    @staticmethod
    def _rest(level: list[str], i: int) -> str:
        run = i // ARITY * ARITY
        return "".join(level[run:i] + level[i + 1:run + ARITY])


def fold(node: str, places: list[tuple[int, int]], siblings: str) -> str:
    """The root over a node, from its ``(position, number of nodes)`` in each tree on its way and all its siblings."""
    at = 0
    for position, n in places:
        while n > 1:
            run = position // ARITY * ARITY
            left, size = 64 * (position - run), 64 * (min(ARITY, n - run) - 1)
            near = siblings[at:at + size]
            node = hashlib.sha256((near[:left] + node + near[left:]).encode()).hexdigest()
            at, position, n = at + size, position // ARITY, -(-n // ARITY)
    return node


# ---------------------------------------------------------------- trees

class Manifest(NamedTuple):
    """``leaves(tree, pos, n, doc_id, leaf, claimed)``; the blocks of the languages' trees and of the tree above them, level by level."""

    leaves: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    root: str | None


BLOCKS = "tree long, pos long, n long, members int, height int, nodes binary, node string"


def _blocks(nodes: DataFrame) -> DataFrame:
    """``nodes(tree, pos, n, node)`` -> their blocks: ``pos`` and ``n`` as a node of the next level, ``node`` the block's root."""
    size = ARITY ** HEIGHT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in W.same_key(batches, ["tree", "block"]):
            tree, block, n = (t.column(c)[0].as_py() for c in ("tree", "block", "n"))
            height = HEIGHT if n > size else levels_of(n)
            b = Block.build(t.column("node").to_pylist(), height)
            yield pa.RecordBatch.from_pylist([{
                "tree": tree, "pos": block, "n": -(-n // size), "members": b.n, "height": height, "nodes": b.store.tobytes(),
                "node": b.store[b.at[0][0]].tobytes().hex()}], schema=_SCHEMA)

    keyed = nodes.select("tree", F.floor(F.col("pos") / size).cast("long").alias("block"), "pos", "n", "node")
    return cut(keyed.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(run, BLOCKS))


_SCHEMA = pa.schema([("tree", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("members", pa.int32()), ("height", pa.int32()),
                     ("nodes", pa.binary()), ("node", pa.string())])


def _levels(nodes: DataFrame) -> list[DataFrame]:
    """Blocks of the trees of ``nodes``, then blocks over the roots of these, until each tree is one block."""
    out = [_blocks(nodes)]
    while not (more := out[-1].filter("n > 1").select("tree", "pos", "n", "node")).isEmpty():
        out.append(_blocks(more))
    return out


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def manifest(docs: DataFrame, claimed: dict[str, Column] | None = None, columns: tuple[str, ...] = COLUMNS) -> Manifest:
    """The manifest of ``docs``. ``claimed`` replaces columns: what ``verify`` is to hold against the manifest."""
    values = {c: F.col(c) for c in columns}
    leaves = cut(docs.select(
        F.col("lang").cast("string").alias("lang"), F.col("doc_id").cast("long").alias("doc_id"), row_digest(values).alias("leaf"),
        row_digest(values | (claimed or {})).alias("claimed")).withColumn("salt", F.monotonically_increasing_id()))
    langs = leaves.select("lang").distinct().withColumn("all", F.lit(0))
    trees = cut(numbered(langs, "all", ["lang"]).select("lang", F.col("pos").alias("tree")))
    leaves = cut(numbered(leaves, "lang", ["doc_id", "leaf", "salt"], trees).select("tree", "pos", "n", "doc_id", "leaf", "claimed"))
    levels = _levels(leaves.select("tree", "pos", "n", F.col("leaf").alias("node")))
    subroots = _union([x.filter("n = 1").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees.count()).alias("n"), "node")
                       for x in levels])
    top = _levels(subroots)
    root = top[-1].filter("n = 1").select("node").first()
    return Manifest(leaves, levels, top, root["node"] if root else None)


def _above(levels: list[DataFrame], down_to: int) -> DataFrame:
    """``(tree, pos, up)``: the siblings from each block of level ``down_to`` to the root of its tree; -1 stands for the nodes under level 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                paths = [p + r["up"] for p in _block(r).siblings()]
                first = r["pos"] * ARITY ** HEIGHT
                yield pa.RecordBatch.from_arrays([pa.array([r["tree"]] * len(paths), pa.int64()), pa.array(range(first, first + len(paths)), pa.int64()),
                                                  pa.array(paths, pa.string())], ["tree", "pos", "up"])

    up = None
    for level in range(len(levels) - 1, down_to, -1):
        blocks = levels[level].withColumn("up", F.lit(""))
        if up is not None:
            whole = levels[level].filter("n = 1").withColumn("up", F.lit(""))
            blocks = whole.unionByName(levels[level].filter("n > 1").join(up, ["tree", "pos"]).select(*levels[level].columns, "up"))
        up = cut(blocks.mapInArrow(run, "tree long, pos long, up string"))
    return up


def _block(row: dict) -> Block:
    return Block(row["height"], row["members"], np.frombuffer(row["nodes"], np.uint8).reshape(-1, 32))


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verify(m: Manifest) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)``: of each row its place in the manifest, the digest of
    its proof, and the root that its claimed digest and this proof give.
    """
    if m.root is None:
        return m.leaves.sparkSession.createDataFrame([], PROOFS)
    size = ARITY ** HEIGHT
    lowest = m.levels[0]
    inside = lowest.filter("n = 1").select("tree", "pos", "members", "height", "nodes", F.lit("").alias("up"))
    if len(m.levels) > 1:
        inside = inside.unionByName(lowest.filter("n > 1").join(_above(m.levels, 0), ["tree", "pos"]).select(*inside.columns))
    subroots = _union([x.filter("n = 1").select("tree", F.col("node").alias("subroot")) for x in m.levels])
    outside = _above(m.top, -1).select(F.col("pos").alias("tree"), F.col("up").alias("up_top")).join(subroots, "tree")
    n_trees = outside.count()
    heads = inside.join(outside, "tree").select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "members", "height", "nodes", "up",
                                                "up_top", "subroot")
    rows = m.leaves.select("tree", F.floor(F.col("pos") / size).cast("long").alias("block"), "pos", "n", "doc_id", "leaf", "claimed")
    root = m.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in W.same_key(batches, ["tree", "block"]):
            head, rest = t.slice(0, 1).to_pylist()[0], t.slice(1)
            paths = list(_block(head).siblings())
            place, n = rest.column("pos").to_pylist(), rest.column("n").to_pylist()
            proofs, folded = [], []
            for path, pos, count, node in zip(paths, place, n, rest.column("claimed").to_pylist(), strict=True):
                path += head["up"] + head["up_top"]
                proofs.append(hashlib.sha256(path.encode()).hexdigest())
                folded.append(fold(node, [(pos, count), (head["tree"], n_trees)], path))
            k = len(proofs)
            yield from pa.Table.from_arrays(
                [rest.column("doc_id"), rest.column("leaf"), pa.array([head["subroot"]] * k), pa.array([root] * k), pa.array(proofs), pa.array(folded),
                 pa.array([f == root for f in folded])], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]).to_batches()

    both = rows.unionByName(heads, allowMissingColumns=True)
    return both.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos").mapInArrow(run, PROOFS)
