"""Prefix trie of conversations by a splitter skeleton.

A node is a distinct sequence of first turns; conversations that start with it are its members. A turn is its 128-bit digest of
role and text, and the number of words of the text.

1. *Sorted shards.* Conversations are range-partitioned and sorted by (turns, ``conv_id``). Copies of a conversation differ in the last key, so
   that a very common one is many shards, not one.
2. *Skeleton.* The first path of each shard is its splitter. A node with members in several shards is a prefix of a splitter: the
   trie of the splitters' paths (shards times ``SEGMENT`` digests at most) goes to all tasks.
3. *Local nodes.* A task reads its shard once with a stack of open nodes. A node off the skeleton closes with all its
   members seen and is final, but for the name of a parent on the skeleton.
4. *Reduction.* A node on the skeleton gives a partial row in each of its shards; these are summed by node, rolled up along the
   skeleton (of the same bounded size), and joined to the rows that wait for a parent's name. The ids of conversations that end in such a node
   come as pieces of text, and one stream per node hashes them in order.
5. *Long conversations* are cut into segments of ``SEGMENT`` turns. The first segments make one trie; nodes at its end with two or
   more members that go on are roots of tries of second segments, and so on as far as prefixes are shared. Totals of a lower
   trie come up to the node that it hangs from. Turns beyond all shared segments are nodes of a single member, made straight from their rows.

Defined results: turns are ordered by ``turn`` (null first), those of equal number by their digest; a null role or text is empty; rows with
a null ``conv_id`` take no part; repeated rows are turns of their own; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import count_words, cut, numbered

SEGMENT, PIECE = 512, 1 << 16
FAMILY, SHARED = 20, 4

NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_FOUND = ("kind int, e long, depth int, conv long, parent long, j int, d int, n long, children long, leaves long, saved long, words int, "
          "ends string, part int, seq int")
_FIELDS = [f.split()[0] for f in _FOUND.split(", ")]
_TYPES = [{"int": pa.int32(), "long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in _FOUND.split(", ")]
FINAL, PARTIAL, ENDS = 0, 1, 2


def turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, n, key, words)``: the turns of each conversation in order, and how many it has."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), key.alias("key"),
        count_words(text).cast("int").alias("words")).withColumn("salt", F.monotonically_increasing_id())
    return cut(numbered(cut(rows), "conv_id", ["turn", "key", "salt"]).select("conv_id", "pos", "n", "key", "words"))


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv_id, depth, key, words)`` of conversations that take their first turns from another one, and ``(conv_id, length)`` of all.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % FAMILY`` and goes on with its own after its first ``h``; ``h`` is
    the CRC-32 of its decimal id, modulo ``SHARED``.
    """
    c = F.col("conv_id")
    convs = own.filter("pos = 0").select("conv_id", "n", (c - c % FAMILY).alias("of"), (F.crc32(c.cast("string").cast("binary")) % SHARED).alias("h"))
    sizes = own.filter("pos = 0").select(F.col("conv_id").alias("of"), F.col("n").alias("of_n"))
    convs = cut(convs.join(sizes, "of", "left").withColumn("given", F.least("h", F.coalesce("of_n", F.lit(0)))))
    heads = own.filter(F.col("pos") < SHARED - 1).select(F.col("conv_id").alias("of"), "pos", "key", "words")
    given = convs.join(heads, "of").filter("pos < h").select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "words")
    rest = own.drop("n").join(convs.select("conv_id", "h", "given"), "conv_id").filter("pos >= h").select(
        "conv_id", (F.col("given") + F.col("pos") - F.col("h") + 1).alias("depth"), "key", "words")
    length = F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return given.unionByName(rest), convs.select("conv_id", length.cast("long").alias("length"))


# ---------------------------------------------------------------- one trie

def _common(a: tuple, b: tuple) -> int:
    """Depth of the deepest node that two (root, path) share; -1 if not even the root."""
    if a[0] != b[0]:
        return -1
    k, n = 0, min(len(a[1]), len(b[1]))
    while k < n and a[1][k] == b[1][k]:
        k += 1
    return k


class Skeleton:
    """The trie of the splitters: node ``(j, d)`` is the first ``d`` turns of splitter ``j``, the first splitter with these."""

    def __init__(self, splitters: list[tuple]):
        self.splitters = splitters
        self.common = [-1, *(_common(a, b) for a, b in zip(splitters, splitters[1:], strict=False))]
        self.first: list[list[int]] = []
        for j, (_, path) in enumerate(splitters):
            shared = self.common[j] + 1
            self.first.append((self.first[j - 1][:shared] if shared else []) + [j] * (len(path) + 1 - shared))

    def depths(self, shard: int, row: tuple) -> tuple[int, int]:
        """How deep a row of a shard shares nodes with the shard's splitter and with the next; no other splitter shares more."""
        after = shard + 1 < len(self.splitters)
        return _common(row, self.splitters[shard]), _common(row, self.splitters[shard + 1]) if after else -1

    def node(self, shard: int, depths: tuple[int, int], d: int) -> tuple[int, int] | None:
        if d <= depths[0]:
            return self.first[shard][d], d
        return (self.first[shard + 1][d], d) if d <= depths[1] else None


class _Open:
    __slots__ = ("conv", "n", "children", "leaves", "saved", "words", "ends", "held", "seq", "on", "kids")

    def __init__(self, words: int, on, conv: int | None):
        self.conv, self.n, self.children, self.leaves, self.saved, self.words = conv, 0, 0, 0, 0, words
        self.ends, self.held, self.seq, self.on, self.kids = [], 0, 0, on, []


class _Shard:
    """The trie of one shard, from its rows in order."""

    def __init__(self, skeleton: Skeleton, shards: dict[int, int]):
        self.skeleton, self.shards = skeleton, shards
        self.stack: list[_Open] = []
        self.last, self.part, self.out = None, None, []

    def add(self, r: dict) -> None:
        row = (r["e"], r["path"])
        if self.part != r["part"]:
            self.end()
            self.part = r["part"]
        same = _common(self.last, row) if self.last else -1
        while len(self.stack) > same + 1:
            self._close()
        if len(self.stack) <= len(r["path"]):
            depths = self.skeleton.depths(self.shards[self.part], row)
            for d in range(len(self.stack), len(r["path"]) + 1):
                self.stack.append(_Open(r["words"][d - 1] if d else 0, self.skeleton.node(self.shards[self.part], depths, d), None if d else r["root"]))
        top, self.last = self.stack[-1], row
        top.n += 1
        top.conv = r["conv_id"] if top.conv is None else min(top.conv, r["conv_id"])
        if r["more"]:
            top.children, top.leaves, top.saved = top.children + r["x_children"], top.leaves + r["x_leaves"], top.saved + r["x_saved"]
        else:
            top.ends.append(str(r["conv_id"]))
            top.held += len(top.ends[-1])
            if top.on and top.held > PIECE:
                self._give_ends(top)

    def end(self) -> None:
        while self.stack:
            self._close()
        self.last = None

    def _give(self, **values) -> None:
        self.out.append(values)

    def _give_ends(self, node: _Open) -> None:
        self._give(kind=ENDS, j=node.on[0], d=node.on[1], ends=",".join(node.ends), part=self.part, seq=node.seq)
        node.ends, node.held, node.seq = [], 0, node.seq + 1

    def _close(self) -> None:
        depth, node, e = len(self.stack) - 1, self.stack.pop(), self.last[0]
        above = self.stack[-1] if self.stack else None
        if above is not None:
            above.n += node.n
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
        if node.on:
            if node.ends:
                self._give_ends(node)
            self._give(kind=PARTIAL, e=e, depth=depth, conv=node.conv, j=node.on[0], d=node.on[1], n=node.n, children=node.children, leaves=node.leaves,
                       saved=node.saved, words=node.words)
            return
        for kid in node.kids:
            self._give(**kid, parent=node.conv)
        saved, leaves = node.saved + (node.n - 1) * node.words, node.leaves if node.children else 1
        mine = {"kind": FINAL, "e": e, "depth": depth, "conv": node.conv, "n": node.n, "children": node.children, "leaves": leaves, "saved": saved,
                "ends": hashlib.sha256(",".join(node.ends).encode()).hexdigest()}
        if above is None:
            self._give(**mine)
            return
        above.children, above.leaves, above.saved = above.children + 1, above.leaves + leaves, above.saved + saved
        if above.on:
            self._give(**mine, j=above.on[0], d=above.on[1])
        else:
            above.kids.append(mine)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f) for r in rows], t) for f, t in zip(_FIELDS, _TYPES, strict=True)], _FIELDS)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by node, shard and number -> the digest of each node's pieces, held one at a time."""
    now, state, out = None, None, []
    for batch in batches:
        for r in batch.to_pylist():
            if now == (r["j"], r["d"]):
                state.update(b",")
            else:
                if now:
                    out.append((*now, state.hexdigest()))
                now, state = (r["j"], r["d"]), hashlib.sha256()
            state.update(r["ends"].encode())
    if now:
        out.append((*now, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))], ["j", "d", "ends"])


def trie(rows: DataFrame) -> DataFrame:
    """All nodes of some tries: ``(e, depth, conv, parent, n, children, leaves, saved, ends)``.

    ``rows(e, conv_id, path, words, root, more, x_children, x_leaves, x_saved)``: a path below root ``e``; ``root``: the name of the root if it is not
    its smallest member; ``more``: the conversation goes on below the path, and there the totals ``x_…`` wait.
    """
    spark = rows.sparkSession
    order = ["e", "path", "conv_id"]
    placed = cut(cut(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    firsts = sorted(placed.groupBy("part").agg(F.min(F.struct(*order)).alias("at")).collect(), key=lambda r: r["part"])
    shards = {r["part"]: j for j, r in enumerate(firsts)}
    skeleton = Skeleton([(r["at"]["e"], [bytes(k) for k in r["at"]["path"]]) for r in firsts])
    sent = spark.sparkContext.broadcast((skeleton, shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(*sent.value)
        for batch in batches:
            for r in batch.to_pylist():
                shard.add(r)
            if len(shard.out) > 5000:
                yield _batch(shard.out)
                shard.out = []
        shard.end()
        yield _batch(shard.out)

    found = cut(placed.mapInArrow(run, _FOUND))
    partial = found.filter(F.col("kind") == PARTIAL).groupBy("j", "d").agg(
        F.max("e").alias("e"), F.min("conv").alias("conv"), F.max("words").alias("words"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")])
    bones = _rolled_up(skeleton, [r.asDict() for r in partial.collect()])
    names = ["j", "d", "e", "depth", "conv", "parent", "n", "children", "leaves", "saved"]
    table = spark.createDataFrame([tuple(b[c] for c in names) for b in bones],
                                  "j int, d int, e long, depth int, conv long, parent long, n long, children long, leaves long, saved long")
    ends = found.filter(F.col("kind") == ENDS).select("j", "d", "part", "seq", "ends").repartition("j", "d").sortWithinPartitions(
        "j", "d", "part", "seq").mapInArrow(_hashed, "j int, d int, ends string")
    out = ["e", "depth", "conv", "parent", "n", "children", "leaves", "saved", "ends"]
    on_skeleton = table.join(ends, ["j", "d"], "left").withColumn("ends", F.coalesce("ends", F.sha2(F.lit("").cast("binary"), 256))).select(*out)
    local = found.filter(F.col("kind") == FINAL).select(*out, "j", "d")
    name = F.broadcast(table.select("j", "d", F.col("conv").alias("above")))
    local = local.join(name, ["j", "d"], "left").withColumn("parent", F.coalesce("parent", "above")).select(*out)
    return cut(local.unionByName(on_skeleton))


def _rolled_up(skeleton: Skeleton, rows: list[dict]) -> list[dict]:
    """Totals along the skeleton, deepest nodes first, and each node's parent."""
    at = {(r["j"], r["d"]): r for r in rows}
    up = {(j, d): (skeleton.first[j][d - 1], d - 1) if d else None for j, d in at}
    for key in sorted(at, key=lambda k: -k[1]):
        r, above = at[key], at.get(up[key])
        r["depth"] = key[1]
        r["saved"] += (r["n"] - 1) * r["words"]
        r["leaves"] = r["leaves"] if r["children"] else 1
        r["parent"] = above["conv"] if above else None
        if above:
            above["children"], above["leaves"], above["saved"] = above["children"] + 1, above["leaves"] + r["leaves"], above["saved"] + r["saved"]
    return rows


# ---------------------------------------------------------------- tries of segments

def _segments(rows: DataFrame, convs: DataFrame, segment: int) -> DataFrame:
    """``(conv_id, s, path, words, more)``: pieces of ``segment`` turns, the first of each conversation even if it is empty."""
    s = F.floor((F.col("depth") - 1) / segment).cast("long").alias("s")
    parts = rows.groupBy("conv_id", s).agg(F.array_sort(F.collect_list(F.struct("depth", "key", "words"))).alias("t")).select(
        "conv_id", "s", F.col("t.key").alias("path"), F.col("t.words").alias("words"))
    first = convs.filter("length = 0").select("conv_id", F.lit(0).cast("long").alias("s"), F.lit([]).cast("array<binary>").alias("path"),
                                               F.lit([]).cast("array<int>").alias("words"))
    return parts.unionByName(first).join(convs, "conv_id").select("conv_id", "s", "path", "words", (F.col("length") > (F.col("s") + 1) * segment).alias("more"))


def nodes(rows: DataFrame, convs: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """``rows(conv_id, depth, key, words)`` with depths from 1, ``convs(conv_id, length)`` -> the nodes of their trie, ``NODES``."""
    rows, convs = cut(rows), cut(convs)
    pieces = cut(_segments(rows, convs, segment))
    none = F.lit(None).cast("long")
    layers, tails = [pieces.filter("s = 0").select("conv_id", "path", "words", "more", F.lit(0).cast("long").alias("e"), none.alias("root"))], []
    while not (on := layers[-1].filter("more")).isEmpty():
        node = F.md5(F.concat_ws("", F.transform("path", F.hex)))
        whole = layers[-1].filter(F.size("path") == segment).select("conv_id", "e", "more", node.alias("node"))
        ends = whole.groupBy("e", "node").agg(F.min("conv_id").alias("root"), F.min(F.when(F.col("more"), F.col("conv_id"))).alias("next_e"),
                                              F.count_if("more").alias("count")).filter("count > 0")
        going = cut(on.select("conv_id", "e", node.alias("node")).join(ends, ["e", "node"]).select("conv_id", F.col("next_e").alias("e"), "root", "count"))
        tails.append((len(layers), going.filter("count = 1").select("conv_id", "root")))
        layers.append(cut(pieces.filter(F.col("s") == len(layers)).join(going.filter("count > 1").drop("count"), "conv_id").select(
            "conv_id", "path", "words", "more", "e", "root")))
    out, below = [], None
    for s in range(len(layers) - 1, -1, -1):
        layer = layers[s]
        if below is not None:
            layer = layer.join(below, "conv_id", "left")
            shared = going_on(layers[s + 1])
            layer = layer.join(shared, "conv_id", "left")
            zero = F.when(F.col("shared"), F.lit(0)).otherwise(F.lit(1))
            layer = layer.withColumns({"x_children": F.coalesce("x_children", zero), "x_leaves": F.coalesce("x_leaves", zero),
                                       "x_saved": F.coalesce("x_saved", F.lit(0).cast("long"))}).drop("shared")
        else:
            layer = layer.withColumns({"x_children": F.lit(1).cast("long"), "x_leaves": F.lit(1).cast("long"), "x_saved": F.lit(0).cast("long")})
        found = trie(layer)
        below = found.filter("depth = 0").select(F.col("e").alias("conv_id"), F.col("children").alias("x_children"), F.col("leaves").alias("x_leaves"),
                                                 F.col("saved").alias("x_saved"))
        out.append(found.filter("depth > 0" if s else "true").select(
            F.col("conv").alias("conv_id"), (F.col("depth") + s * segment).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"),
            F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
            F.col("ends").alias("ends_sha256")))
    for s, alone in tails:
        last, one = F.col("depth") == F.col("length"), F.lit(1).cast("long")
        sha: Column = F.sha2(F.when(last, F.col("conv_id").cast("string")).otherwise("").cast("binary"), 256)
        out.append(rows.filter(F.col("depth") > s * segment).join(alone, "conv_id").join(convs, "conv_id").select(
            "conv_id", F.col("depth").cast("long").alias("depth"), F.when(F.col("depth") == s * segment + 1, F.col("root")).otherwise(F.col("conv_id")).alias(
                "parent_conv_id"), one.alias("n_convs"), F.when(last, F.lit(0)).otherwise(F.lit(1)).cast("long").alias("n_children"), one.alias("n_leaves"),
            F.lit(0).cast("long").alias("saved_tokens"), sha.alias("ends_sha256")))
    first, *rest = out
    for part in rest:
        first = first.unionByName(part)
    return first


def going_on(layer: DataFrame) -> DataFrame:
    return layer.select("conv_id", F.lit(True).alias("shared"))


def conversation_trie(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The nodes of the trie of ``conversations(conv_id, turn, role, text)``, as they are."""
    own = turns(conversations)
    return nodes(own.select("conv_id", (F.col("pos") + 1).alias("depth"), "key", "words"),
                 own.filter("pos = 0").select("conv_id", F.col("n").alias("length")), segment)


def rebuilt_trie(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """The nodes of the trie of the conversations that ``rebuilt`` makes."""
    return nodes(*rebuilt(turns(conversations)), segment)
