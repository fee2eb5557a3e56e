"""Benchmark decontamination by suffix arrays over the training texts.

1. *Test suffixes.* A benchmark text becomes the sequence of its words' 64-bit hashes, cut into spans of ``SPAN`` window
   starts with the words that the last window needs. Spans are dealt into blocks of about ``BLOCK_WORDS`` words, whatever
   the benchmark's size; each block is sorted out once on the driver and sent to the tasks, and is one pass over the
   training texts.
2. *Training suffix arrays.* A task cuts its texts into shards of ``SHARD`` words and sorts the suffixes of each: words are
   numbered by the block's vocabulary, several numbers are packed into 64 bits, and the depth doubles for what is still
   tied. A word that the block has not ends every match, so suffixes that meet one before a window is complete are left
   out, and ties beyond it stay. A very long text gives several shards; a shard reads as many words of the next as the
   longest span has.
3. *Binary search.* All test suffixes are searched in a shard at once; the range of each narrows word by word until it is
   empty. The last range that was not is the suffix's longest verbatim match with all its places.
4. Places of whole windows mark words as hit and name the items; affected documents can then be removed. A row carries
   its own result, so nothing is shuffled when the benchmark is a single block; with more, only hit rows are.

Words are runs of letters, digits and non-ASCII characters after A-Z are lower-cased; a window is ``window`` consecutive
words of an item, or all words of an item that has fewer. Words are equal if two independent 64-bit hashes are: the second
one is taken of hit words only.

Defined results: a null text has no words; an item without words has no window; an item with a null ``item_id`` marks words
but names nothing; rows that repeat an ``item_id`` are one item; rows of documents are judged each, also those that repeat
a ``doc_id`` or have none; empty tables give no rows, or rows without hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import cut, text_key

WINDOW = 10
SPAN, BLOCK_WORDS, SHARD = 4096, 1 << 20, 1 << 18
PIECE = 2 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[:128] = True
_SEPARATOR[np.r_[48:58, 97:123]] = False


def word_hashes(column: pa.Array):
    """Hashes of the words of all texts, the text of each, and the bytes with the bounds of the words."""
    data, offsets = W.text_bytes(column)
    data = W.lower_ascii(data)
    starts, ends, doc = W.bounds(data, offsets, _SEPARATOR)
    return W.hash_spans(data, starts, ends, 1), doc, (data, starts, ends)


# ---------------------------------------------------------------- test suffixes

def spans(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``(item_id, start, n, size, one, two)``: both hashes of ``n`` words from word ``start``, and the window's size."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.pieces(batches, "text", PIECE):
            one, doc, (data, starts, ends) = word_hashes(part.column("text"))
            two = W.hash_spans(data, starts, ends, 2)
            edges = np.searchsorted(doc, np.arange(part.num_rows + 1)).tolist()
            for i, item in enumerate(part.column("item_id").to_pylist()):
                a, b = edges[i], edges[i + 1]
                size = min(window, b - a)
                if not size:
                    continue
                at = range(a, b - size + 1, SPAN)
                to = [min(b, x + SPAN + size - 1) for x in at]
                yield pa.RecordBatch.from_arrays([
                    pa.array([item] * len(to), pa.string()), pa.array([x - a for x in at], pa.int64()),
                    pa.array([y - x for x, y in zip(at, to, strict=True)], pa.int32()), pa.array([size] * len(to), pa.int32()),
                    *(pa.array([h[x:y].tobytes() for x, y in zip(at, to, strict=True)], pa.binary()) for h in (one, two))],
                    ["item_id", "start", "n", "size", "one", "two"])

    return benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).mapInArrow(
        emit, "item_id string, start long, n int, size int, one binary, two binary")


class Block:
    """The test suffixes of some spans: words as numbers of their own vocabulary, 0 after each span."""

    def __init__(self, rows: list):
        self.names = sorted({r["item_id"] for r in rows if r["item_id"] is not None})
        number = {name: i for i, name in enumerate(self.names)}
        one = np.concatenate([np.frombuffer(r["one"], np.uint64) for r in rows])
        two = np.concatenate([np.frombuffer(r["two"], np.uint64) for r in rows])
        self.vocabulary, first, ids = np.unique(one, return_index=True, return_inverse=True)
        self.second = two[first]
        self.bits = int(len(self.vocabulary)).bit_length()
        self.packed = max(1, 63 // self.bits)
        n = np.array([r["n"] for r in rows])
        size = np.array([r["size"] for r in rows])
        begin = np.cumsum(n + 1) - n - 1
        self.words = np.zeros(int((n + 1).sum()) + self.packed, np.int64)
        self.words[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n)] = ids + 1
        whole = n - size + 1
        span = np.repeat(np.arange(len(n)), whole)
        inside = np.arange(int(whole.sum())) - np.repeat(np.cumsum(whole) - whole, whole)
        self.at = begin[span] + inside
        self.size, self.left = size[span], n[span] - inside
        self.item = np.array([number.get(r["item_id"], -1) for r in rows])[span]
        self.item_start = np.array([r["start"] for r in rows])[span] + inside
        self.least, self.reach = int(size.min()), int(n.max())
        keys = W.hash_runs(self.words.astype(np.uint64) + np.uint64(1), 1)
        key = np.zeros(len(self.at), np.uint64)
        for s in np.unique(self.size).tolist():
            key[self.size == s] = W.hash_runs(keys, s)[self.at[self.size == s]] ^ np.uint64(s)
        self.window = np.unique(key, return_inverse=True)[1]
        pairs = np.unique(np.c_[self.window, self.item][self.item >= 0], axis=0)
        self.items = pairs[:, 1] if len(pairs) else np.zeros(0, np.int64)
        self.items_from = np.searchsorted(pairs[:, 0], np.arange(int(self.window.max()) + 2)) if len(pairs) else np.zeros(
            int(self.window.max()) + 2, np.int64)

    def numbers(self, one: np.ndarray) -> np.ndarray:
        """The numbers of training words, 0 for words that the block has not."""
        at = np.minimum(np.searchsorted(self.vocabulary, one), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == one, at + 1, 0)


def blocks(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark in parts of bounded size, one in the driver's memory at a time."""
    rows = cut(spans(benchmark, window))
    total = rows.agg(F.sum("n")).first()[0]
    count = -(-(total or 0) // block_words)
    for b in range(count):
        of = F.pmod(F.xxhash64("item_id", "start"), F.lit(count)) == b
        held = rows.filter(of).collect() if count > 1 else rows.collect()
        if held:
            yield Block(held)


# ---------------------------------------------------------------- training suffix arrays

def _pack(words: np.ndarray, at: np.ndarray, block: Block, sizes: np.ndarray | None = None) -> np.ndarray:
    """The next words at ``at`` in one number, up to the first 0 or as many as ``sizes`` says."""
    key, open_ = np.zeros(len(at), np.int64), np.ones(len(at), bool)
    for j in range(block.packed):
        w = words[at + j]
        open_ &= w > 0
        if sizes is not None:
            open_ &= j < sizes
        key = key << block.bits | np.where(open_, w, 0)
    return key


def suffix_array(words: np.ndarray, n: int, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Places below ``n`` whose next ``block.least`` words are all known, in the order of the words from there, and the
    packed beginnings. ``words`` ends with a 0.
    """
    stop, known = np.flatnonzero(words == 0), np.flatnonzero(words)
    if not known.size:
        return known, known
    run = stop[np.searchsorted(stop, known)] - known
    key = _pack(words, known, block)
    order = np.argsort(key, kind="stable")
    new = np.r_[True, key[order[1:]] != key[order[:-1]]]
    rank = np.zeros(len(words), np.int64)
    depth = block.packed
    while True:
        rank[known[order]] = np.maximum.accumulate(np.where(new, np.arange(1, len(order) + 1), 0))
        # a group is tied in its first `depth` words; where these hold a 0, all of the group end there and stay tied
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]) & (run[order] >= depth))
        if depth >= block.reach or not tied.size:
            break
        at = known[order[tied]]
        pair = rank[at] << 32 | rank[at + depth]
        again = np.argsort(pair, kind="stable")
        order[tied], pair = order[tied][again], pair[again]
        new[tied] = np.r_[True, pair[1:] != pair[:-1]]
        depth *= 2
    keep = (known[order] < n) & (run[order] >= block.least)
    return known[order][keep], key[order][keep]


def _bound(words, sa, lo, hi, depth, target, beyond: bool) -> np.ndarray:
    """In each range, the first place whose word at ``depth`` is not below (or is beyond) ``target``."""
    a, b = lo.copy(), hi.copy()
    while (a < b).any():
        mid = np.minimum((a + b) >> 1, len(sa) - 1)
        w = words[np.minimum(sa[mid] + depth, len(words) - 1)]
        low, open_ = (w <= target) if beyond else (w < target), a < b
        a, b = np.where(open_ & low, mid + 1, a), np.where(open_ & ~low, mid, b)
    return a


def search(words: np.ndarray, sa: np.ndarray, key: np.ndarray, block: Block):
    """Ranges of all test suffixes in a suffix array, one depth after the other.

    Yields ``(suffixes, depth, lo, hi)``: those that match ``depth`` words, their window's length or more, and where.
    """
    first = np.minimum(block.packed, block.size)
    low = _pack(block.words, block.at, block, first)
    lo = np.searchsorted(key, low)
    hi = np.searchsorted(key, low + (np.int64(1) << block.bits * (block.packed - first)))
    live = np.flatnonzero(lo < hi)
    lo, hi, depth = lo[live], hi[live], first[live]
    while live.size:
        whole = depth >= block.size[live]
        if whole.any():
            yield live[whole], depth[whole], lo[whole], hi[whole]
        more = depth < block.left[live]
        live, lo, hi, depth = live[more], lo[more], hi[more], depth[more]
        target = block.words[block.at[live] + depth]
        lo, hi = _bound(words, sa, lo, hi, depth, target, False), _bound(words, sa, lo, hi, depth, target, True)
        more = lo < hi
        live, lo, hi, depth = live[more], lo[more], hi[more], depth[more] + 1


def _places(lo: np.ndarray, hi: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of some ranges of a suffix array, equal ranges once, and the number of the range of each."""
    pick = np.unique(lo << 16 | depth, return_index=True)[1]
    lo, n = lo[pick], (hi - lo)[pick]
    return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum())), np.repeat(pick, n)


class Texts:
    """The words of some texts as numbers of a block, with their matches shard by shard."""

    def __init__(self, column: pa.Array, block: Block | None, shard: int):
        one, self.doc, self.raw = word_hashes(column)
        self.block, self.shard, self.numbers = block, shard, block.numbers(one) if block else one
        self.n_words = np.bincount(self.doc, minlength=len(column))
        self.first = np.cumsum(self.n_words) - self.n_words

    def matches(self) -> Iterator[tuple[np.ndarray, list]]:
        """``(at, results)`` of each shard: the word at each place of the suffix array, and the results of ``search``.

        A 0 stands after each text. A shard reads beyond its own places what a match can need. If a matched word differs from the
        block's in its second hash, it becomes unknown and the shard is searched again.
        """
        n = len(self.numbers)
        if not n or not self.block:
            return
        place = np.full(n + int(self.doc[-1]) + 2, n, np.int64)
        place[np.arange(n) + self.doc] = np.arange(n)
        for a in range(0, len(place), self.shard):
            here = np.r_[place[a:a + self.shard + self.block.reach], np.full(self.block.packed + 1, n)]
            own = min(self.shard, len(place) - a)
            while True:
                words = np.r_[self.numbers, 0][here]
                sa, key = suffix_array(words, own, self.block)
                found = list(search(words, sa, key, self.block)) if sa.size else []
                if not found or not self._wrong(found, sa, here):
                    break
            if found:
                yield here[sa], found

    def _wrong(self, found: list, sa: np.ndarray, here: np.ndarray) -> bool:
        cover = np.zeros(len(here) + 1, np.int64)
        for _, depth, lo, hi in found:
            at, of = _places(lo, hi, depth)
            np.add.at(cover, sa[at], 1)
            np.add.at(cover, sa[at] + depth[of], -1)
        w = here[np.flatnonzero(np.cumsum(cover[:-1]))]
        data, starts, ends = self.raw
        bad = w[W.hash_spans(data, starts[w], ends[w], 2) != self.block.second[self.numbers[w] - 1]]
        self.numbers[bad] = 0
        return bool(bad.size)


# ---------------------------------------------------------------- results

HITS = ("doc_id long, key long, n_words long, n_hit long, hits array<struct<start:int,end:int>>, items array<string>, "
        "longest long, longest_at long")


def _judge(sent: Broadcast | None, shard: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value if sent else None
        for part in W.pieces(batches, "text", PIECE):
            texts = Texts(part.column("text"), block, shard)
            cover, best, seen = np.zeros(len(texts.doc) + 1, np.int64), np.zeros(len(texts.doc), np.int64), []
            for word, found in texts.matches():
                for suffix, depth, lo, hi in found:
                    at, of = _places(lo, hi, depth)
                    at = word[at]
                    best[at] = np.maximum(best[at], depth[of])
                    full = depth[of] == block.size[suffix[of]]
                    at, of = at[full], of[full]
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + depth[of], -1)
                    seen.append(np.unique(np.c_[texts.doc[at], block.window[suffix[of]]], axis=0))
            yield from _rows(block, part, texts, np.cumsum(cover[:-1]) > 0, best, seen)

    def _rows(block, part, texts, hit, best, seen):
        pairs = np.unique(np.concatenate(seen), axis=0) if seen else np.zeros((0, 2), np.int64)
        edges = np.searchsorted(pairs[:, 0], np.arange(part.num_rows + 1)).tolist()
        known, items, held, a = {}, [], 0, 0
        for i in range(part.num_rows):
            mine = pairs[edges[i]:edges[i + 1], 1]
            names = known.get(mine.tobytes())
            if names is None:
                of = [block.items[block.items_from[w]:block.items_from[w + 1]] for w in mine.tolist()]
                names = [block.names[k] for k in np.unique(np.concatenate(of)).tolist()] if of else []
                known = {**known, mine.tobytes(): names} if len(known) < 64 else {mine.tobytes(): names}
            items.append(names)
            held += len(names)
            if held > 1 << 16 or i + 1 == part.num_rows:
                yield _batch(part.slice(a, i + 1 - a), texts, a, i + 1, hit, best, items)
                items, held, a = [], 0, i + 1

    def _batch(part, texts, a, b, hit, best, items):
        n_hit, spans_of, longest, at = [], [], [], []
        for i in range(a, b):
            x, y = int(texts.first[i]), int(texts.first[i] + texts.n_words[i])
            h = hit[x:y]
            n_hit.append(int(h.sum()))
            edge = np.flatnonzero(np.diff(np.r_[False, h, False])).tolist() if n_hit[-1] else []
            spans_of.append([{"start": p, "end": q} for p, q in zip(edge[::2], edge[1::2], strict=True)])
            top = int(best[x:y].argmax()) if n_hit[-1] else None
            longest.append(int(best[x + top]) if top is not None else 0)
            at.append(top)
        return pa.RecordBatch.from_arrays([
            part.column("doc_id"), part.column("key"), pa.array(texts.n_words[a:b].astype(np.int64)), pa.array(n_hit, pa.int64()),
            pa.array(spans_of, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string())),
            pa.array(longest, pa.int64()), pa.array(at, pa.int64())],
            ["doc_id", "key", "n_words", "n_hit", "hits", "items", "longest", "longest_at"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, shard: int = SHARD) -> DataFrame:
    """``docs(doc_id, text)``, ``benchmark(item_id, text)`` -> a row per row of ``docs``.

    ``n_words``, ``n_hit``; ``hits``: the spans of hit words; ``items``: the items with a window in the text, sorted;
    ``longest`` and ``longest_at``: the longest verbatim match of a test suffix and its first word, 0 and null without any. ``key`` tells apart
    texts of one ``doc_id``.
    """
    texts, first, later = _texts(docs), None, None
    for block in blocks(benchmark, window, block_words):
        rows = texts.mapInArrow(_judge(docs.sparkSession.sparkContext.broadcast(block), shard), HITS)
        if first is None:
            first = rows
        else:
            found = cut(rows.filter("n_hit > 0").dropDuplicates(["doc_id", "key"]))
            later = found if later is None else later.unionByName(found)
    if first is None:
        return texts.mapInArrow(_judge(None, shard), HITS)
    return first if later is None else _united(first, later)


def _united(first: DataFrame, later: DataFrame) -> DataFrame:
    """The rows of the first block with what later blocks found in the same texts."""
    more = cut(later.groupBy("doc_id", "key").agg(
        F.flatten(F.collect_list("hits")).alias("more_hits"), F.flatten(F.collect_list("items")).alias("more_items"),
        F.max(F.struct("longest", -F.col("longest_at"))).alias("more_longest")))
    on = first["doc_id"].eqNullSafe(more["doc_id"]) & (first["key"] == more["key"])
    both = first.join(more, on, "left").select(first["doc_id"], first["key"], *[c for c in first.columns[2:]], *more.columns[2:])
    spot = F.array_sort(F.concat("hits", F.coalesce("more_hits", F.lit([]).cast(first.schema["hits"].dataType))))
    joined = F.aggregate(spot, F.lit([]).cast(first.schema["hits"].dataType), lambda acc, h: F.when(
        F.try_element_at(acc, F.lit(-1))["end"] >= h["start"], F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(
            F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], h["end"]).alias("end"))))).otherwise(
        F.concat(acc, F.array(h))))
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("more_items", F.lit([]).cast("array<string>")))))
    best = F.greatest(F.struct("longest", (-F.col("longest_at")).alias("at")), F.col("more_longest").cast("struct<longest:bigint,at:bigint>"))
    both = both.withColumns({"hits": joined, "items": items, "best": best})
    length = F.aggregate("hits", F.lit(0), lambda acc, h: acc + h["end"] - h["start"]).cast("long")
    return both.select("doc_id", "key", "n_words", length.alias("n_hit"), "hits", "items", F.col("best.longest").alias("longest"),
                       (-F.col("best.at")).alias("longest_at"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs, all columns as they are."""
    bad = contamination(docs, benchmark, window).filter("n_hit > 0").select("doc_id", "key").distinct()
    key = text_key(F.col("text"))
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["doc_id"]) & (key == bad["key"]), "left_anti")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, shard: int = SHARD) -> DataFrame:
    """``(item_id, item_start, length, places, doc_id, doc_start)`` of every test suffix that matches a window or more: its
    longest verbatim match over all texts, at how many places, and the first of them. A match ends with its span.
    """
    def run(sent):
        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block = sent.value
            for part in W.pieces(batches, "text", PIECE):
                texts, ids = Texts(part.column("text"), block, shard), part.column("doc_id").to_numpy()
                for word, found in texts.matches():
                    length, low, high = (np.zeros(len(block.at), np.int64) for _ in range(3))
                    for suffix, depth, lo, hi in found:
                        length[suffix], low[suffix], high[suffix] = depth, lo, hi
                    at = np.flatnonzero((length > 0) & (block.item >= 0))
                    _, pick = np.unique(low[at] << 16 | length[at], return_index=True)
                    least = {}
                    for k in at[pick].tolist():
                        w = word[low[k]:high[k]]
                        d = texts.doc[w]
                        x = np.lexsort((w, ids[d]))[0]
                        least[low[k], length[k]] = int(ids[d[x]]), int(w[x] - texts.first[d[x]])
                    first = [least[low[k], length[k]] for k in at.tolist()]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([block.names[i] for i in block.item[at].tolist()], pa.string()), pa.array(block.item_start[at]), pa.array(length[at]),
                        pa.array((high - low)[at]), pa.array([f[0] for f in first], pa.int64()), pa.array([f[1] for f in first], pa.int64())],
                        ["item_id", "item_start", "length", "places", "doc_id", "doc_start"])

        return emit

    texts, out = _texts(docs).filter("doc_id is not null").select("doc_id", "text"), None
    schema = "item_id string, item_start long, length long, places long, doc_id long, doc_start long"
    for block in blocks(benchmark, window, block_words):
        rows = texts.mapInArrow(run(docs.sparkSession.sparkContext.broadcast(block)), schema)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.sparkSession.createDataFrame([], schema)
    per = out.groupBy("item_id", "item_start", "length").agg(F.sum("places").alias("places"), F.min(F.struct("doc_id", "doc_start")).alias("at"))
    best = per.groupBy("item_id", "item_start").agg(F.max(F.struct("length", "places", "at")).alias("b"))
    return best.select("item_id", "item_start", "b.length", "b.places", "b.at.doc_id", "b.at.doc_start")
