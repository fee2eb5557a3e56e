"""Removal of word windows that already start in a document with a smaller id.

1. *Copies.* A text that equals one of a smaller id loses all its words (if it has a window at all), and adds no window
   that the first has not. A scan skips copies by a bounded bitmap, and a second one of the first's false hits keeps
   those from being skipped; a copy that is not skipped gives the same result the long way.
2. *Count-min prefilter.* A window's key in the sketch is the smallest hash among its seven-word runs, so a document
   adds about a quarter as many keys as it has windows. Each task counts documents per cell up to two, and sends its
   sketch in sparse segments; a segment is merged in one task as two bitmaps. Equal windows have equal keys, so a
   window that two documents share is never counted below two: nothing is lost, some windows are overestimated.
3. *Exact grouping.* Only windows whose cells all count two are grouped, by 96 bits of their word sequence, with the
   smallest and largest document id (combined before the shuffle). Repeated ones meet their occurrences in an equi-join
   with the written result, which adaptive execution splits where a passage is very common.
4. Removed starts go back to their document, whose words are then cut. Only documents that a bitmap of those with
   removals lets through are shuffled for this; the others are finished where they are read.

The merged sketch is the only large thing sent to all tasks, as a file that an executor's workers map and share: two rows of at most ``2 ** LARGEST`` bits (64 MiB together) at
any input size. Beyond that size it filters less and more windows take the exact way; results do not change.

Defined results: a null text has no words; rows with a null ``doc_id`` neither remove nor lose words; rows repeating a
``doc_id`` do not remove from each other; ``kept_text`` is null where nothing is removed.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import words as W
from .common import bitmap, cut, in_bitmap, text_key

WINDOW, GRAM = 13, 7
PIECE, FLUSH = 1 << 20, 1 << 19
SEGMENT = 22
SMALLEST, LARGEST = 22, 28


def _windows(column: pa.Array, window: int):
    """Start word, text, sketch key and two hashes of every window, and what is needed to find its words again."""
    data, offsets = W.text_bytes(column)
    starts, ends, doc = W.bounds(data, offsets)
    one, two = W.hash_spans(data, starts, ends, 1), W.hash_spans(data, starts, ends, 2)
    n = max(0, len(doc) - window + 1)
    at = np.flatnonzero(doc[:n] == doc[window - 1:]) if n else np.zeros(0, np.int64)
    gram = min(GRAM, window)
    low = W.hash_runs(one, gram)
    width, done = window - gram + 1, 1
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[:-step], low[step:])
        done += step
    first = np.searchsorted(doc, np.arange(len(column) + 1))
    return at, doc[at] if n else at, low[at] if n else low[:0], W.hash_runs(one, window)[at] if n else low[:0], \
        W.hash_runs(two, window)[at] if n else low[:0], first, (data, starts, ends)


def _cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    again = W.mix(keys ^ np.uint64(0x5851F42D4C957F2D))
    return [(k >> np.uint64(64 - bits)).astype(np.int64) for k in (W.mix(keys), again)]


def _bits(docs: DataFrame) -> int:
    """Sixteen cells for each expected key, a key being about 24 bytes of text."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(LARGEST, max(SMALLEST, int(size * 16 / 24).bit_length()))


def sketch(docs: DataFrame, skip, window: int = WINDOW, bits: int | None = None) -> tuple[int, np.ndarray]:
    """Cells that at least two documents reach: ``bits`` and a bitmap of each of the two rows."""
    bits = bits or _bits(docs)
    per_row = 1 << (bits - SEGMENT)

    def parts(keys: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for row, cells in enumerate(_cells(np.concatenate(keys), bits)):
            cell, count = np.unique(cells, return_counts=True)
            edges = np.searchsorted(cell, np.arange(per_row + 1) << SEGMENT)
            for s in np.flatnonzero(np.diff(edges)):
                c, k = cell[edges[s]:edges[s + 1]] & ((1 << SEGMENT) - 1), count[edges[s]:edges[s + 1]]
                packed = zlib.compress(np.diff(c, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(row * per_row + s)], pa.int32()), pa.array([packed], pa.binary()),
                    pa.array([np.packbits(k > 1).tobytes()], pa.binary())], ["segment", "cells", "twice"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in W.pieces(skip(batches), "text", PIECE):
            _, doc, key, *_ = _windows(part.column("text"), window)
            ids = part.column("doc_id").to_numpy()
            order = np.lexsort((key, ids[doc]))
            key, of = key[order], ids[doc][order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
            held.append(key[new])
            n += len(held[-1])
            if n > FLUSH:
                yield from parts(held)
                held, n = [], 0
        if n:
            yield from parts(held)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one, two = None, None, None
        for batch in batches:
            for s, cells, twice in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != now:
                    if now is not None:
                        yield _segment(now, two)
                    now, one, two = s, np.zeros(1 << SEGMENT, bool), np.zeros(1 << SEGMENT, bool)
                c = np.cumsum(np.frombuffer(zlib.decompress(cells), np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1))
                two[c[one[c] | np.unpackbits(np.frombuffer(twice, np.uint8), count=len(c)).astype(bool)]] = True
                one[c] = True
        if now is not None:
            yield _segment(now, two)

    merged = docs.mapInArrow(count, "segment int, cells binary, twice binary") \
        .repartition(min(2 * per_row, 64), "segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    out = np.zeros((2 * per_row, (1 << SEGMENT) // 8), np.uint8)
    for r in merged.toLocalIterator():
        out[r["segment"]] = np.frombuffer(r["twice"], np.uint8)
    return bits, out.reshape(2, -1)


def _send(spark: SparkSession, rows: np.ndarray) -> str:
    """Give the executors the bitmaps as a file; its name."""
    name = f"sketch-{uuid.uuid4().hex}"
    path = os.path.join(tempfile.mkdtemp(prefix="graphloom-"), name)
    rows.tofile(path)
    spark.sparkContext.addFile(path)
    return name


def _segment(number: int, cells: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.packbits(cells).tobytes()], pa.binary())],
                                      ["segment", "twice"])


def _ready(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null").select(
        F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"), F.col("text").cast("string"),
        F.xxhash64(F.col("doc_id").cast("long"), text_key(F.col("text"))).alias("spot"))


def copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, key, spot)`` of all rows and of those whose whole text a smaller id has."""
    rows = cut(_ready(docs).select("doc_id", "key", "spot", F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary"))).alias("same")))
    first = cut(rows.groupBy("same").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("same", "lo"))
    return rows.drop("same"), cut(rows.join(first, "same").filter("doc_id > lo").select("doc_id", "key", "spot").distinct())


def _skipping(rows: DataFrame, known: DataFrame):
    """A filter of scanned batches that lets every row pass that is no copy, and few copies."""
    context = rows.sparkSession.sparkContext
    one = bitmap(known, "spot")
    held = context.broadcast(one)

    def maybe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(held.value, _rehash(batch))))

    def _rehash(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column("again").to_numpy()

    again = rows.withColumn("again", F.xxhash64("spot"))
    false = again.mapInArrow(maybe, again.schema).join(known.select("spot"), "spot", "left_anti").select("spot").distinct()
    other = context.broadcast(bitmap(cut(false), "spot"))

    def skip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in W.pieces(batches, "text", PIECE):
            spot = batch.column("again").to_numpy()
            yield batch.filter(pa.array(~in_bitmap(held.value, spot) | in_bitmap(other.value, spot)))

    return skip


def occurrences(docs: DataFrame, skip, sent: str, bits: int, window: int) -> DataFrame:
    """``(h1, h2, doc_id, at)`` of the windows that the sketch in the file ``sent`` estimates repeated.

    ``at`` is the start word, with 24 bits of the text's key below it, which tell apart texts of one id.
    """
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = np.memmap(SparkFiles.get(sent), np.uint8, "r").reshape(2, -1)
        for part in W.pieces(skip(batches), "text", PIECE):
            at, doc, key, h1, h2, first, _ = _windows(part.column("text"), window)
            seen = np.ones(len(key), bool)
            for row, cell in zip(rows, _cells(key, bits), strict=True):
                seen &= (row[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
            at, doc = at[seen], doc[seen]
            ids, keys = (part.column(c).to_numpy() for c in ("doc_id", "key"))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                h1[seen].view(np.int64), h2[seen].astype(np.uint32).view(np.int32), ids[doc], (at - first[doc]) << 24 | keys[doc] & 0xFFFFFF)],
                ["h1", "h2", "doc_id", "at"])

    return docs.mapInArrow(emit, "h1 long, h2 int, doc_id long, at long")


def _cut_words(window: int, parts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            *_, first, (data, starts, ends) = _windows(part.column("text"), window)
            raw, n, gone, digest, kept = memoryview(data), [], [], [], []
            for i, (at, copy) in enumerate(zip(part.column("starts").to_pylist(), part.column("copy").to_pylist(), strict=True)):
                a, b = starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]]
                n.append(len(a))
                cover = np.zeros(len(a) + 1, np.int64)
                if copy and len(a) >= window:
                    cover[0] = 1
                elif at:
                    at = np.unique(at)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + window, -1)
                stay = np.cumsum(cover[:-1]) == 0
                text = b" ".join([bytes(raw[x:y]) for x, y in zip(a[stay].tolist(), b[stay].tolist(), strict=True)])
                gone.append(int(len(a) - stay.sum()))
                digest.append(hashlib.sha256(text).hexdigest())
                kept.append(text.decode() if gone[-1] else None)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("key"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(digest), pa.array(kept, pa.string())], ["doc_id", "key", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def removed_starts(docs: DataFrame, window: int = WINDOW, bits: int | None = None) -> DataFrame:
    """``(doc_id, low, starts, copy)``: start words of the windows to remove, or that all words go; ``low`` is 24 bits
    of the text's key. A row per distinct document that loses words.
    """
    rows, known = copies(docs)
    skip = _skipping(rows, known)
    again = _ready(docs).withColumn("again", F.xxhash64("spot")).drop("spot")
    bits, rows_twice = sketch(again, skip, window, bits)
    found = occurrences(again, skip, _send(docs.sparkSession, rows_twice), bits, window)
    least = cut(found.groupBy("h1", "h2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").drop("hi"))
    gone = found.join(least, ["h1", "h2"]).filter("doc_id > lo").select("doc_id", "at")
    starts = gone.groupBy("doc_id", F.expr("at & 16777215").alias("low")).agg(
        F.collect_list(F.shiftright("at", 24).cast("int")).alias("starts"))
    whole = known.select("doc_id", F.expr("key & 16777215").alias("low"), F.lit(True).alias("copy")).distinct()
    return starts.join(whole, ["doc_id", "low"], "full")


def deduplicate(docs: DataFrame, window: int = WINDOW, bits: int | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, key, n_words, n_removed, kept_sha256, kept_text)``, a row per row."""
    low = F.expr("key & 16777215")
    starts = cut(removed_starts(docs, window, bits))
    held = docs.sparkSession.sparkContext.broadcast(bitmap(starts.select(F.xxhash64("doc_id", "low").alias("spot")), "spot"))
    texts = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"), F.col("text").cast("string")).withColumn(
        "low", low).withColumn("again", F.xxhash64(F.xxhash64("doc_id", "low")))

    def chosen(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(in_bitmap(held.value, batch.column("again").to_numpy()) == wanted))

        return texts.mapInArrow(run, texts.schema).select("doc_id", "key", "low", "text")

    schema = "doc_id long, key long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    packed = chosen(True).mapInArrow(W.pack, "doc_id long, key long, low long, packed binary")
    changed = packed.join(starts, ["doc_id", "low"], "left").select("doc_id", "key", "packed", "starts", "copy").mapInArrow(
        _cut_words(window, W.unpacked), schema)
    whole = chosen(False).select("doc_id", "key", "text", F.lit(None).cast("array<int>").alias("starts"), F.lit(None).cast("boolean").alias("copy"))
    return whole.mapInArrow(_cut_words(window, lambda batches: W.pieces(batches, "text", PIECE)), schema).unionByName(changed)


def replace_texts(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the words of repeated windows cut from ``text`` and ``n_chars``, of its own type, set anew where any were.

    Other columns come back as they are, whatever their names.
    """
    gone = deduplicate(docs, window).filter("n_removed > 0").groupBy("doc_id", "key").agg(F.first("kept_text").alias("kept_text"))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id"), text_key(F.col("text")).alias("key"))
    out = held.join(gone, ["doc_id", "key"], "left")
    anew = {"text": F.coalesce("kept_text", "row.text"), "n_chars": F.coalesce(F.length("kept_text").cast(docs.schema["n_chars"].dataType), "row.n_chars")}
    return out.select(*[anew.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
