"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, union-find grouping.

Documents whose sets of five-word shingles overlap by ``percent`` or more are linked; a component of links is a group.

* Equal sets are one class before anything else, so exact copies cost one row each.
* A class's signature holds, per slot, the smallest rank that one of its shingles reaches there. A shingle's ranks are
  a random permutation drawn one place at a time: place ``j`` gives values of at least ``j``, so a document stops once
  every slot holds less (about ``max(n, slots * ln(slots))`` draws, not ``n * slots``).
* A band of four slots finds a pair of similarity 0.85 with probability 0.52; 24 bands miss one in 5e7.
* Buckets are stars around their most central member (the one whose other buckets are the fullest), so a bucket of
  ``n`` gives ``n - 1`` pairs, found by sums and equi-joins; no bucket is gathered in one task. Members that are still
  in different groups meet in bounded blocks of their bucket, where signatures and then the ``LOWEST`` smallest hashes
  of each set are compared; pairs within 4.75 standard deviations of the limit are confirmed too.
* Each pair is confirmed on full shingle sets. Full sets travel only for documents that have a candidate partner; a
  bitmap of bounded size preselects those during the scan, and its false positives only cost rows.

Defined results: a null or blank text has no shingles and is linked with nothing; fewer than five words are one
shingle; rows that repeat a ``doc_id`` are judged each by its own text (two texts that are both the first of their kind
under one id are one node); a null ``doc_id`` stands alone (``component_id`` null, kept).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import bitmap, cut, in_bitmap
from .grouping import components

SHINGLE, SLOTS, ROWS = 5, 96, 4
PERCENT = 85
BLOCK, LOWEST = 1024, 512
SPREAD = 4.75


def super_minhash(h: np.ndarray, doc: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """Signatures of ``n_docs`` documents; ``h`` has their distinct shingles, ``doc`` the document of each, ascending.

    Place ``j`` of all shingles is drawn at once. Of each shingle's permutation only the swaps made so far are kept.
    """
    sig = np.full((n_docs, slots), np.iinfo(np.uint64).max, np.uint64)
    flat, swapped, moved = sig.reshape(-1), [], []
    for j in range(slots):
        x = W.mix(h + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        k = (j + (x & np.uint64(0xFFFF)) % np.uint64(slots - j)).astype(np.int16)
        at_k, at_j = k.copy(), np.full(len(h), j, np.int16)
        for s, m in zip(swapped, moved, strict=True):
            at_k = np.where(s == k, m, at_k)
            at_j = np.where(s == j, m, at_j)
        swapped.append(k)
        moved.append(at_j)
        np.minimum.at(flat, doc * slots + at_k, (x >> np.uint64(16)) | np.uint64(j << 48))
        go = (sig.max(1) >= np.uint64((j + 1) << 48))[doc]
        if not go.all():
            h, doc = h[go], doc[go]
            swapped, moved = [s[go] for s in swapped], [m[go] for m in moved]
        if not len(h):
            break
    return sig


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending within a text, and the number of the text of each."""
    data, offsets = W.text_bytes(column)
    data = W.lower_ascii(data)
    starts, ends, doc = W.bounds(data, offsets)
    words = W.hash_spans(data, starts, ends, 1)
    runs = W.hash_runs(words, size)
    whole = doc[:len(runs)] == doc[size - 1:] if len(runs) else np.zeros(0, bool)
    runs, of = runs[whole], doc[:len(runs)][whole]
    count = np.bincount(doc, minlength=len(column))
    short = np.flatnonzero((count > 0) & (count < size))
    if short.size:
        first = np.searchsorted(doc, short)
        extra = []
        for d, a in zip(short, first, strict=True):
            extra.append(int(W.hash_runs(words[a:a + count[d]], int(count[d]))[0]))
        runs, of = np.r_[runs, W.mix(np.array(extra, np.uint64) ^ count[short].astype(np.uint64))], np.r_[of, short]
    order = np.argsort(of, kind="stable")
    runs, of = runs[order], of[order]
    edges = np.searchsorted(of, np.arange(len(column) + 1))
    sets = [np.unique(runs[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return (np.concatenate(sets) if sets else runs), np.repeat(np.arange(len(sets)), [len(s) for s in sets])


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in W.pieces(batches, "text"):
        n = part.num_rows
        hashes, doc = shingle_sets(part.column("text"))
        sig = super_minhash(hashes, doc, n)
        edges = np.searchsorted(doc, np.arange(n + 1))
        size = np.diff(edges)
        bands = sig.reshape(n, -1, ROWS)
        key = np.broadcast_to(np.arange(bands.shape[1], dtype=np.uint64), bands.shape[:2])
        for r in range(ROWS):
            key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) ^ bands[:, :, r])
        digests = [hashlib.blake2b(hashes[a:b].tobytes(), digest_size=16).digest()
                   for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([
            part.column("doc_id"), pa.array(size.astype(np.int64)), pa.array(digests, pa.binary()),
            pa.array(list(key.view(np.int64)), pa.list_(pa.int64())),
            pa.array([x.tobytes() for x in sig.astype(np.uint8)], pa.binary())], ["doc_id", "n", "digest", "bands", "sig"])


def describe(docs: DataFrame) -> DataFrame:
    """``(doc_id, n, digest, bands, sig)``: set size, 128 bits of the set, the band keys, eight bits of each slot."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _describe, "doc_id long, n long, digest binary, bands array<long>, sig binary")


def _sets(docs: DataFrame, nodes: DataFrame, most: int | None = None) -> DataFrame:
    """``(node, full)``: the sorted shingle set, or its ``most`` smallest, of each document that may be in ``nodes``."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(bitmap(nodes, "node"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = in_bitmap(held.value, batch.column("spot").to_numpy(zero_copy_only=False))
            for part in W.pieces(iter([batch.filter(pa.array(hit))]), "text"):
                hashes, doc = shingle_sets(part.column("text"))
                edges = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(
                    [hashes[a:b][:most].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)], pa.binary())], ["node", "full"])

    return docs.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("node"), F.xxhash64(F.col("doc_id").cast("long")).alias("spot"),
        F.col("text").cast("string")).mapInArrow(emit, "node long, full binary")


def _confirm(docs: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets overlap enough."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out, last, left = [], None, None
        for p, q in zip(x, y, strict=True):
            if p is not last:
                left = np.frombuffer(p, np.uint64)
                last = p
            right = np.frombuffer(q, np.uint64)
            common = len(left) + len(right) - len(np.unique(np.concatenate([left, right])))
            out.append(100 * common >= percent * (len(left) + len(right) - common))
        return pd.Series(out, dtype="bool")

    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(docs, nodes)
    left = sets.select(F.col("node").alias("a"), F.col("full").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("full").alias("y"))
    return pairs.join(left, "a").join(right, "b").filter(linked("x", "y")).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_shingles, component_id, kept)``, one row per row of ``docs``."""
    rows = cut(describe(docs))
    classes = cut(rows.filter("n > 0 and doc_id is not null").groupBy("digest").agg(
        F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    banded = classes.select("node", "n", F.explode("bands").alias("band"))
    shared = cut(banded.groupBy("band").agg(
        F.count(F.lit(1)).alias("size"), F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi"))
    members = cut(banded.join(shared.select("band", "size"), "band"))
    weight = cut(members.groupBy("node").agg(F.sum("size").alias("weight")))
    centre = cut(members.join(weight, "node").groupBy("band").agg(F.max(F.struct("weight", "node", "n")).alias("c")).select(
        "band", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n")))
    near = 100 * F.least("n", "centre_n") >= percent * F.greatest("n", "centre_n")
    pairs = cut(members.join(centre, "band").filter((F.col("node") != F.col("centre")) & near).select(
        F.col("centre").alias("a"), F.col("node").alias("b")).distinct())
    links = cut(_confirm(docs, pairs, percent))
    groups = components(members.select("node").distinct(), links)

    apart = _apart(docs, members, classes.select("node", "sig"), groups, percent)
    tested = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    untested = cut(apart.join(tested, ["a", "b"], "left_anti"))
    if not untested.isEmpty():
        links = links.unionByName(_confirm(docs, untested, percent))
        groups = components(members.select("node").distinct(), cut(links))

    named = classes.join(groups, "node", "left").select("digest", F.coalesce("group", "node").alias("component_id"))
    own = rows.join(cut(named), "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return own.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _apart(docs: DataFrame, members: DataFrame, signatures: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a < b`` of different groups that share a bucket and are similar enough by size, signature and sketch.

    A bucket of more than ``BLOCK`` members is dealt into blocks, and each two blocks meet in a task of their own.
    """
    told = cut(members.join(groups, "node"))
    mixed = cut(told.groupBy("band").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).filter("lo < hi").select("band"))
    left = cut(told.join(mixed, "band"))
    nodes = left.select("node").distinct()
    sketches = cut(_sets(docs, nodes, LOWEST).join(nodes, "node").groupBy("node").agg(F.max("full").alias("full"))
                   .join(signatures, "node"))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = left.join(sketches, "node").withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), blocks - 1))).select(
        "band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "n", "group", "sig", "full")
    limit = percent / 100
    slack = {k: SPREAD * (limit * (1 - limit) / k) ** 0.5 for k in (SLOTS, LOWEST)}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in W.same_key(batches, ["band", "x", "y"]):
            node, n, group, own, x, y = (t.column(c).to_numpy() for c in ("node", "n", "group", "own", "x", "y"))
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(len(node), -1)
            low = [np.frombuffer(b, np.uint64) for b in t.column("full").to_pylist()]
            for i in range(len(node)):
                j = np.flatnonzero((group != group[i]) & (node > node[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
                if x[0] != y[0]:
                    j = j[own[j] != own[i]]
                j = j[(sig[j] == sig[i]).sum(1) >= SLOTS * (limit - slack[SLOTS])]
                j = np.array([k for k in j if _likeness(low[i], n[i], low[k], n[k]) >= limit - (max(n[i], n[k]) > LOWEST) * slack[LOWEST] - 1e-9], int)
                if j.size:
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(j.size, node[i])), pa.array(node[j])], ["a", "b"])

    return dealt.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y").mapInArrow(
        meet, "a long, b long").distinct()


def _likeness(p: np.ndarray, n_p: int, q: np.ndarray, n_q: int) -> float:
    """Jaccard similarity below the value up to which both sorted sketches are complete; exact for whole sets."""
    at = np.searchsorted(q, p)
    common = int((q[np.minimum(at, len(q) - 1)] == p).sum())
    end = min([s[-1] for s, n in ((p, n_p), (q, n_q)) if len(s) < n], default=None)
    sizes = [len(s) if end is None else int(np.searchsorted(s, end, "right")) for s in (p, q)]
    return common / (sum(sizes) - common)
