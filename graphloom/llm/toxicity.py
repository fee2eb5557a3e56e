"""Toxicity of whole texts: a convolutional network over hashed word embeddings, trained in numpy.

A word's embedding is the sum of four hashed rows: the word's and those of its first four, five and six bytes, so that
inflected forms share what they learn. Filters of width 1, 2 and 3 slide over the words, each filter keeps its maximum
(ReLU), and a logistic unit gives the score. The first embedding column starts as the smoothed log-odds of a row
between toxic and clean training texts; everything is then trained together by gradient steps.

The net is fitted on the driver on at most ``PER_CLASS[label]`` labelled texts per label, those of the smallest hashed
ids among texts of at most ``TRAIN_BYTES`` bytes (memory bound: their product). A share of each language's labels is
never trained on: a fifth, more of a rare language so that about ``2 * LEAST`` remain, at most half. Every labelled text
that is neither held out nor trained on is then scored whole on Spark, and exact counts by language and score (steps of
``1 / STEPS`` in logits) place the decision at 0.5 and one threshold per language for ``flagged``. Scoring covers every
whole text; neither ``lang`` nor any other column enters a score.

Defined results: a null or empty text gets the score of a text without words; a null ``doc_id`` is not held out; of
contradicting labels the toxic one counts; a language with fewer than ``LEAST`` toxic or clean texts among those takes
0.5, the decision over all languages; so does a null language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .common import bitmap, cut, in_bitmap, text_key

PER_CLASS = {0: 4096, 1: 2048}
TRAIN_BYTES = 20_000
LEAST, STEPS = 10, 64
SLOTS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 6, (1, 2, 3)
EPOCHS, BATCH, RATE, SEED = 6, 128, 0.05, 7
PREFIXES = (4, 5, 6)

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def slots_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows of each word, ``(words, 4)``, and the number of the text of each word."""
    data, offsets = W.text_bytes(column)
    data = W.lower_ascii(data)
    starts, ends, doc = W.bounds(data, offsets, _BREAK)
    hashed = [W.hash_spans(data, starts, ends, 0)]
    for k in PREFIXES:
        hashed.append(W.hash_spans(data, starts, np.minimum(ends, starts + k), k))
    return np.stack([(h & np.uint64(SLOTS - 1)).astype(np.int32) for h in hashed], 1), doc


@dataclass
class Net:
    """Parameters; ``filters[w]`` is ``(w, DIM, FILTERS)``."""

    rows: np.ndarray
    filters: dict[int, np.ndarray]
    out: np.ndarray
    bias: float
    thresholds: dict[str, float] = field(default_factory=dict)

    def tables(self) -> dict[tuple[int, int], np.ndarray]:
        """What each embedding row adds to each filter, per width and place."""
        return {(w, k): (self.rows @ self.filters[w][k]).astype(np.float32) for w in WIDTHS for k in range(w)}


def _responses(place, doc: np.ndarray, width: int) -> np.ndarray:
    """Filter sums at each word; words after a text's end count as zero. ``place(k)`` gives ``(words, FILTERS)``."""
    total = place(0).copy()
    for k in range(1, width):
        if len(doc) > k:
            same = doc[k:] == doc[:-k]
            total[:-k] += place(k)[k:] * same[:, None]
    return total


def score_column(column: pa.Array, net: Net, tables: dict) -> np.ndarray:
    slots, doc = slots_of(column)
    pooled = np.zeros((len(column), len(WIDTHS) * FILTERS), np.float32)
    if len(doc):
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        for i, w in enumerate(WIDTHS):
            sums = _responses(lambda k, w=w: sum(tables[w, k][slots[:, s]] for s in range(slots.shape[1])), doc, w)
            pooled[doc[first], i * FILTERS:(i + 1) * FILTERS] = np.maximum(np.maximum.reduceat(sums, first, axis=0), 0)
    return 1 / (1 + np.exp(-np.clip((pooled * net.out).sum(1) + net.bias, -30, 30).astype(float)))


def fit(texts: list[str], labels: np.ndarray) -> Net:
    """Train on the texts; the decision and the languages' thresholds are placed by ``calibrate``."""
    rng = np.random.default_rng(SEED)
    parts = [slots_of(pa.array(texts[a:a + BATCH], pa.large_string())) for a in range(0, len(texts), BATCH)]
    slots = np.concatenate([s for s, _ in parts]) if parts else np.zeros((0, 1 + len(PREFIXES)), np.int32)
    doc = np.concatenate([d + i * BATCH for i, (_, d) in enumerate(parts)]) if parts else np.zeros(0, int)
    del parts
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    train = np.arange(len(texts))
    rows = rng.normal(0, 0.05, (SLOTS, DIM)).astype(np.float32)
    counts = np.full((2, SLOTS), 0.5)
    for d in train:
        seen = np.unique(slots[edges[d]:edges[d + 1]])
        counts[int(labels[d]), seen] += 1
    both = np.array([max(1, (labels[train] == c).sum()) for c in (0, 1)])[:, None] + 1.0
    odds = np.log(counts / both)
    rows[:, 0] = np.clip(odds[1] - odds[0], -4, 4) * np.minimum(1, (counts.sum(0) - 1) / 8) / 4
    filters = {w: rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
    for f in filters.values():
        f[:, 0, :] = np.abs(f[:, 0, :]) + 0.5
    out = np.full(len(WIDTHS) * FILTERS, 0.2, np.float32)
    net = Net(rows, filters, out, -1.0)
    state = {k: 1e-6 for k in ("out", "bias", *WIDTHS)}
    row_state = np.full(SLOTS, 1e-6, np.float32)

    def adapt(name, gradient):
        state[name] = state[name] + gradient ** 2
        return RATE * gradient / np.sqrt(state[name])

    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(train), max(1, len(train) // BATCH)):
            words = np.concatenate([np.arange(edges[d], edges[d + 1]) for d in batch]) if len(batch) else np.zeros(0, int)
            if not len(words):
                continue
            s = slots[words]
            d = np.repeat(np.arange(len(batch)), [edges[b + 1] - edges[b] for b in batch])
            x = net.rows[s].sum(1)
            first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            have = d[first]
            pooled, best = np.zeros((len(batch), len(WIDTHS) * FILTERS), np.float32), {}
            for i, w in enumerate(WIDTHS):
                sums = _responses(lambda k, w=w: x @ net.filters[w][k], d, w)
                top = np.maximum.reduceat(sums, first, axis=0)
                pooled[have, i * FILTERS:(i + 1) * FILTERS] = np.maximum(top, 0)
                full = np.full((len(batch), FILTERS), np.inf, np.float32)
                full[have] = top
                at, f = np.nonzero(sums == full[d])
                _, once = np.unique(d[at] * FILTERS + f, return_index=True)
                best[w] = at[once], f[once]
            p = 1 / (1 + np.exp(-np.clip(pooled @ net.out + net.bias, -30, 30)))
            error = ((p - labels[batch]) / len(batch)).astype(np.float32)
            back = error[:, None] * net.out * (pooled > 0)
            row_gradient = {}
            for i, w in enumerate(WIDTHS):
                at, f = best[w]
                g = back[d[at], i * FILTERS + f]
                change = np.zeros_like(net.filters[w])
                for k in range(w):
                    ok = np.flatnonzero(at + k < len(d))
                    ok = ok[d[at[ok] + k] == d[at[ok]]]
                    np.add.at(change[k].T, f[ok], g[ok, None] * x[at[ok] + k])
                    row_gradient[w, k] = s[at[ok] + k], g[ok, None] * net.filters[w][k].T[f[ok]]
                net.filters[w] -= adapt(w, change)
            net.out -= adapt("out", pooled.T @ error)
            net.bias -= float(adapt("bias", error.sum()))
            touched = np.concatenate([i for i, _ in row_gradient.values()])
            value = np.concatenate([v for _, v in row_gradient.values()])
            for c in range(touched.shape[1]):
                np.add.at(row_state, touched[:, c], (value ** 2).mean(1))
                np.add.at(net.rows, touched[:, c], -RATE * value / np.sqrt(row_state[touched[:, c]])[:, None])
    return net


def _logit(p: float) -> float:
    return float(np.log(p / (1 - p)))


def _threshold(steps: np.ndarray, clean: np.ndarray, toxic: np.ndarray, shift: float = 0.0) -> float | None:
    """The score of the best F1, midway in logits between the steps around it; none with too few of either label.

    ``steps`` ascend; ``shift`` is taken off their logits.
    """
    if min(clean.sum(), toxic.sum()) < LEAST:
        return None
    s, hit, all_ = steps[::-1], np.cumsum(toxic[::-1]), np.cumsum((clean + toxic)[::-1])
    i = int(np.argmax(2 * hit / (all_ + toxic.sum())))
    if i + 1 < len(s):
        at = (s[i] + s[i + 1] + 1) / 2 / STEPS - shift
    else:
        at = (s[i] / STEPS - shift + _logit(1 / (1 + np.exp(-np.clip(s[i] / STEPS - shift, -30, 30))) / 2)) / 2
    return float(1 / (1 + np.exp(-np.clip(at, -30, 30))))


def counts_by_score(docs: DataFrame, ours: DataFrame, net: Net, trained: DataFrame) -> DataFrame:
    """``(lang, step, clean, toxic)``: labelled texts that are not in ``trained(doc_id, key)``, counted by their scores' step."""
    spark = docs.sparkSession
    held, ids = spark.sparkContext.broadcast(net), spark.sparkContext.broadcast(bitmap(ours, "doc_id"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = held.value.tables()
        for batch in batches:
            hit = in_bitmap(ids.value, batch.column("spot").to_numpy(zero_copy_only=False))
            for part in W.pieces(iter([batch.filter(pa.array(hit))]), "text", 1 << 20):
                p = score_column(part.column("text"), held.value, tables)
                step = np.floor(np.log(p / (1 - p)) * STEPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "key", "lang")), pa.array(step)],
                                                 ["doc_id", "key", "lang", "step"])

    rows = docs.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text").cast("string")).alias("key"), F.col("lang").cast("string").alias("lang"),
        F.xxhash64(F.col("doc_id").cast("long")).alias("spot"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(emit, "doc_id long, key long, lang string, step int")
    return scored.join(F.broadcast(trained), ["doc_id", "key"], "left_anti").join(ours.select("doc_id", "toxic"), "doc_id").groupBy("lang", "step").agg(
        F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic"))


def calibrate(net: Net, counts: DataFrame) -> Net:
    """Put the decision of all languages at 0.5, and each language's threshold where its own counts have it."""
    counts = cut(counts)
    total = counts.groupBy("step").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas().sort_values("step")
    at = _threshold(*(total[c].to_numpy(np.int64) for c in ("step", "clean", "toxic")))
    shift = _logit(at) if at else 0.0
    net.bias -= shift
    enough = counts.groupBy("lang").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).filter(
        (F.col("c") >= LEAST) & (F.col("t") >= LEAST) & F.col("lang").isNotNull()).select("lang")
    own = counts.join(enough, "lang").toPandas().sort_values(["lang", "step"])
    for lang, rows in own.groupby("lang"):
        net.thresholds[lang] = _threshold(*(rows[c].to_numpy(np.int64) for c in ("step", "clean", "toxic")), shift)
    return net


def train(docs: DataFrame, labels: DataFrame) -> Net:
    """Fit on a sample of the labelled documents outside the held-out fifth, and calibrate on all others of them."""
    named = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("toxic").cast("int").alias("toxic")).filter(~held_out(F.col("doc_id")))
    langs = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    ours = cut(named.join(langs, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("lang").alias("lang")).withColumn(
        "order", F.xxhash64("doc_id")))
    size = ours.groupBy(F.col("lang").alias("of"), F.col("toxic").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    aside = F.least(F.lit(50), F.greatest(F.lit(20), F.ceil(200 * LEAST / F.col("n"))))
    free = ours.join(cut(size), F.col("lang").eqNullSafe(F.col("of")) & (F.col("toxic") == F.col("label"))).filter(
        F.pmod(F.xxhash64("order"), F.lit(100)) >= aside).select("doc_id", "toxic", "order")
    picked = [free.filter(F.col("toxic") == c).orderBy("order", "doc_id").limit(n) for c, n in PER_CLASS.items()]
    sample = F.broadcast(picked[0].unionByName(picked[1]))
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("key")) \
        .filter(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES).join(sample, "doc_id").toPandas()
    rows = rows.sort_values(["order", "doc_id", "text"], kind="stable").reset_index(drop=True)
    rows = rows.drop_duplicates("doc_id").reset_index(drop=True)
    net = fit([x if isinstance(x, str) else "" for x in rows["text"]], rows["toxic"].to_numpy(np.int64))
    trained = docs.sparkSession.createDataFrame([(int(i), int(k)) for i, k in zip(rows["doc_id"], rows["key"], strict=True)], "doc_id long, key long")
    return calibrate(net, counts_by_score(docs, ours, net, trained))


def held_out(doc_id) -> F.Column:
    """Every fifth document by CRC-32 of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _scored(batches: Iterator[pa.RecordBatch], model: Net) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the input with their scores and whether these reach their language's threshold."""
    tables = model.tables()
    for part in W.pieces(batches, "text", 1 << 20):
        s = score_column(part.column("text"), model, tables)
        yield part, s, s >= np.array([model.thresholds.get(x, 0.5) for x in part.column("lang").to_pylist()])


def score(docs: DataFrame, net: Net) -> DataFrame:
    """``docs`` -> ``(doc_id, held_out, score, predicted, flagged)``, one row per row."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, s, over in _scored(batches, held.value):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array(over)],
                                             ["doc_id", "score", "predicted", "flagged"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(
        emit, "doc_id long, score double, predicted int, flagged boolean").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "flagged")


def keep_clean(docs: DataFrame, net: Net) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay below their language's threshold."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, over in _scored(batches, held.value):
            yield part.filter(pa.array(~over))

    return docs.mapInArrow(emit, docs.schema)
