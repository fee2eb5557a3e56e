"""Exact top-k by integer inner product, with bounds from segment means and deviations.

Of a vector's segment of length ``L`` with mean ``m`` and deviation ``s``, the squared distance to another vector's is
at least ``L * ((m - m')^2 + (s - s')^2)``. Summed over segments this bounds distances from below, and with both norms
inner products from above. One segment is tried first, then four, then sixteen; each finer bound is computed only for
pairs that the coarser one leaves, and the exact product only for the last survivors. The score to beat is a query's
k-th best among the candidates of the highest coarse bounds.

Candidates and queries are dealt into blocks of bounded size; each pair of blocks is one task's work, whose memory
depends on the block sizes alone. Each gives k rows a query, which a ranked window merges.

Defined results: a vector that is null or holds a null or non-finite component, or has no id, takes no part; of rows
repeating an id the smallest vector counts; missing components of the shorter vector count as 0; ties go to the
smaller id. Components and scores that 64 bits cannot hold are the nearest 64-bit integer, and scores are ranked as that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import cut

SEGMENTS = (1, 4, 16)
BLOCK, QUERY_BLOCK, TILE = 8192, 2048, 128
SCALE = 1024
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    values = column.combine_chunks()
    sizes = values.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(values), width), np.int64)
    row = np.repeat(np.arange(len(values)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values.flatten().to_numpy(zero_copy_only=False)
    return out


def segment_features(x: np.ndarray, count: int) -> np.ndarray:
    """Root-weighted means and deviations: the product of two such rows bounds the inner product from above."""
    parts = np.array_split(x.astype(float), min(count, max(1, x.shape[1])), axis=1)
    return np.concatenate([np.stack([p.mean(1), p.std(1)], 1) * np.sqrt(p.shape[1]) for p in parts if p.shape[1]] or [np.zeros((len(x), 1))], axis=1)


def block_top(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exact best ``k`` of a candidate block for each query: query ids, candidate ids and scores."""
    features = [(segment_features(q, s), segment_features(x, s)) for s in SEGMENTS]
    safe = np.abs(x.astype(float)).max(initial=0) * np.abs(q.astype(float)).max(initial=0) * max(1, x.shape[1]) < 2.0 ** 52
    exact_x, exact_q = (x.astype(float), q.astype(float)) if safe else (x.astype(object), q.astype(object))
    norm_q, norm_x = (np.square(m.astype(float)).sum(1) for m in (q, x))
    out = []
    for a in range(0, len(q), TILE):
        part = np.arange(a, min(len(q), a + TILE))
        coarse = _upper(norm_q[part][:, None], norm_x[None, :], features[0][0][part] @ features[0][1].T)
        coarse[query_ids[part][:, None] == ids[None, :]] = -np.inf
        most = min(len(ids), 4 * k)
        near = np.argpartition(-coarse, most - 1, axis=1)[:, :most]
        first = np.stack([(exact_x[near[i]] * exact_q[p]).sum(1) for i, p in enumerate(part)]).astype(float)
        first[~np.isfinite(np.take_along_axis(coarse, near, 1))] = -np.inf
        beat = np.sort(first, axis=1)[:, -k] if most >= k else np.full(len(part), -np.inf)
        beat = np.where(beat <= float(LEAST), -np.inf, np.minimum(beat, float(MOST)))  # beyond 64 bits all scores tie
        i, j = np.nonzero((coarse >= beat[:, None]) & np.isfinite(coarse))
        for fq, fx in features[1:]:
            keep = _upper(norm_q[part[i]], norm_x[j], np.einsum("ij,ij->i", fq[part[i]], fx[j])) >= beat[i]
            i, j = i[keep], j[keep]
        score = np.clip((exact_x[j] * exact_q[part[i]]).sum(1), LEAST, MOST).astype(np.int64) if len(i) and safe else np.array(
            [max(LEAST, min(MOST, int(s))) for s in (exact_x[j] * exact_q[part[i]]).sum(1)] if len(i) else [], np.int64)
        order = np.lexsort((ids[j], ~score, i))  # not minus: the least of 64 bits has no opposite
        i, j, score = i[order], j[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        out.append((query_ids[part[i[rank < k]]], ids[j[rank < k]], score[rank < k]))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3))


def _upper(norm_q, norm_x, product):
    """The inner product that a distance lower bound leaves, with room for rounding."""
    lowest = norm_q + norm_x - 2 * product
    return (norm_q + norm_x - lowest) / 2 + 1e-9 * (norm_q + norm_x) + 1e-6


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, v)``: components as ``floor(scale * x)``, usable vectors only, one per id."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * float(scale)).cast("long"))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select(
        F.col("vec_id").cast("long"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``(query_id, rank, vec_id, score)`` for the rows that ``is_query`` picks."""
    rows = cut(integers(vectors, scale))
    asked = rows.filter(is_query)
    blocks = lambda n, size: max(1, -(-n // size))
    n, m = blocks(rows.count(), BLOCK), blocks(asked.count(), QUERY_BLOCK)
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    at = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    left = rows.select(at(n).alias("b"), each(m).alias("c"), "vec_id", "v").groupBy("b", "c")
    right = asked.select(each(n).alias("b"), at(m).alias("c"), "vec_id", "v").groupBy("b", "c")

    def meet(x: pa.Table, q: pa.Table) -> pa.Table:
        found = (np.zeros(0, np.int64),) * 3
        if x.num_rows and q.num_rows:
            width = max(int(t.column("v").combine_chunks().value_lengths().to_numpy(zero_copy_only=False).max()) for t in (x, q))
            found = block_top(x.column("vec_id").to_numpy(), _matrix(x.column("v"), width),
                              q.column("vec_id").to_numpy(), _matrix(q.column("v"), width), k)
        return pa.table(dict(zip(("query_id", "vec_id", "score"), found, strict=True)))

    best = left.cogroup(right).applyInArrow(meet, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
