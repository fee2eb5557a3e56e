"""Similarity retrieval: exact cosine top-k against a schema, with type penalties and cluster extras.

A schema is a table of named unit vectors with an insertion order. It is normally small, so it is packed
into one matrix, broadcast after a size check, and every query batch is scored with one matrix product.
Beyond the broadcast limit the same kernel runs on a grid: strips of query blocks meet strips of schema blocks, each of
bounded size, each cell keeps its own k best, and a ranked window merges them. A row is copied once per strip of the other
side, not once per block. Both ways are exact; ties go to the earlier schema element.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.functions.vectors import DIGITS, dot, l2_normalize, matrix
from graphloom.session import BROADCAST_BYTES, fits_broadcast

BLOCK_ROWS = 4096
TILE_ROWS, TILE_COLUMNS = 512, 4096
STRIP_BYTES = 16 << 20  # vectors of one side that a task of the grid holds


def penalty_matrix(q_types, s_types, weight, blanks_match):
    """Penalty matrix: ``weight`` where any type differs; with ``blanks_match`` empty types never differ."""
    hit = np.zeros((len(q_types[0]), len(s_types[0])), dtype=bool)
    for q, s in zip(q_types, s_types):
        number: dict = {}
        q, s = (np.array([-1 if blanks_match and not x else number.setdefault(x, len(number)) for x in side], dtype=np.int64) for side in (q, s))
        differ = q[:, None] != s[None, :]
        if blanks_match:
            differ &= (q >= 0)[:, None] & (s >= 0)[None, :]
        hit |= differ
    return hit * weight


def _best(scores, k):
    """Row, column and rank of the k best of each row; columns are in schema order, so ties stay stable."""
    n = scores.shape[1]
    k = min(k, n)
    kth = np.partition(scores, n - k, axis=1)[:, n - k]
    rows, cols = np.nonzero(scores >= kth[:, None])
    order = np.lexsort((cols, -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    rank = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    keep = rank < k
    return rows[keep], cols[keep], rank[keep] + 1


def _score(q_vec, q_types, s_vec, s_types, weight, blanks_match):
    scores = q_vec @ s_vec.T
    if weight and q_types:
        scores -= penalty_matrix(q_types, s_types, weight, blanks_match)
    return scores


def _best_tiled(q_vec, q_types, s_vec, s_types, weight, blanks_match, k, tile_rows=TILE_ROWS, tile_columns=TILE_COLUMNS):
    """Row, column, score and rank of the k best of each row, from tiles of bounded size.

    Of each tile only what can beat the k-th best so far is rounded and ranked; an equal score comes later and so is no better.
    """
    out = []
    for a in range(0, len(q_vec), tile_rows):
        q, kinds = q_vec[a:a + tile_rows], [t[a:a + tile_rows] for t in q_types]
        r, c, v, rank = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        least = np.full(len(q), -np.inf)
        for b in range(0, len(s_vec), tile_columns):
            tile = _score(q, kinds, s_vec[b:b + tile_columns], [t[b:b + tile_columns] for t in s_types], weight, blanks_match)
            if b:
                rows, cols = np.nonzero(tile >= (least - 10.0 ** -(DIGITS - 1))[:, None])
                scores = np.round(tile[rows, cols], DIGITS)
                better = scores > least[rows]
                rows, cols, scores = rows[better], cols[better], scores[better]
            else:
                tile = np.round(tile, DIGITS)
                rows, cols, _ = _best(tile, k)
                scores = tile[rows, cols]
            if not len(rows):
                continue
            r, c, v = np.concatenate((r, rows)), np.concatenate((c, cols + b)), np.concatenate((v, scores))
            order = np.lexsort((c, -v, r))
            r, c, v = r[order], c[order], v[order]
            rank = np.arange(len(r)) - np.searchsorted(r, r, side="left")
            keep = rank < k
            r, c, v, rank = r[keep], c[keep], v[keep], rank[keep]
            least[r[rank == k - 1]] = v[rank == k - 1]
        out.append((r + a, c, v, rank + 1))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _schema_size(schema: DataFrame):
    row = schema.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    return row["n"] or 0, row["d"] or 0


def top_k(queries: DataFrame, schema: DataFrame, k: int = 5, *, query_id: str = "qid", types=(),
          penalty: float = 0.0, blanks_match: bool = False, broadcast_bytes: int = BROADCAST_BYTES,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``queries(query_id, vec, *types)`` x ``schema(ord, name, vec, *types)`` -> the k best per query.

    Returns ``(query_id, name, ord, score, rank)``. ``types`` names columns present on both sides: a
    difference in any of them costs ``penalty`` (relations: blanks differ too; entity types: blanks match).
    """
    types = list(types)
    qtype = dict(queries.dtypes)[query_id]
    out = f"{query_id} {qtype}, name string, ord bigint, score double, rank int"
    queries = queries.select(query_id, "vec", *types)
    schema = schema.select("ord", "name", "vec", *types)
    n, dim = _schema_size(schema)
    if n == 0:
        return queries.sparkSession.createDataFrame([], out)
    if fits_broadcast(n, 8 * dim + 64 * (1 + len(types)), broadcast_bytes):
        return _top_k_broadcast(queries, schema, k, query_id, types, penalty, blanks_match, out)
    return _top_k_grid(queries, schema, n, dim, k, query_id, types, penalty, blanks_match, out, block_rows)


def _top_k_broadcast(queries, schema, k, query_id, types, penalty, blanks_match, out):
    rows = schema.orderBy("ord").toPandas()
    packed = queries.sparkSession.sparkContext.broadcast((
        np.stack(rows["vec"].to_numpy()).astype(np.float64),
        rows["name"].to_numpy(dtype=object), rows["ord"].to_numpy(dtype=np.int64),
        [rows[t].to_numpy(dtype=object) for t in types],
    ))

    def score(batches):
        s_vec, names, ords, s_types = packed.value
        for b in batches:
            if b.num_rows == 0:
                continue
            q_types = [b.column(t).to_pylist() for t in types]
            r, c, v, rank = _best_tiled(matrix(b.column("vec")), q_types, s_vec, s_types, penalty, blanks_match, k)
            yield pa.RecordBatch.from_arrays(
                [b.column(query_id).take(pa.array(r)), pa.array(names[c], pa.string()), pa.array(ords[c]),
                 pa.array(v), pa.array(rank.astype(np.int32))],
                names=[query_id, "name", "ord", "score", "rank"])

    return queries.mapInArrow(score, out)


def _top_k_grid(queries, schema, n, dim, k, query_id, types, penalty, blanks_match, out, block_rows):
    # both sides may be views of one table, whose columns a cogroup could not tell apart
    queries, schema = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (queries, schema))
    size, strip = queries.count(), max(block_rows, STRIP_BYTES // (8 * max(1, dim)))
    s_blocks = -(-n // strip)
    cells = 4 * queries.sparkSession.sparkContext.defaultParallelism
    q_blocks = max(1, -(-size // strip), min(-(-size // block_rows), -(-cells // s_blocks)))
    q = (queries.withColumn("qb", F.pmod(F.xxhash64(query_id), F.lit(q_blocks)).cast("bigint"))
         .withColumn("sb", F.explode(F.sequence(F.lit(0), F.lit(s_blocks - 1)))))
    s = (schema.withColumn("sb", F.pmod(F.xxhash64("ord"), F.lit(s_blocks)).cast("int"))
         .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(q_blocks - 1).cast("bigint")))))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        names = [query_id, "name", "ord", "score", "rank"]
        if left.num_rows == 0 or right.num_rows == 0:
            kinds = [left.schema.field(query_id).type, pa.string(), pa.int64(), pa.float64(), pa.int32()]
            return pa.table([pa.array([], t) for t in kinds], names=names)
        right = right.sort_by("ord")
        r, c, v, rank = _best_tiled(
            matrix(left.column("vec")), [left.column(t).to_pylist() for t in types],
            matrix(right.column("vec")), [right.column(t).to_pylist() for t in types], penalty, blanks_match, k,
            min(TILE_ROWS, block_rows), min(TILE_COLUMNS, block_rows))
        return pa.table([left.column(query_id).take(pa.array(r)), right.column("name").take(pa.array(c)),
                         right.column("ord").take(pa.array(c)), pa.array(v),
                         pa.array(rank.astype(np.int32))], names=names)

    parts = q.groupBy("qb", "sb").cogroup(s.groupBy("qb", "sb")).applyInArrow(cell, out)
    w = W.partitionBy(query_id).orderBy(F.desc("score"), "ord")
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def item_and_cluster(queries: DataFrame, schema: DataFrame, clusters: DataFrame, k: int = 5, *,
                     query_id: str = "qid", types=(), penalty: float = 0.0, blanks_match: bool = False,
                     top_m: int = 2, extra_k: int = 3) -> DataFrame:
    """Item top-k followed by cluster extras; extras are ranked after the items."""
    types = list(types)
    items = top_k(queries, schema, k, query_id=query_id, types=types, penalty=penalty, blanks_match=blanks_match)
    cents = clusters.select(F.col("cluster").alias("ord"), F.col("cluster").cast("string").alias("name"),
                            F.col("centroid").alias("vec")).dropDuplicates(["ord"])
    near = top_k(queries, cents, top_m, query_id=query_id).select(query_id, F.col("ord").alias("cluster"))
    pairs = near.join(clusters.select("cluster", "name"), "cluster").join(
        items.select(query_id, "name"), [query_id, "name"], "left_anti")
    right = schema.select("name", "ord", F.col("vec").alias("s_vec"), *[F.col(t).alias(f"s_{t}") for t in types])
    scored = pairs.join(queries.select(query_id, "vec", *types), query_id).join(right, "name")
    differ = F.lit(False)
    for t in types:
        d = ~F.col(t).eqNullSafe(F.col(f"s_{t}"))
        if blanks_match:
            d = d & (F.coalesce(F.col(t), F.lit("")) != "") & (F.coalesce(F.col(f"s_{t}"), F.lit("")) != "")
        differ = differ | d
    scored = scored.withColumn("score", dot("vec", "s_vec") - F.when(differ, F.lit(penalty)).otherwise(0.0))
    w = W.partitionBy(query_id).orderBy(F.desc("score"), "ord")
    extra = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= extra_k)
    cols = [query_id, "name", "ord", "score", "rank", "source"]
    base = F.least(F.lit(k), F.lit(schema.count())).cast("int")
    return (items.withColumn("source", F.lit("item")).select(cols)
            .unionByName(extra.withColumn("source", F.lit("cluster")).withColumn("rank", F.col("rank") + base)
                         .select(cols)))


def nearest(queries: DataFrame, schema: DataFrame, threshold: float | None = None, *,
            query_id: str = "qid") -> DataFrame:
    """Best schema element per query; ``aligned`` is its name when the score reaches the threshold."""
    best = top_k(queries, schema, 1, query_id=query_id)
    aligned = F.col("name") if threshold is None else F.when(F.col("score") >= threshold, F.col("name"))
    return best.select(query_id, "name", "score", aligned.alias("aligned"))


def nearest_other(schema: DataFrame) -> DataFrame:
    """For every element the highest cosine to a different element: ``(name, score)``."""
    best = top_k(schema.withColumnRenamed("name", "qname").withColumn("qid", F.col("ord")), schema, 2)
    return (best.filter(F.col("qid") != F.col("ord")).groupBy("qid").agg(F.max("score").alias("score")))


def demonstrations(queries: DataFrame, pool: DataFrame, k: int = 5, *, query_id: str = "qid") -> DataFrame:
    """Nearest demonstration rows rendered as numbered example blocks: ``(query_id, examples)``.

    ``pool(ord, name, vec, text, triples)``; ``triples`` is the rendered triple list of the row.
    """
    hits = top_k(queries, pool, k, query_id=query_id).join(
        pool.select(F.col("ord"), "text", "triples"), "ord")
    block = F.format_string("Example %d\nText: %s\nTriples: %s", "rank", "text", "triples")
    ordered = F.array_sort(F.collect_list(F.struct("rank", block.alias("b"))))
    return hits.groupBy(query_id).agg(
        F.array_join(F.transform(ordered, lambda s: s["b"]), "\n\n").alias("examples"))


def schema_text(name, definition, aliases, examples):
    """Searchable text of a schema element: name, definition, aliases and examples."""
    listed = [F.concat_ws(" ", c) for c in (aliases, examples)]
    return F.concat_ws(". ", name, *[F.nullif(c, F.lit("")) for c in (F.coalesce(definition, F.lit("")), *listed)])


def instruct_text(task: str, text):
    """Task-prefixed query text for instruction-tuned embedders."""
    return F.concat(F.lit(f"Instruct: {task}\nQuery: "), text)


__all__ = ["top_k", "item_and_cluster", "nearest", "nearest_other", "demonstrations",
           "schema_text", "instruct_text", "l2_normalize"]
