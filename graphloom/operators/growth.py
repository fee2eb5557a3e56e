"""Order-dependent schema growth without a serial pass over the corpus.

Whether an occurrence mints a schema element depends only on the *first* occurrence of its key: once a key
is minted or has been absorbed, the schema only grows and the key stays within reach. So growth is decided
over distinct keys in first-use order, by leader election (:mod:`graphloom.operators.leaders`).
All occurrences are then decided in parallel against the schema as it stood at their position.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graphloom.functions.vectors import DIGITS, matrix
from graphloom.operators.leaders import HEAD, Reach, clusters
from graphloom.operators.retrieval import penalty_matrix
from graphloom.session import broadcast_if_small, cut_lineage

ASOF_ROWS, ASOF_TILE = 4096, 512
INTERVAL_BYTES = 512  # of a candidate list with its names and scores


def leader_clusters(points: DataFrame, threshold: float, *, strict: bool = True, seeds: DataFrame | None = None,
                    block: int = HEAD) -> DataFrame:
    """Greedy leader clustering of ``points(ord, vec)`` in ``ord`` order -> ``(ord, leader)``.

    A point that an earlier leader reaches joins the earliest such leader; otherwise it leads. ``seeds``
    (``ord, vec``) are leaders that exist beforehand; points they reach get the seed's ``ord``.
    """
    return clusters(points.select("ord", "vec"), Reach(threshold, strict), seeds=None if seeds is None else seeds.select("ord", "vec"), head=block)


def cluster_table(points: DataFrame, membership: DataFrame) -> DataFrame:
    """``(cluster, centroid, name)`` per member; the centroid is the normalised mean of the members.

    Means are taken per vector position in parallel (``posexplode`` + ``avg``), so a cluster holding most
    of the points is never gathered as a list of vectors.
    """
    named = points.join(membership, "ord")
    mean = (named.select("leader", F.posexplode("vec")).groupBy("leader", "pos").agg(F.avg("col").alias("x"))
            .groupBy("leader").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v"),
                                   F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")))
    cent = mean.select("leader", F.transform("v", lambda s: F.when(F.col("norm") == 0, s["x"]).otherwise(
        s["x"] / F.col("norm"))).alias("centroid"))
    return named.join(cent, "leader").select(F.col("leader").alias("cluster"), "centroid", "name")


def top_k_as_of(queries: DataFrame, schema: DataFrame, k: int = 5, *, query_id: str = "qid", types=(), penalty: float = 0.0,
                blanks_match: bool = False, block_rows: int = ASOF_ROWS) -> DataFrame:
    """Top-k of a growing schema at every moment it changes, per query.

    ``schema(ord, name, vec, *types)`` where ``ord`` is the position at which the element was minted. Returns
    ``(query_id, since, until, names, scores, n_known)``: the candidate list holds for positions ``p`` with
    ``since < p <= until``; ``n_known`` is the length of the list. The number of intervals per query grows
    with the logarithm of the schema.

    An element that enters the list of the whole schema also enters that of any part it belongs to. So blocks of queries meet
    blocks of the schema, each pair keeps what enters there, and the few elements left are replayed per query in order.
    """
    types = list(types)
    qtype = dict(queries.dtypes)[query_id]
    queries = cut_lineage(queries.select(query_id, F.col("vec").cast("array<double>").alias("vec"), *types))
    # fresh columns: both sides of a cogroup may come from one table
    schema = cut_lineage(schema.select("ord", "name", F.col("vec").cast("array<double>").alias("vec"), *types)).select(
        *[F.col(c).alias(c) for c in ("ord", "name", "vec", *types)])
    nq, ns = (max(1, -(-df.count() // block_rows)) for df in (queries, schema))
    kind = to_arrow_type(queries.schema[query_id].dataType)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("qb", block(query_id, nq)).withColumn("sb", every(ns)).groupBy("qb", "sb")
    right = schema.withColumn("sb", block("ord", ns)).withColumn("qb", every(nq)).groupBy("qb", "sb")

    def meet(q: pa.Table, s: pa.Table) -> pa.Table:
        if not q.num_rows or not s.num_rows:
            return pa.table([pa.array([], t) for t in (kind, pa.int64(), pa.string(), pa.float64())], names=[query_id, "ord", "name", "score"])
        s = s.sort_by("ord")
        s_vec, s_types, out = matrix(s.column("vec")), [s.column(t).to_pylist() for t in types], []
        for a in range(0, q.num_rows, ASOF_TILE):
            part = q.slice(a, ASOF_TILE)
            scores = matrix(part.column("vec")) @ s_vec.T
            if penalty and types:
                scores = scores - penalty_matrix([part.column(t).to_pylist() for t in types], s_types, penalty, blanks_match)
            scores = np.round(scores, DIGITS)
            rows, cols = _entries(scores, k)
            out.append((rows + a, cols, scores[rows, cols]))
        rows, cols, scores = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([q.column(query_id).take(pa.array(rows)), s.column("ord").take(pa.array(cols)), s.column("name").take(pa.array(cols)),
                         pa.array(scores)], names=[query_id, "ord", "name", "score"])

    entries = left.cogroup(right).applyInArrow(meet, f"{query_id} {qtype}, ord long, name string, score double")
    whole = queries.select(query_id).withColumns({"ord": F.lit(None).cast("long"), "name": F.lit(None).cast("string"),
                                                  "score": F.lit(None).cast("double")}).unionByName(entries)
    replayed = whole.withColumn("qb", block(query_id, nq)).groupBy("qb").applyInArrow(
        _replay(query_id, k), f"{query_id} {qtype}, since long, until long, names array<string>, scores array<double>")
    return replayed.select(query_id, "since", "until", "names", "scores", F.size("names").alias("n_known"))


def _entries(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each element that enters the k best of its row when columns come one after the other."""
    best = np.full((len(scores), k), -np.inf)
    rows, cols = [], []
    for j in range(scores.shape[1]):
        hit = np.flatnonzero(scores[:, j] > best[:, -1])
        if hit.size:
            best[hit, -1] = scores[hit, j]
            best[hit] = -np.sort(-best[hit], axis=1)
            rows.append(hit)
            cols.append(np.full(len(hit), j))
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _replay(query_id: str, k: int):
    """Candidate lists of each query of a block over time, from the elements that may enter them."""
    def run(table: pa.Table) -> pa.Table:
        out = {c: [] for c in (query_id, "since", "until", "names", "scores")}
        now, held, since = None, [], -(2 ** 62)

        def close(until):
            for c, v in zip(out, (now, since, until, [h[1] for h in held], [-h[0] for h in held]), strict=True):
                out[c].append(v)

        for r in table.sort_by([(query_id, "ascending"), ("ord", "ascending")]).to_pylist():
            if r[query_id] != now:
                if now is not None:
                    close(2 ** 62)
                now, held, since = r[query_id], [], -(2 ** 62)
            if r["ord"] is None or len(held) == k and r["score"] <= -held[-1][0]:
                continue
            close(r["ord"])
            at = sum(-h[0] >= r["score"] for h in held)
            held = (held[:at] + [(-r["score"], r["name"])] + held[at:])[:k]
            since = r["ord"]
        if now is not None:
            close(2 ** 62)
        return pa.table([pa.array(out[query_id], table.column(query_id).type), pa.array(out["since"], pa.int64()), pa.array(out["until"], pa.int64()),
                         pa.array(out["names"], pa.list_(pa.string())), pa.array(out["scores"], pa.list_(pa.float64()))], names=list(out))

    return run


def order_number(df: DataFrame, columns: list[str], name: str = "position") -> DataFrame:
    """Number rows in the order of ``columns``: range partitions in order, rows in order within each, then written.

    The numbers have gaps but any values of the columns will do, however large. No task sees more than its range.
    """
    placed = df.repartitionByRange(*columns).sortWithinPartitions(*columns)
    return cut_lineage(placed.withColumn(name, F.monotonically_increasing_id()))


def first_use(occurrences: DataFrame, key: str = "relation") -> DataFrame:
    """Distinct keys with the position of their first occurrence: ``(key, ord)``."""
    return occurrences.groupBy(key).agg(F.min("position").alias("ord"))


def decide_as_of(occurrences: DataFrame, intervals: DataFrame, key: str = "relation") -> DataFrame:
    """Attach to each occurrence the candidate list that held at its position.

    The interval table has a few rows per distinct key; it is worked out first and broadcast if it is small, so that the occurrences
    stay where they are. Else a key that owns a third of all occurrences is split by the adaptive skew join.
    """
    iv = broadcast_if_small(cut_lineage(intervals), INTERVAL_BYTES).withColumnRenamed("qid", key)
    on = (occurrences[key] == iv[key]) & (occurrences["position"] > iv["since"]) & (
        occurrences["position"] <= iv["until"])
    return occurrences.join(iv, on, "left").drop(iv[key])
