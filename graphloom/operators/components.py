"""Connected components by alternating large-star and small-star steps.

Nodes are numbered in the order of their names first, so that the steps move and compare numbers. Neighbour lists are never
collected: each step is a minimum per node (combined before the shuffle) and one equi-join. A node of more than ``heavy`` edges, of
which there are few, has its minimum broadcast, so that no task holds the edges of a node that touches a third of them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.operators.growth import order_number
from graphloom.session import cut_lineage

HEAVY, MOST_HEAVY = 50_000, 10_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(
        F.struct(F.col("a"), F.col("b")), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    ).select("e.a", "e.b")


def _look_up(rows: DataFrame, key: str, table: DataFrame, heavy: int | None) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row per ``key``; keys of more than ``heavy`` rows are broadcast.

    Without ``heavy`` there is no such key.
    """
    if heavy is None:
        return rows.join(table, key)
    often = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > heavy).select(key)
    hot = cut_lineage(table.join(F.broadcast(often), key))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table, key)
    return rest.unionByName(rows.join(F.broadcast(hot), key).select(rest.columns))


def _large_star(edges: DataFrame, heavy: int | None) -> DataFrame:
    both = _both_ways(edges)
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return _look_up(both, "a", low, heavy).filter(F.col("b") > F.col("a")).select(
        F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame, heavy: int | None) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = _look_up(down, "a", low, heavy).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.withColumnRenamed("m", "b")).filter("a <> b").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, heavy: int | None = None) -> DataFrame:
    """``nodes(id)``, ``edges(a, b)`` undirected -> ``(id, component)`` with the smallest member as name.

    It ends when every edge leads straight to a node that leads nowhere lower, and each node has one edge: a star per
    component, which another step would return unchanged. ``heavy`` is by default such that at most ``MOST_HEAVY`` nodes have more edges.
    """
    named = cut_lineage(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    n = named.count()
    heavy = max(HEAVY, 2 * n // MOST_HEAVY) if heavy is None else heavy
    many = heavy if n > heavy else None
    number = order_number(named.select(F.explode(F.array("a", "b")).alias("id")).distinct(), ["id"], "n")
    cur = _look_up(named, "a", number.withColumnRenamed("id", "a"), many).select(F.col("n").alias("x"), "b")
    cur = cut_lineage(_look_up(cur, "b", number.withColumnRenamed("id", "b"), many).select(F.col("x").alias("a"), F.col("n").alias("b")))
    done, most = _state(cur)
    while not done:
        many = heavy if most > heavy else None
        cur = cut_lineage(_small_star(cut_lineage(_large_star(cur, many)), many))
        done, most = _state(cur)
    many = heavy if most > heavy else None
    root = cur.join(number.withColumnRenamed("n", "a"), "a").select("id", "b")
    root = _look_up(root, "b", number.select(F.col("n").alias("b"), F.col("id").alias("root")), many).select("id", "root")
    return nodes.select("id").distinct().join(root, "id", "left").select(
        "id", F.coalesce("root", "id").alias("component"))


def _state(edges: DataFrame) -> tuple[bool, int]:
    """Whether the edges are stars, and the most edges of a node.

    Edges run from the larger end ``a`` to the smaller ``b``; in stars no node is a start twice, or a start and an end.
    """
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("a").alias("id"), F.lit(1).alias("out"), F.lit(0).alias("in")),
        F.struct(F.col("b").alias("id"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e")).select("e.*")
    per = ends.groupBy("id").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    row = per.agg(F.count(F.when((F.col("out") > 1) | (F.col("out") > 0) & (F.col("in") > 0), 1)).alias("bad"),
                  F.max(F.col("out") + F.col("in")).alias("most")).first()
    return row["bad"] == 0, row["most"] or 0
