"""What growing schemas write and shuffle."""

from pyspark.sql import functions as F

from graphloom.functions.vectors import hashing_vector
from graphloom.operators import canonical as C, growth as G


def test_small_interval_tables_leave_the_occurrences_where_they_are(spark):
    occ = spark.createDataFrame([(1, "a"), (5, "a"), (7, "b"), (9, None)], "position long, qid string")
    iv = spark.createDataFrame([("a", 0, 3, "x"), ("a", 3, 9, "y")], "qid string, since long, until long, names string")
    got = G.decide_as_of(occ, iv, "qid")
    assert sorted((r["position"], r["names"]) for r in got.collect()) == [(1, "x"), (5, "y"), (7, None), (9, None)]
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_numbers_are_written_once(spark, monkeypatch):
    written = []
    plain = G.cut_lineage
    monkeypatch.setattr(G, "cut_lineage", lambda df: written.append(1) or plain(df))
    rows = G.order_number(spark.range(1000).select((-F.col("id")).alias("id")), ["id"]).orderBy("position").collect()
    assert [r["id"] for r in rows] == list(range(-999, 1)) and len(written) == 1


def test_numbered_groups_are_not_numbered_again(spark, monkeypatch):
    groups = spark.createDataFrame([(1, 0, "A", "d", "P", ["x"], 3)], "item_id long, ord long, fine string, definition string, parent string, members array<string>, position long")
    monkeypatch.setattr(G, "order_number", None)
    occ, keys = C.type_signal(groups, next(iter(C.ENTITY_CASES)), hashing_vector)
    assert [r["position"] for r in occ.collect()] == [3] and [r["ord"] for r in keys.collect()] == [3]
