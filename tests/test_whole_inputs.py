"""Queries that name a table take all of its rows."""

from pyspark.sql import functions as F

from graphloom.plans import catalog as C, derived as D


def test_every_surface_of_the_predictions_is_an_instance(spark, folder):
    t = D.Tables(spark, folder)
    want = D.kg_pred(t).select(F.explode(F.array("h", "t")).alias("surface")).groupBy("surface").agg(F.count(F.lit(1)).alias("freq"))
    got = C.instance_inputs(t).select("surface", "freq")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_every_case_has_its_record_lists(spark, folder):
    t = D.Tables(spark, folder)
    per = C.record_lists(t).groupBy("case_id").agg(F.sum(F.size("pred")).alias("n_pred"), F.sum(F.size("gold")).alias("n_gold"))
    n_gold = D.kg_gold(t).count()
    want = {r["case_id"]: (r["n"], n_gold) for r in D.kg_pred(t).groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r["case_id"]: (r["n_pred"], r["n_gold"]) for r in per.collect()} == want
