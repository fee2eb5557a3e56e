"""Loss categories: one shuffle a record, the same rows by joins on pairs, long and odd records."""

from pyspark.sql import functions as F

from graphloom.operators import errors as E
from graphloom.plans import derived as D


def _inputs(spark):
    gold = spark.createDataFrame([
        (1, 0, "Ann Lee", "livesIn", "Rome"), (1, 1, "Ann Lee", "born", "1990-05-02"), (1, 1, "Ann Lee", "born", "1990-05-02"),
        (1, 2, None, "livesIn", "Rome"), (1, 3, "Bob", "knows", "Ann Lee"), (2, 0, "Bob", "knows", "Bob"), (2, 1, "", "is", "x"),
        (3, 0, "Zed", "owns", "Cat"), (4, 0, "no", "text", "here")], "item_id long, pos long, h string, r string, t string")
    found = spark.createDataFrame([
        (1, 0, "Ann  Lee", "livesIn", "rome"), (1, 1, "Ann Lee", "knows", "Bob"), (1, 2, None, "x", "Bob"), (1, 3, "Lee", "born", "1990"),
        (2, 0, "Bob Ray", "knows", "Bob"), (5, 0, "a", "b", "c")], "item_id long, pos long, h string, r string, t string")
    texts = spark.createDataFrame([(1, "Ann Lee lives in Rome since May 2, 1990. She knows it."), (2, "It knows Bob"), (3, None), (6, "alone")],
                                  "item_id long, text string")
    return gold, found, texts


def _rows(df):
    return sorted(map(str, (tuple(r) for r in df.select("item_id", "pos", "h", "r", "t", "text", "category", "swapped", "implicit").collect())))


def test_both_ways_agree(spark, folder):
    t = D.Tables(spark, folder)
    for args in (_inputs(spark), (D.kg_gold(t), D.kg_pred(t, (1,)), D.kg_text(t))):
        short, long = (_rows(E.classify_misses(*args, longest=n)) for n in (1, E.RECORD_ROWS + 1))
        assert short == long == _rows(E.classify_misses(*args))


def test_one_shuffle_a_side(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = E.classify_misses(*_inputs(spark), longest=9)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange ") == 2, plan


def test_label_crosstab_keeps_unlabelled(spark):
    cols = "item_id long, h string, r string, t string, label string"
    labels = spark.createDataFrame([(1, "a", "b", "c", None), (1, "a", "b", "d", "x"), (1, None, "b", "c", "x"), (2, "a", "b", "c", "x")], cols)
    classified = spark.createDataFrame([(1, 0, "a", "b", "c", "one"), (1, 2, "a", "b", "c", "two"), (1, 1, "a", "b", "d", "one"), (1, 1, None, "b", "c", "one")],
                                       "item_id long, pos long, h string, r string, t string, category string")
    got = E.label_crosstab(labels, classified).orderBy(F.col("label")).collect()
    assert [tuple(r) for r in got] == [(None, "two", 1), ("x", "one", 1)]


def test_funnel_both_ways(spark, folder):
    t = D.Tables(spark, folder)
    gold, found, _ = _inputs(spark)
    shown = F.when(F.col("pos") == 1, F.array(F.lit("Knows"), F.lit(None))).when(F.col("pos") == 0, F.array(F.lit("lives in"), F.lit("x")))
    odd = found.withColumn("case_id", F.explode(F.array(F.lit(1), F.lit(2)))).filter("case_id + pos <> 3").withColumn("top_k", shown).withColumn("pred", F.col("r"))
    for g, trace in ((gold, odd), (D.kg_gold(t), D.kg_trace(t))):
        short, long = (sorted(map(tuple, E.error_funnel(g, trace, longest=n).collect())) for n in (1, E.RECORD_ROWS + 1))
        assert short == long
    plan = E.error_funnel(gold, odd, (1, 2), longest=1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2, plan  # by record, by case


def test_flips_meet_in_one_shuffle(spark):
    gold, found, _ = _inputs(spark)
    odd = found.withColumn("case_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn(
        "top_k", F.when(F.col("pos") < 3, F.array(F.lit("livesIn"), F.lit("born")))).withColumn("pred", F.when(F.col("case_id") < 2, F.lit("born")).otherwise(F.col("r")))
    flips = E.paired_flips(gold, odd, 1, 2)
    plan = flips._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1, plan
    got = sorted((r["item_id"], r["nh"], r["nt"], r["gr"], r["kind"]) for r in flips.collect())
    assert got == [(1, "ann_lee", "rome", "lives in", "loser_only")]
    assert [r["kind"] for r in E.paired_flips(gold, odd, 2, 1).collect()] == ["decision_error"]
    ranks = E.gold_rank(gold, odd)
    assert [r["rank"] for r in ranks.filter("matched").collect()] == [1, 1, 1]
    assert ranks.filter("not matched and cands is not null").count() == 0
