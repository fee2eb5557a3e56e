"""What is told per record stays where the record's rows met: triples are not shuffled again by record or pair."""

import re

import pytest

from graphloom.operators import errors as E, setmetrics as M
from graphloom.plans import catalog as C, derived as D


def by_record(df):
    """The shuffles that an operator adds to those of the views."""
    return re.findall(r"Exchange hashpartitioning\(item_id.*ENSURE_REQUIREMENTS", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["error_funnel", "retrieval_recall_at_k", "sd_relation_match", "flip_pairs", "flip_confusions", "oie_miss_buckets", "oie_miss_by_triples", "oie_miss_compare"])
def test_records_are_judged_without_a_shuffle_of_their_triples(spark, folder, name):
    assert not by_record(C.QUERIES[name](spark, folder))


def test_views_of_a_record_share_one_shuffle(spark, folder):
    t = D.Tables(spark, folder)
    df = E.flip_summary(D.kg_gold(t), D.kg_trace(t), 1, 2)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert len(re.findall(r"(?<!ReusedExchange )Exchange hashpartitioning\(l_orderkey", plan)) - plan.count("ReusedExchange [l_orderkey") == 1


def test_lines_are_numbered_before_parts_drop_out_or_repeat(spark, tmp_path):
    lines = [(1, 1, 7, 5), (1, 2, 9, 5), (1, 3, 8, 5), (2, 1, 8, 5)]
    spark.createDataFrame([(o, n, p, s, 1.0, 1) for o, n, p, s in lines], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, "
                          "l_extendedprice double, l_shipdate int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, "a"), (8, "b"), (8, None)], "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    got = D.numbered_lines(D.Tables(spark, str(tmp_path)), "p_name").select("l_orderkey", "k", "p_name").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, [(1, 1, "a"), (1, 3, "b"), (1, 3, None), (2, 1, "b"), (2, 1, None)]))


def test_triples_meet_once_for_all_cases(spark, folder):
    df = C.QUERIES["exact_triple_macro"](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not by_record(df) and "SortMergeJoin [case_id" not in plan
    assert len(re.findall(r"Exchange hashpartitioning\([^)]*triple", plan)) == 1


def test_exact_triples_of_odd_rows(spark):
    gold = spark.createDataFrame([(1, "A", "r", "b"), (1, "a", "R", "B"), (2, "a", "r", "b"), (None, "a", "r", "b"), (1, "x", None, "y")],
                                 "item_id long, h string, r string, t string")
    pred = spark.createDataFrame([(5, 1, "a", "r", "b"), (5, None, "a", "r", "b"), (5, 3, "z", "r", "z")], "case_id long, item_id long, h string, r string, t string")
    for cases in (None, (5, 6)):
        got = M.exact_triple_macro(pred, gold, cases).collect()
        assert [(r["case_id"], r["n_classes"], round(r["precision"], 6), round(r["recall"], 6)) for r in got] == [(5, 3, round(0.5 / 3, 6), round(1 / 9, 6))]
