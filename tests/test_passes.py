"""How often the queries go over the big tables, read off their plans."""

import re

import pytest

from graphloom.operators import clustering, instances
from graphloom.plans import catalog as C, derived as D


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_instance_surfaces_are_counted_once(spark, folder):
    plan = optimized(C.instance_inputs(D.Tables(spark, folder)))
    assert "Relation" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("name", ["literal_date", "literal_number"])
def test_literals_are_parsed_after_the_surfaces_are_distinct(spark, folder, name):
    above, below = optimized(C.QUERIES[name](spark, folder)).split("Aggregate", 1)
    assert "RLIKE" in above and "RLIKE" not in below


def test_cells_of_labels_are_counted_once(spark, folder):
    plan = optimized(clustering.contingency(C.mentions(D.Tables(spark, folder))))
    assert "Relation" not in plan


def test_triples_are_not_shuffled_by_relation_name(spark, folder):
    assert not by_relation_alone(C.QUERIES["aligned_triple_f1"](spark, folder))


def by_relation_alone(df):
    return re.findall(r"SortMergeJoin \[r#\d+\], \[r#\d+\]", df._jdf.queryExecution().executedPlan().toString())


def test_surfaces_are_folded_in_one_pass(spark, folder):
    plan = optimized(C.fold_canon(D.Tables(spark, folder)))
    assert "Join" not in plan.split("Aggregate", 1)[0]


def test_surfaces_that_stay_are_not_joined(spark):
    triples = spark.createDataFrame([(1, 0, "A", "r", "b"), (1, 1, "a", "r", "b"), (1, 2, "a", "r", "A"), (1, 3, None, "r", "b")],
                                    "item_id long, pos long, h string, r string, t string")
    canon = spark.createDataFrame([("A", "a"), ("a", "a"), ("b", "b")], "surface string, canonical string")
    out = instances.rewrite_triples(triples, canon)
    assert "NOT (surface" in optimized(out)
    assert sorted(map(tuple, out.collect())) == [(1, 0, "a", "r", "b")]
