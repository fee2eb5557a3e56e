"""Greedy matching of open triples: one shuffle by record, the same figures by joins on pairs."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions.vectors import HASH_DIM, hash_rows, hashing_vector
from graphloom.operators import setmetrics as M
from graphloom.plans import derived as D


def _inputs(spark, seed=3):
    rng = random.Random(seed)
    words = ["red ring", "red rings", "blue bolt", "green gear", "blue bolts", "green gears x", "", None]
    gold = [(item, k, rng.choice(words), "r", rng.choice(words)) for item in range(14) for k in range(rng.randint(0, 5))]
    pred = [(c, item, k, rng.choice(words), "r", rng.choice(words)) for c in (1, 2, 4) for item in range(3, 17) for k in range(rng.randint(0, 5))]
    cols = "item_id long, pos long, h string, r string, t string"
    return spark.createDataFrame(pred, "case_id long, " + cols), spark.createDataFrame(gold, cols)


def _rows(df):
    return sorted((r["case_id"], r["item_id"], r["n_pred"], r["n_gold"], sorted([1.0] * r["n_equal"] + r["near"])) for r in df.collect())


@pytest.mark.parametrize("texts", [M.entity_texts, M.triple_texts])
def test_both_ways_agree(spark, folder, texts):
    t = D.Tables(spark, folder)
    small = F.col("item_id") < 400
    for pred, gold in (_inputs(spark), (D.kg_pred(t).filter(small), D.kg_gold(t).filter(small))):
        for least in (0.3, 0.8):
            short, long = (_rows(M.open_matches(pred, gold, texts, hashing_vector, least, (1, 2, 3), n)) for n in (1, M.RECORD_ROWS + 1))
            assert [r[:4] for r in short] == [r[:4] for r in long]
            assert [x for r in short for x in r[4]] == pytest.approx([x for r in long for x in r[4]], abs=1e-9)


def test_one_shuffle_by_record(spark):
    pred, gold = _inputs(spark)
    plan = M.open_sweep(pred, gold, M.entity_texts, hashing_vector, 0.5, 0.95, 0.05, (1, 2), 9)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 3, plan  # by record, by case and reached threshold, by case and threshold


def test_runs_of_bounded_size(spark, monkeypatch):
    pred, gold = _inputs(spark)
    whole = _rows(M.open_matches(pred, gold, M.triple_texts, hashing_vector, 0.3, (1, 2), 1))
    monkeypatch.setattr(M, "_PAIRS", 7)
    assert _rows(M.open_matches(pred, gold, M.triple_texts, hashing_vector, 0.3, (1, 2), 1)) == whole


def test_vectors_of_odd_texts():
    texts = ["", None, "a", "ab", "\U0001f600é", "a" * 1000]
    for t, v in zip(texts, hash_rows(texts), strict=True):
        s = f" {t or ''} "
        want = [0.0] * HASH_DIM
        for x, y, z in zip(s, s[1:], s[2:]):
            want[(ord(x) * 961 + ord(y) * 31 + ord(z)) % HASH_DIM] += 1
        size = sum(x * x for x in want) ** 0.5
        assert v.tolist() == pytest.approx([x / size if size else 0.0 for x in want])
    assert hash_rows([]).shape == (0, HASH_DIM) and hash_rows([None]).tolist() == [[0.0] * HASH_DIM]
