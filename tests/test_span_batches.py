"""Records scored many at once score as each does alone."""

import random

import numpy as np
import pyarrow as pa
import pytest

from graphloom.operators import spans as SP


def _record(rng, words, longest):
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 1, 2, 3, 4, 11)))) for _ in range(12)]
    rows = [[rng.choice(texts) for _ in range(3)] for _ in range(rng.randint(0, longest))]
    return rows, [rng.choice(rows) if rows and rng.random() < 0.5 else [rng.choice(texts) for _ in range(3)] for _ in range(rng.randint(0, longest))]


@pytest.mark.parametrize("longest", [3, 8, 12])
def test_batches_score_as_single_records(longest):
    rng = random.Random(longest)
    records = [_record(rng, ["a", "b", "c", "cannot", "can", "not", "f"], longest) for _ in range(60)]
    kind = pa.list_(pa.list_(pa.string()))
    got = SP.many_scores(pa.array([p for p, _ in records], kind), pa.array([g for _, g in records], kind))
    want = [SP.record_scores(p, g) for p, g in records]
    assert np.abs(got - np.array(want)).max() < 1e-12


def test_work_on_a_batch_is_by_pattern_not_by_pair(monkeypatch):
    calls = []
    plain = SP._class_of
    monkeypatch.setattr(SP, "_class_of", lambda r, c: calls.append(1) or plain(r, c))
    records = [[[f"name {k} x{j}", "r", f"thing {k + j}"] for j in range(6)] for k in range(200)]
    data = pa.array(records, pa.list_(pa.list_(pa.string())))
    assert SP.many_scores(data, data).min() == 1.0
    assert len(calls) < 100


def test_word_forms_are_looked_up_and_unfit_triples_left_out(spark):
    rows = [([["A_b", "birthPlace", "C"], [" ", "r", "c"], ["x", None, "y"], ["x", "y"]], [["A b", "birth_place", "c"]]), (None, [["a", "b", "c"]])]
    df = spark.createDataFrame(rows, "pred array<array<string>>, gold array<array<string>>")
    assert [r["exact"] for r in SP.span_scores(df).collect()] == [1.0, 0.0]
