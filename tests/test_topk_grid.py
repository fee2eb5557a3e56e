"""The grid top-k on views of one table, and unit vectors."""

import pytest
from pyspark.sql import functions as F

from graphloom.functions import vectors as VF
from graphloom.operators import retrieval as R, schemas as S
from graphloom.plans import derived as D


def _rows(df):
    """Equal up to the last of twelve digits, which sums of other block sizes may round otherwise."""
    return sorted((r["qid"], r["rank"], r["name"], round(r["score"], 9)) for r in df.collect())


def test_both_sides_of_one_table(spark, folder, monkeypatch):
    t = D.Tables(spark, folder)
    kinds = dict(types=("head_type", "tail_type"), penalty=0.2)
    want = _rows(R.top_k(D.mixed_vectors(t), D.vectors(t), 5, **kinds))
    assert _rows(R.top_k(D.mixed_vectors(t), D.vectors(t), 5, broadcast_bytes=0, block_rows=16, **kinds)) == want
    monkeypatch.setattr(R, "STRIP_BYTES", 1)
    assert _rows(R.top_k(D.mixed_vectors(t), D.vectors(t), 5, broadcast_bytes=0, block_rows=16, **kinds)) == want


def test_nearest_other_on_the_grid(spark, folder, monkeypatch):
    t = D.Tables(spark, folder)
    want = S.semantic_redundancy(D.vector_pool(t)).first()
    monkeypatch.setattr(R, "fits_broadcast", lambda *_: False)
    got = S.semantic_redundancy(D.vector_pool(t)).first()
    assert got["n_relations"] == want["n_relations"] and got["redundancy"] == pytest.approx(want["redundancy"])


def test_unit_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), (None,), ([],)], "v array<double>")
    assert [r[0] for r in rows.select(VF.l2_normalize(F.col("v"))).collect()] == [[0.6, 0.8], [0.0, 0.0], None, []]
    text = rows.select(VF.l2_normalize(F.col("v")).alias("u"))._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("SQRT(") == 1


def test_redundant_pairs_by_strips(spark, folder, monkeypatch):
    t = D.Tables(spark, folder)
    rows = lambda df: sorted((r["a"], r["b"], round(r["score"], 9)) for r in df.collect())
    want = rows(S.redundant_pairs(D.vector_pool(t), 0.85))
    assert want and rows(S.redundant_pairs(D.vector_pool(t), 0.85, batch=7)) == want
    monkeypatch.setattr(S, "STRIP_BYTES", 1)
    assert rows(S.redundant_pairs(D.vector_pool(t), 0.85, batch=30)) == want
    empty = D.vector_pool(t).limit(0)
    assert S.redundant_pairs(empty, 0.85).count() == 0


def test_copies_do_not_follow_blocks(spark, folder):
    t = D.Tables(spark, folder)
    text = S.redundant_pairs(D.vector_pool(t), 0.85, batch=2)._jdf.queryExecution().optimizedPlan().toString()
    assert "pmod(xxhash64(ord" in text and ", 42), 8)" in text  # 8 strips on 8 cores instead of a strip for every two rows
