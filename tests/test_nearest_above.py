"""The nearest other point above a threshold, by strips."""

import numpy as np
import pytest

from graphloom.operators import schemas as S


@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_same_as_all_pairs(spark, spread):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(5, 8))[rng.integers(0, 5, 700)] + spread * rng.normal(size=(700, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[:20] = v[20:40]  # equal scores go to the lower number
    df = spark.createDataFrame([(int(i), x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    s = np.round(v @ v.T, 12)
    np.fill_diagonal(s, -1)
    want = {i: int(s[i].argmax()) for i in range(len(v)) if s[i].max() > 0.9}
    got = S.nearest_above(df, 0.9, strip_bytes=1)
    assert {r["id"]: r["other"] for r in got.collect()} == want


def test_linkage_sends_no_table_of_clusters_through_the_driver(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def refuse(self):
        raise AssertionError("clusters collected on the driver")

    monkeypatch.setattr(DataFrame, "toPandas", refuse)
    df = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.99, 0.1]), (2, "c", [0.0, 1.0])], "ord long, name string, vec array<double>")
    assert {r["name"]: r["cluster"] for r in S.average_linkage_clusters(df, 0.8).collect()} == {"a": "a", "b": "a", "c": "c"}
