"""Edges of operators: components beyond 64 bits, and columns that share names with inner ones."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from graphloom.llm import substrings, topk, toxicity

LEAST, MOST = -(1 << 63), (1 << 63) - 1


def test_scores_beyond_64_bits_are_held_at_their_ends(spark):
    rng = random.Random(6)
    sizes = [1.0, 1e5, 1e7, 1e9, 1e15, 1e17, 1e300]
    rows = [(i, [rng.choice((-1, 1)) * rng.random() * rng.choice(sizes) for _ in range(5)]) for i in range(300)]
    rows += [(i, [-rng.choice(sizes[4:])] * 5) for i in range(300, 310)]
    hold = lambda x: max(LEAST, min(MOST, x))
    vec = {i: [hold(math.floor(1024 * x)) for x in v] for i, v in rows}
    want = set()
    for q in (0, 100, 200, 300):
        scored = sorted((-hold(sum(a * b for a, b in zip(vec[q], v))), i) for i, v in vec.items() if i != q)
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:10])}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()} == want


def test_replace_texts_leaves_other_columns_alone(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    rows = [(1, f"a {passage} b", 7, "k1", "t1", "r1", 5), (2, f"c {passage} d", 8, "k2", "t2", "r2", 6), (3, None, None, "k3", "t3", None, None),
            (None, passage, 9, "k4", "t4", "r4", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int, key string, kept_text string, `row` string, `n removed` int")
    out = substrings.replace_texts(df)
    assert out.schema == df.schema
    got = {r["key"]: tuple(r) for r in out.collect()}
    assert got["k2"] == (2, "c d", 3, "k2", "t2", "r2", 6) and [got[r[3]] for r in (rows[0], rows[2], rows[3])] == [rows[0], rows[2], rows[3]]
    assert substrings.replace_texts(df.limit(0)).count() == 0


def test_thresholds_go_where_the_labels_put_them():
    step = toxicity.np.arange(-400, 400)
    for edge in (-390, -100, 0, 300):
        clean, toxic = (step < edge) * 5, (step >= edge) * 5
        at = toxicity._threshold(step, clean, toxic)
        assert abs(math.log(at / (1 - at)) * toxicity.STEPS - edge) <= 1
