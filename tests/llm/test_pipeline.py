"""Stages of the corpus pipeline on their own."""

from __future__ import annotations

import corpus_pipeline
from graphloom.llm import near_duplicates


def test_near_copies_between_080_and_085_are_dropped(spark):
    base = [f"w{i}" for i in range(104)]
    near, far = list(base), list(base)
    for at in (20, 80):
        near[at] = f"x{at}"
    for at in (20, 50, 80):
        far[at] = f"y{at}"
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (base, near, far)]
    likeness = [len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
    assert 0.80 <= likeness[0] < 0.85 and likeness[1] < 0.80
    rows = [(i, " ".join(w), "en", "s", 1) for i, w in enumerate((base, near, far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 2]
    assert near_duplicates.near_duplicates(docs).filter("kept").count() == 3
