"""Thresholds of ``toxicity`` come from all labelled texts that are neither held out nor trained on."""

from __future__ import annotations

import random

from graphloom.llm import toxicity


def test_rare_languages_and_long_texts_are_calibrated(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PER_CLASS", {0: 300, 1: 150})
    r = random.Random(9)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(2400):
        lang = "es" if i % 24 == 0 else "ll" if i % 24 == 1 else "en"
        toxic = i // 24 % 3 == 0 if lang != "en" else i % 3 == 0
        w = [r.choice(plain) for _ in range(r.randint(10, 40) if lang != "ll" else 5000)]
        w[3:3] = ["vilo", "grumt"] if toxic else ["vilo"] if lang == "es" else []
        rows.append((i, " ".join(w), lang))
        labels.append((i, int(toxic)))
    assert min(len(t) for _, t, x in rows if x == "ll") > 20_000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.train(df, lab)
    assert set(net.thresholds) == {"en", "es", "ll"}
    assert net.thresholds["es"] != 0.5 and net.thresholds["ll"] != 0.5


def test_counts_cover_every_text_not_trained_on(spark):
    rows = [(i, f"w{i} w{i % 7}", "en") for i in range(50)] + [(3, "another text of this id", "de"), (None, "x", "en"), (99, "no label", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ours = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    net = toxicity.fit([t for _, t, _ in rows[:50]], toxicity.np.array([i % 2 for i in range(50)]))
    keys = df.select("doc_id", toxicity.text_key(df["text"]).alias("key"), "text").filter("doc_id < 10 and text like 'w%'").select("doc_id", "key")
    got = toxicity.counts_by_score(df, ours, net, keys).groupBy("lang").sum("clean", "toxic").collect()
    assert {tuple(x) for x in got} == {("en", 20, 20), ("de", 0, 1)}
