"""Decontamination against a brute-force form: short and shared items, long runs, several blocks and small shards."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from graphloom.llm import decontaminate as D

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, key string, hits int, items string, lang string"
ITEMS = "item_id long, text string, n int, key string"


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def brute(docs, items, window):
    """Per document: words, hit words, names of items with a window in it, longest match of a test suffix."""
    windows, tails = {}, []
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(name)
            tails.append((w[i:], n))
    sizes = {len(g) for g in windows}
    out = []
    for doc, text in docs:
        w, hit, names, longest = words(text), set(), set(), 0
        for i in range(len(w)):
            for n in sizes:
                g = tuple(w[i:i + n])
                if len(g) == n and g in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[g]
            for tail, n in tails:
                k = 0
                while k < len(tail) and i + k < len(w) and tail[k] == w[i + k]:
                    k += 1
                if k >= n:
                    longest = max(longest, k)
        out.append((doc, len(w), len(hit), sorted(str(x) for x in names if x is not None), longest))
    return out


@pytest.fixture(scope="module")
def tables():
    r = random.Random(3)
    say = lambda n, k=40: " ".join(f"W{r.randrange(k)}" for _ in range(n))
    shared = say(14)
    items = [(i, say(r.randint(10, 60))) for i in range(12)]
    items += [(20, shared + " " + say(5)), (21, say(3) + " " + shared), (20, say(15)), (22, "Short item, of five words"), (23, "solo-x"),
              (24, ""), (25, None), (26, "..."), (None, say(12)), (27, "über straße 日本 " * 5), (3, items[3][1])]
    docs = [None, "", "  ", "solo x", "SOLO!X y", "a short ITEM of five words b", "über-straße 日本 " * 4, say(3000, 3)]
    for _, text in items:
        docs.append(f"{say(r.randint(0, 9))} {text or ''} {say(4)}")
        w = words(text)
        docs.append(" ".join(w[:len(w) // 2]) + "\n" + say(6) + " " + " ".join(w[len(w) // 2:]))
    docs += [docs[12]] * 3 + [shared] * 2
    rows = [(i, t) for i, t in enumerate(docs)] + [(None, docs[12]), (None, "nothing here"), (9, shared + " another text of this id")]
    return rows, items


@pytest.mark.parametrize(("window", "block_words", "shard"), [(10, 1 << 20, 1 << 18), (10, 60, 50), (4, 100, 7), (1, 1 << 20, 33)])
def test_equals_brute_force(spark, tables, window, block_words, shard):
    rows, items = tables
    docs = spark.createDataFrame([(*x, "k", 1, "i", "en") for x in rows], DOCS).repartition(3)
    bench = spark.createDataFrame([(*x, 1, "k") for x in items], ITEMS)
    got = D.contamination(docs, bench, window, block_words, shard).collect()
    want = brute(rows, items, window)
    show = lambda r: (str(r[0]), *map(str, r[1:]))
    assert sorted(show((r.doc_id, r.n_words, r.n_hit, r["items"], r.longest)) for r in got) == sorted(show(r) for r in want)
    for r in got:
        assert sum(h["end"] - h["start"] for h in r["hits"]) == r.n_hit
        assert (r.longest_at is None) == (r.longest == 0)


def test_longest_matches(spark, tables):
    rows, items = tables
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.item_id, r.item_start, r.length, r.places, r.doc_id, r.doc_start)
           for r in D.longest_matches(docs, bench.filter("item_id = 21"), shard=40).collect()}
    w, want = words(dict((k, t) for k, t in items if k == 21)[21]), set()
    texts = [(d, words(t)) for d, t in rows if d is not None]
    for i in range(len(w) - 9):
        found = []
        for d, x in texts:
            for j in range(len(x)):
                k = 0
                while i + k < len(w) and j + k < len(x) and w[i + k] == x[j + k]:
                    k += 1
                if k >= 10:
                    found.append((k, d, j))
        if found:
            top = max(f[0] for f in found)
            at = sorted(f[1:] for f in found if f[0] == top)
            want.add(("21", i, top, len(at), *at[0]))
    assert got == want and want


def test_affected_documents_go_with_all_columns_kept(spark, tables):
    rows, items = tables
    docs = spark.createDataFrame([(*x, "k", 1, "i", "en") for x in rows], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    left = D.decontaminate(docs, bench)
    assert left.columns == docs.columns
    want = sorted(str((d, t)) for (d, t), b in zip(rows, brute(rows, items, 10), strict=True) if not b[2])
    assert sorted(str((r.doc_id, r.text)) for r in left.collect()) == want


def test_empty_tables(spark, tables):
    rows, items = tables
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    none = bench.filter("item_id = -1")
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert {(r.n_hit, r.longest, tuple(r["items"])) for r in D.contamination(docs, none).collect()} == {(0, 0, ())}
    assert D.contamination(docs, bench.filter("item_id = 24")).filter("n_hit > 0").count() == 0
    assert D.longest_matches(docs, none).count() == 0


def test_spans_of_long_items_lose_no_window(spark, monkeypatch):
    r = random.Random(8)
    text = " ".join(f"v{r.randrange(500)}" for _ in range(900))
    w = text.split(" ")
    docs = spark.createDataFrame([(i, " ".join(w[i * 7:i * 7 + 30])) for i in range(100)] + [(1000, text)], "doc_id long, text string")
    bench = spark.createDataFrame([("long", text)], "item_id string, text string")
    monkeypatch.setattr(D, "SPAN", 64)
    assert len(D.spans(bench).collect()) == 14
    got = {r.doc_id: r for r in D.contamination(docs, bench).collect()}
    assert got[1000].n_hit == 900 and all(got[i].n_hit == 30 for i in range(100))


def test_second_hash_takes_false_matches_back(spark, tables):
    """Words whose first hash agrees with a word of the block but whose second does not are unknown."""
    import pyarrow as pa

    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    block = next(D.blocks(bench))
    column = pa.array(["x a b c d e f g h i j y"])
    assert sum(len(f) for _, f in D.Texts(column, block, 100).matches()) == 1
    block.second = block.second ^ np.uint64(1)
    assert list(D.Texts(column, block, 100).matches()) == []


def test_query_digest(spark, folder):
    from graphloom.llm.queries import op11_decontaminate
    from graphloom.llm.common import table

    docs = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, folder, "benchmark").collect()]
    want = {(d, n, h, len(x), hashlib.sha256(",".join(x).encode()).hexdigest(), h > 0) for d, n, h, x, _ in brute(docs, items, 10)}
    assert {tuple(r)[:6] for r in op11_decontaminate(spark, folder).collect()} == want
