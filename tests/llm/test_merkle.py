"""The Merkle manifest against a plain form of its definition, and its storage order against the recursive one."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int, leaf string"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """The root over some nodes, and for each of them its siblings on the way and its fold with another digest."""
    ways, level, group = [[] for _ in nodes], list(nodes), [[i] for i in range(len(nodes))]
    while len(level) > 1:
        up, merged = [], []
        for a in range(0, len(level), 8):
            run = level[a:a + 8]
            for k, members in enumerate(group[a:a + 8]):
                for i in members:
                    ways[i].append((run[:k], run[k + 1:]))
            up.append(sha(*run))
            merged.append([i for members in group[a:a + 8] for i in members])
        level, group = up, merged
    return level[0], ways


def brute(rows, tampered):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    leaf = lambda r, text: sha(*map(field, (r[0], r[3], r[2], r[4], text)))
    trees = []
    for lang in langs:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, tampered(r))), r[0]) for r in rows if r[2] == lang)
        trees.append((mine, *climb([m[0][2] for m in mine])))
    root, above = climb([t[1] for t in trees])
    out = []
    for (mine, subroot, ways), top in zip(trees, above, strict=True):
        for (key, doc), way in zip(mine, ways, strict=True):
            folded = key[3]
            for left, right in way + top:
                folded = sha(*left, folded, *right)
            proof = sha(*[x for left, right in way + top for x in left + right])
            out.append((doc, key[2], subroot, root, proof, folded, folded == root))
    return out


def plain(text):
    return text and text.translate(str.maketrans(UPPER, LOWER))


def lowered(r):
    return plain(r[1]) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[1]


def claimed():
    return {"text": F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    out = [(None, "No id", "en", None, 3), (None, None, None, None, None), (5, "Ä ß 日本", "de", "s", 6), (6, "", "de", "", 0), (7, None, "de", "s", None),
           (8, "X" * 60000, "fr", "s", 1), (9, "Same id", "en", "s", 1), (9, "same id", "en", "s", 1), (9, "Same id", "en", "s", 1), (-4, "Minus", "en", "s", 1)]
    for i in range(20, 700):
        out.append((i, f"Text {r.randrange(400)} of A row", r.choice(["en", "en", "en", "de", None, "Ωμ", "z"]), r.choice(["a", None, "b:c"]), r.randrange(99)))
    out += [(900, "Lone", "lone", "s", 4)]
    return [(*x, "clash", 7, "clash") for x in out]


def show(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.mark.parametrize("height", [4, 2, 1])
def test_equals_the_plain_definition(spark, rows, monkeypatch, height):
    """Small blocks need several levels of them, so that the recursion over block roots is covered too."""
    monkeypatch.setattr(M, "HEIGHT", height)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    m = M.manifest(docs, claimed())
    assert len(m.levels) == {4: 1, 2: 2, 1: 3}[height]
    assert show(M.verify(m).collect()) == show(brute(rows, lowered))


def test_untouched_rows_verify_and_reruns_agree(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    one, two = M.manifest(docs.repartition(7)), M.manifest(docs.orderBy(F.desc("doc_id")))
    assert one.root == two.root
    assert {r.verified for r in M.verify(one).collect()} == {True}


def test_small_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert M.verify(M.manifest(docs.limit(0), claimed())).collect() == []
    lone = M.verify(M.manifest(docs.filter("doc_id = 900"), claimed())).collect()
    assert show(lone) == show(brute([r for r in rows if r[0] == 900], lowered))
    assert lone[0].leaf == lone[0].subroot == lone[0].root and lone[0].proof_sha256 == sha("")
    same = [rows[5]] * 30
    assert show(M.verify(M.manifest(spark.createDataFrame(same, SCHEMA))).collect()) == show(brute(same, lambda r: r[1]))


@pytest.mark.parametrize("height", range(6))
def test_storage_order_is_recursive(height):
    def order(levels, depth, i):
        """The nodes of a subtree in van Emde Boas order: the top half, then the trees below it from left to right."""
        if levels == 1:
            return [(depth, i)]
        top = levels // 2
        return order(top, depth, i) + [n for k in range(8 ** top) for n in order(levels - top, depth + top, i * 8 ** top + k)]

    at = M.addresses(height)
    assert [(d, i) for d, i in sorted(((d, i) for d in range(height + 1) for i in range(8 ** d)), key=lambda n: at[n[0]][n[1]])] == order(height + 1, 0, 0)
    assert sorted(np.concatenate(at)) == list(range(M.nodes_of(height)))


def test_query(spark, folder):
    from graphloom.llm.common import table
    from graphloom.llm.queries import op12_merkle

    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table(spark, folder, "documents").collect()]
    got = op12_merkle(spark, folder).collect()
    assert show(got) == show(brute(docs, lowered))
    assert 0 < sum(not r.verified for r in got) < len(got)
