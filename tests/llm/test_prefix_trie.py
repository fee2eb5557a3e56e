"""The prefix trie against a plain form: shared, repeated, missing and empty turns, many shards, and segments shorter than conversations."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from graphloom.llm import prefix_trie as T

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "conv_id long, turn long, role string, text string, depth string, pos int, e string"


def key(role, text):
    return hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()


def originals(rows):
    out = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, key(role, text), role or "", text or ""))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in out.items()}


def brute_nodes(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    total = {p: [0, 0, 0] for p in members}
    for p in sorted(members, key=len, reverse=True):
        t = total[p]
        t[1] = t[1] if t[0] else 1
        t[2] += (len(members[p]) - 1) * len(WORDS.findall(p[-1][1])) if p else 0
        if p:
            up = total[p[:-1]]
            up[0], up[1], up[2] = up[0] + 1, up[1] + t[1], up[2] + t[2]
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), *total[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def brute_rebuilt(rows):
    own, out = originals(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20)), [])[:h] + turns[h:]
    return out


def show(rows):
    return sorted(tuple(map(str, r)) for r in rows)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    say = lambda: " ".join(r.choice(["a", "B", "c\tx", "dd"]) for _ in range(r.randint(0, 5)))
    out = [(None, 0, "user", "no conversation"), (None, None, None, None), (500, None, "system", "null turn first"), (500, 0, None, "x y"), (500, 1, "user", None),
           (41, 5, "user", "same turn twice"), (41, 5, "user", "same turn twice"), (41, 5, "user", "same turn, other text"), (-7, 1, "user", "minus"), (-7, 2, "user", "two"),
           (-20, 0, "user", "base of minus"), (700, 3, "user", "z" * 50000), (701, 0, "u", "")]
    common = [("system", "be kind"), ("user", "hello there"), ("assistant", "hi"), ("user", "bye now"), ("assistant", "bye"), ("user", "")]
    for c in range(0, 120):
        kind = r.random()
        ts = common if kind < 0.4 else common[:r.randint(1, 4)] + [("user", say()) for _ in range(r.randint(0, 5))] if kind < 0.8 else [
            ("user", say()) for _ in range(r.randint(1, 9))]
        if c % 20 or r.random() < 0.7:
            out += [(c, i, role, text) for i, (role, text) in enumerate(ts)]
    for c in range(300, 330):
        out += [(c, i, "user", f"t{i % 7} w" if i < 25 + c % 3 else f"end {c % 4}") for i in range(20 + c % 11)]
    out += [(c, 0, "user", "gone") for c in range(1001, 1012) if zlib.crc32(str(c).encode()) % 4]
    return [(*x, "clash", 7, "clash") for x in out]


@pytest.mark.parametrize("segment", [512, 5, 2])
def test_equals_the_plain_definition(spark, rows, segment):
    conversations = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert show(T.conversation_trie(conversations, segment).collect()) == show(brute_nodes(originals(rows)))
    rebuilt = brute_rebuilt(rows)
    assert any(not t for t in rebuilt.values())
    got = T.rebuilt_trie(conversations, segment)
    assert got.columns == [f.split()[0] for f in T.NODES.split(", ")]
    assert show(got.collect()) == show(brute_nodes(rebuilt))


def test_many_copies_span_shards(spark, monkeypatch):
    """Copies of one conversation fill several shards; the pieces of their ids are hashed in order."""
    monkeypatch.setattr(T, "PIECE", 100)
    rows = [(c, i, "user", f"turn {i}") for c in range(1, 1500) for i in range(3)] + [(c, i, "user", f"turn {i}") for c in range(2000, 2100) for i in range(4)]
    rows += [(c, i, "user", f"turn {c % 5 * i}") for c in range(3000, 3100) for i in range(2)]
    got = T.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8)).collect()
    assert show(got) == show(brute_nodes(originals(rows)))


def test_small_tables(spark, rows):
    conversations = spark.createDataFrame(rows, SCHEMA)
    assert T.rebuilt_trie(conversations.limit(0)).collect() == []
    assert T.conversation_trie(conversations.filter("conv_id is null")).collect() == []
    assert show(T.conversation_trie(conversations.filter("conv_id = 701")).collect()) == show(brute_nodes({701: [("u", "")]}))


def test_query(spark, folder):
    from graphloom.llm.common import table
    from graphloom.llm.queries import op13_prefix_trie

    rows = [tuple(r) for r in table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert show(op13_prefix_trie(spark, folder).collect()) == show(brute_nodes(brute_rebuilt(rows)))
