"""Each operator against a brute-force form, with null, empty, long, tied and repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import archives, bpe, fingerprints, licenses, mixing, near_duplicates, substrings, topk, toxicity, url_filter
from graphloom.llm.queries import tokenizer_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size string, node int"


def rows_of(texts, source=lambda i: "s"):
    return [(i, t, "en", source(i), len(t or ""), "clash", "clash", 7) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    out = [None, "", "  \t\n", "one", "One two\x0bthree", "über straße 12 <|endoftext|> x", "a\u00a0b c\u2003d", "x" * 5000]
    base = say(200)
    for k in (0, 0, 1, 2, 5, 9, 14, 20, 40):
        w = base.split(" ")
        for _ in range(k):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append(" ".join(w))
    passage = say(30)
    out += [say(40) + " " + passage + " " + say(r.randint(1, 300)) + "\n" + say(20) for _ in range(12)]
    out += [passage, passage, say(12), say(13), say(3000), "日本語のテキスト。" * 300]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    extra = [(None, "no id here at all", None, None, 3, "c", "c", 1), (None, None, None, None, None, None, None, None),
             (9, "another text of a repeated id", "en", "t", 1, "c", "c", 1)]
    return spark.createDataFrame(rows_of(texts, lambda i: None if i % 7 == 0 else f"s{i % 3}") + extra, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORDS.findall(text or "")]
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups_of(items, percent=85):
    parent = {k: k for k, _ in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {k: find(k) for k in parent}


def test_bpe_equals_the_library_and_decodes(spark, docs, nothing):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    lib = Tokenizer.from_file(path)
    got = sorted((tuple(r) for r in bpe.encode(docs, path, keep_ids=True).collect()), key=repr)
    want = []
    for r in docs.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), ids))
    assert got == sorted(want, key=repr)
    assert bpe.encode(nothing, path).count() == 0
    back = bpe.decode(spark.createDataFrame([(1, lib.encode("ein Tag", add_special_tokens=False).ids), (2, None)], "doc_id long, ids array<long>"), path)
    assert {tuple(r) for r in back.collect()} == {(1, "ein Tag"), (2, None)}


def test_chunk_joins_are_exact_wherever_they_fall():
    c = bpe.coder(tokenizer_path())
    r = random.Random(1)
    for _ in range(300):
        text = "".join(r.choice(["a", "bc ", "  ", "\n", "é", "日", "'s", "12", ".", " the", "<|endoftext|>", "\t"]) for _ in range(r.randint(1, 60))).encode()
        places = [i for i in range(1, len(text)) if text[i] & 0xC0 != 0x80]
        ends = np.array([*sorted(r.sample(places, min(len(places), r.randint(0, 6)))), len(text)])
        begins = np.r_[0, ends[:-1]]
        given = {k: c.encode([text[begins[k]:ends[k]]])[0] for k in range(len(ends)) if r.random() < 0.6}
        assert bpe.assemble(c, text, given, ends).tolist() == c.encode([text])[0].tolist()


def test_near_duplicates_equal_brute_force(docs, nothing):
    got = {(r["doc_id"], r["n_shingles"]): (r["component_id"], r["kept"]) for r in near_duplicates.near_duplicates(docs).collect() if r["doc_id"] is not None}
    items = [(r["doc_id"], shingles(r["text"])) for r in docs.collect() if r["doc_id"] is not None]
    first = {}
    for k, s in items:
        if s:
            first[frozenset(s)] = min(k, first.get(frozenset(s), k))
    group = groups_of([(k, set(s)) for s, k in first.items()])
    want = {(k, len(s)): group[first[frozenset(s)]] if s else k for k, s in items}
    assert got == {x: (c, c == x[0]) for x, c in want.items()}
    assert near_duplicates.near_duplicates(nothing).count() == 0


def test_near_duplicates_find_links_away_from_a_centre(spark):
    r = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(150)] = f"x{r.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups_of([(i, shingles(t)) for i, t in rows])
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicates(df).collect()} == want
    assert len(set(want.values())) > 1


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    shared = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.r_[shared, r.integers(0, 1 << 63, 50, dtype=np.uint64)]) for _ in range(40)]
    sig = near_duplicates.super_minhash(np.concatenate(sets), np.repeat(np.arange(40), [len(s) for s in sets]), 40)
    same = [(sig[i] == sig[j]).mean() for i in range(40) for j in range(i)]
    assert abs(np.mean(same) - 0.8) < 0.02
    one = near_duplicates.super_minhash(shared[:1], np.zeros(1, int), 1)
    assert (np.sort(one[0] >> np.uint64(48)) == np.arange(near_duplicates.SLOTS)).all()


def test_removed_windows_equal_brute_force(docs, nothing):
    rows = [(r["doc_id"], WORDS.findall(r["text"] or ""), r["text"]) for r in docs.collect()]
    first = {}
    for i, w, _ in rows:
        if i is not None:
            for k in range(len(w) - 12):
                first[tuple(w[k:k + 13])] = min(i, first.get(tuple(w[k:k + 13]), i))
    want = []
    for i, w, _ in rows:
        gone = set()
        for k in range(len(w) - 12):
            if i is not None and first[tuple(w[k:k + 13])] < i:
                gone |= set(range(k, k + 13))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [tuple(r) for r in substrings.deduplicate(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    full = [tuple(r) for r in substrings.deduplicate(docs, bits=22).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]
    assert sorted(full, key=repr) == sorted(want, key=repr)
    assert substrings.deduplicate(nothing).count() == 0
    out = substrings.replace_texts(docs)
    assert out.columns == docs.columns and out.count() == docs.count()


def test_top_k_equals_brute_force(spark):
    r = np.random.default_rng(2)
    x = np.round(r.normal(0, 1, (400, 24)), 1)
    x[50:80] = x[50]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(400)]
    rows += [(500, None, 1), (600, [1.0, None], 1), (700, [float("nan")] * 24, 1), (800, [float("inf")] * 24, 1), (None, [1.0] * 24, 1),
             (3, [-9.0] * 24, 1), (900, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    vec = {i: [math.floor(1024 * v) for v in e] for i, e, _ in rows[:400]} | {900: [], 3: min([math.floor(1024 * v) for v in x[3]], [-9216] * 24)}
    want = set()
    for q in (0, 100, 200, 300, 900):
        scored = sorted((-sum(a * b for a, b in zip(vec[q], v)), i) for i, v in vec.items() if i != q)
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:10])}
    assert {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()} == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = topk.top_k(df.filter("vec_id in (100, 101, 102)"), F.col("vec_id") % 100 == 0)
    assert few.count() == 2


def test_segment_bounds_hold():
    r = np.random.default_rng(3)
    q, x = r.integers(-1000, 1000, (30, 37)), r.integers(-1000, 1000, (60, 37))
    last = None
    for s in topk.SEGMENTS:
        bound = topk.segment_features(q, s) @ topk.segment_features(x, s).T
        assert (bound >= q @ x.T - 1e-6).all()
        assert last is None or bound.sum() <= last
        last = bound.sum()


def pages_of(spark):
    html = ["<p>é</p>", None, "", "<p>é</p>", "long " * 50000, "<p>é</p>", "\x1f\x8b\x08 not a member", ""]
    urls = ["http://a/ü\r\nX: y", None, "", "x", "http://b", "c", "d", "e"]
    return [(i, u, h, "clash") for i, (u, h) in enumerate(zip(urls, html))] + [(0, "again", "<p>é</p>", "clash"), (None, "n", "<p>é</p>", "clash")]


def expected_records(rows):
    import base64

    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h, _ in rows:
        p = (h or "").encode()
        revisit = i is not None and first[h or ""] != i
        out.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if revisit else "response", first[h or ""] if revisit else None))
    return sorted(out, key=repr)


def test_archives_return_what_was_written(spark):
    rows = pages_of(spark)
    df = spark.createDataFrame(rows, "page_id long, url string, html string, same string")
    got = archives.archive(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected_records(rows)
    assert archives.archive(df.limit(0)).count() == 0


@pytest.mark.parametrize("split", [64, 700, 5000, 1 << 20])
def test_archives_are_read_in_any_byte_ranges(spark, tmp_path, split):
    r = random.Random(split)
    bodies = [bytes(r.choice(b"\x1f\x8b\x08\x00ab") for _ in range(r.randint(0, 400))) for _ in range(150)]
    members = [archives.record(i, f"http://h/{i}", b, None) for i, b in enumerate(bodies)]
    if split == 1 << 20:
        members[7] = _stored(archives.record(7, None, archives.record(99, None, b"inner", None), None))
        bodies[7] = archives.record(99, None, b"inner", None)
    members[9] = _stored(archives.record(9, None, archives.MAGIC * 40, None))
    bodies[9] = archives.MAGIC * 40
    (tmp_path / "a.warc").write_bytes(b"".join(members))
    (tmp_path / "b.warc").write_bytes(b"".join(m + b"\0" for m in members))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        got = archives.read(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r["page_id"], bytes(r["payload"])) for r in got) == sorted([*enumerate(bodies)] * 2)


def _stored(member: bytes) -> bytes:
    """The same record without compression, so that its payload's bytes stand in the file as they are."""
    import zlib

    text = zlib.decompress(member, 31)
    squeeze = zlib.compressobj(0, zlib.DEFLATED, 31)
    return squeeze.compress(text) + squeeze.flush()


def test_license_scan(spark, docs, nothing):
    mit = dict(licenses.KNOWN[4:5])["MIT"] if licenses.KNOWN[4][0] == "MIT" else licenses.KNOWN[4][1]
    rows = [(1, "Copyright (c) 2020 A Person\n\n" + mit.upper()), (2, "hello\nReleased under the MIT Licence!\nAll rights reserved.\n"), (3, None), (4, " \n"),
            (2, "hello\nReleased under the MIT Licence!\nAll rights reserved.\n"), (None, "Released, under the MIT license")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "license", "n_lines", "notices").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([
        (1, "MIT", 4, ""), (2, None, 3, "MIT,proprietary"), (2, None, 3, "MIT,proprietary"), (3, None, 0, ""), (4, None, 0, ""), (None, "MIT", 1, "MIT")], key=repr)
    assert licenses.scan(docs).count() == docs.count() and licenses.scan(nothing).count() == 0


def test_toxicity_learns_words_and_stems(spark, docs, nothing):
    r = random.Random(4)
    bad, plain = ["vilo", "grumt", "zarkan", "zarkest", "zarkly"], [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        w = [r.choice(plain) for _ in range(r.randint(5, 80))]
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w) + 1), r.choice(bad))
        rows.append((i, " ".join(w), r.choice(["en", "de"])))
        labels.append((i, int(toxic)))
    rows += [(1000, None, None), (1001, "", "xx"), (None, "zarkful", "en"), (0, "w1 w2", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lab = spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    net = toxicity.train(df, lab)
    got = toxicity.score(df, net).collect()
    assert len(got) == len(rows) and all(0 <= x["score"] <= 1 for x in got)
    held = [x for x in got if x["held_out"] and x["doc_id"] < 900]
    assert held and sum(x["predicted"] == (x["doc_id"] % 3 == 0) for x in held) / len(held) > 0.97
    assert sorted(x["score"] for x in got if x["doc_id"] in (1000, 1001))[0] < 0.5
    again = toxicity.score(df, toxicity.train(df, lab)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    clean = toxicity.keep_clean(docs, net)
    assert clean.columns == docs.columns
    assert toxicity.score(nothing, toxicity.train(nothing, lab.limit(0))).count() == 0


def test_fingerprints(spark, docs, nothing):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    got = fingerprints.fingerprint(docs).collect()
    assert len(got) == len(rows) and fingerprints.fingerprint(nothing).count() == 0
    plain = spark.createDataFrame([r for r in rows if r[0] is not None and r != (9, "another text of a repeated id")], "doc_id long, text string")
    order = sorted(((r["doc_id"], r["text"]) for r in plain.collect()), reverse=True)
    parts = lambda s: set(re.findall(r"[^\n]{48,200}?[.!?]+|[^\n]{1,200}", s))
    near = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    found = {r["doc_id"]: r for r in fingerprints.fingerprint(plain).collect()}
    for i, (k, s) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        edited = s[:len(s) - len(s) // 2] + after[:len(s) // 2]
        r = found[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(s), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(near(parts(s), parts(edited))) and r["near_next"] == pytest.approx(near(parts(s), parts(after)))
    for a in order:
        for b in order:
            if a[1] == b[1]:
                assert found[a[0]]["fingerprint"] == found[b[0]]["fingerprint"]


def test_peeling_recovers_differences_of_any_size(spark):
    r = random.Random(6)
    rows = []
    for i, n in enumerate([0, 1, 2, 5, 17, 60, 400, 3000]):
        a = {r.getrandbits(64) - (1 << 63) for _ in range(n)}
        b = set(list(a)[:n // 2]) | {r.getrandbits(64) - (1 << 63) for _ in range(n // 3)}
        rows.append((i, list(a), list(b), list(a)[: n // 100]))
    df = spark.createDataFrame(rows, "id int, own array<long>, changed array<long>, after array<long>")
    got = {x["id"]: x for x in fingerprints.compare(df, ["id"], []).collect()}
    for i, a, b, c in rows:
        a, b, c = set(a), set(b), set(c)
        assert (set(got[i]["only_own"]), set(got[i]["only_edited"])) == (a - b, b - a)
        for name, other in (("near_edited", b), ("near_next", c)):
            assert got[i][name] == pytest.approx(len(a & other) / len(a | other) if a | other else 1.0)


def cells_of(fingerprint):
    """``(n, level, {part: cells})`` of a fingerprint's text."""
    n, level, *cells = re.split(r"(?<=[0-9a-f])-", fingerprint)
    out = {part: [(0, 0, 0)] * (fingerprints.TABLES * fingerprints.CELLS) for part in range(1 << int(level))}
    for cell in cells:
        part, at, count, k, c = cell.split(".")
        out[int(part)][int(at)] = (int(count), int(k, 16) - (int(k, 16) >> 63 << 64), int(c, 16))
    return int(n), int(level), out


def test_two_fingerprints_of_one_level_tell_the_difference(spark):
    """The texts of two fingerprints alone, subtracted and peeled, give the recovered digests and the likeness."""
    r = random.Random(8)
    rows = []
    for i, n in enumerate([0, 3, 8, 30, 200]):
        a = [r.getrandbits(64) - (1 << 63) for _ in range(n)]
        rows.append((i, a, a[: n - 2] + [r.getrandbits(64) - (1 << 63) for _ in range(2)] if a else a, []))
    df = spark.createDataFrame(rows, "id int, own array<long>, changed array<long>, after array<long>")
    told = {x["id"]: x for x in fingerprints.compare(df, ["id"], []).collect()}
    pairs = {i: (cells_of(x["fingerprint"]), cells_of(x["edited_fingerprint"])) for i, x in told.items()}
    assert all(one[1] == two[1] for one, two in pairs.values())
    cells = "array<struct<n:int,k:bigint,c:bigint>>"
    sketches = spark.createDataFrame([(i, one[2][p], two[2][p]) for i, (one, two) in pairs.items() for p in one[2]], f"id int, one {cells}, two {cells}")
    size = F.lit(fingerprints.CELLS)
    left = sketches.select("id", fingerprints.peel(fingerprints.subtract(F.col("one"), F.col("two")), size).alias("s")).collect()
    for i, (one, two) in pairs.items():
        assert not any(c != (0, 0, 0) for x in left if x["id"] == i for c in x["s"]["cells"])
        found = {s: {f["k"] for x in left if x["id"] == i for f in x["s"]["found"] if f["n"] == s} for s in (1, -1)}
        assert found == {1: set(told[i]["only_own"]), -1: set(told[i]["only_edited"])}
        d, both = len(found[1]) + len(found[-1]), one[0] + two[0]
        assert told[i]["near_edited"] == pytest.approx((both - d) / (both + d) if both else 1.0)


def test_documents_without_ids_stand_in_blocks_of_their_own(spark):
    texts = [f"text {i}. Of many. Sentences {i % 3}." for i in range(40)]
    df = spark.createDataFrame([(None, t) for t in texts] + [(7, "seven."), (300, None)], "doc_id long, text string")
    got = fingerprints.fingerprint(df)
    found = got.collect()
    assert len(found) == 42
    keyed = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")).collect()
    order = [r["text"] for r in sorted(keyed, key=lambda r: (r["doc_id"] is None, -(r["doc_id"] or 0), r["key"]))]
    want = sorted(hashlib.sha256((s[:len(s) - len(s) // 2] + order[(i + 1) % len(order)][:len(s) // 2]).encode()).hexdigest() for i, s in enumerate(order))
    assert sorted(r["edited_sha256"] for r in found) == want


def test_next_lower_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "FEW", 3)
    ids = [5, 6, 7, 4096, 9000, 1 << 30, (1 << 30) + 1, 1 << 50, -4, -(1 << 40)]
    got = dict(map(tuple, fingerprints.next_lower(spark.createDataFrame([(i,) for i in ids], "id long")).collect()))
    s = sorted(ids)
    assert got == {x: s[i - 1] for i, x in enumerate(s)}


def targets_of(sizes, weights=(5, 2, 1)):
    names = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: weights[i % 3] for i, k in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        rest = {k: w for k, w in weight.items() if k not in capped}
        left = total - sum(capped.values())
        over = [k for k, w in rest.items() if left * w / sum(rest.values()) > 3 * sizes[k]]
        if not over:
            return capped | {k: left * w / sum(rest.values()) for k, w in rest.items()}
        capped |= {k: 3.0 * sizes[k] for k in over}


def test_mixing_meets_targets(spark, docs, nothing):
    r = random.Random(8)
    rows = [(i, None if i % 50 == 49 else f"src{min(int(r.expovariate(0.7)), 9)}", "w " * r.choice([1, 5, 30, 30, 200, 900])) for i in range(3000)]
    rows += [(5000, "src0", None), (5001, "tiny", "a"), (7, rows[7][1], rows[7][2])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = targets_of(sizes)
    taken = {}
    for x in got:
        assert x["target"] == pytest.approx(want[x["source"]]) and x["source_size"] == sizes[x["source"]] and x["taken"] <= 3 * x["size"]
        taken[x["source"]] = taken.get(x["source"], 0) + x["taken"]
    for s, t in want.items():
        if sizes[s] > 5000:
            assert abs(taken[s] - t) <= 0.01 * t + 40
    assert sorted(map(tuple, mixing.mix(df.repartition(5)).collect()), key=repr) == sorted(map(tuple, got), key=repr)
    assert mixing.mix(docs).count() == docs.count() and mixing.mix(nothing).count() == 0


def test_url_filter(spark):
    rows = [(1, "http://WWW.Example.com/en/x?y#z"), (2, "https://a.example.com/en/1"), (3, "x://b.net/es/"), (4, "x://b.net/es"), (5, "http://com"),
            (6, "http://com/"), (7, None), (8, "no host"), (9, "http://notexample.com/en/"), (10, "http://u@h:8/p/q?r"), (11, "a://net#frag"), (1, "http://c.net/fr/7")]
    got = sorted((tuple(r)[:4] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()), key=repr)
    assert got == sorted([
        (1, "www.example.com", "/en/x", "www.example.com/en/"), (2, "a.example.com", "/en/1", "example.com/en/"), (3, "b.net", "/es/", "net/es/"),
        (4, "b.net", "/es", None), (5, "com", "", None), (6, "com", "/", "com/"), (7, "", "", None), (8, "", "", None),
        (9, "notexample.com", "/en/", "com/"), (10, "u@h:8", "/p/q", None), (11, "net", "", None), (1, "c.net", "/fr/7", "net/fr/")], key=repr)


def test_url_templates_are_rejected_by_purity(spark):
    rules = [("block", f"h.org", f"/ads/{i}") for i in range(10, 60)] + [("allow", "h.org", f"/news/{i}") for i in range(10, 60)]
    rows = [(i, f"http://h.org/ads/{i}.html") for i in range(200)] + [(1000 + i, f"http://h.org/news/{i}.html") for i in range(200)]
    rows += [(2000 + i, f"http://h.org/user/name{i}/home") for i in range(100)]
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()}
    assert got[5] == got[99] == "block" and got[1005] == got[1099] == "allow" and all(got[2000 + i] == "allow" for i in range(100))
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
