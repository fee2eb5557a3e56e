"""Ordered leader election and as-of candidate lists against their serial forms."""

from __future__ import annotations

import random

import numpy as np
import pytest

from graphloom.operators import growth as G, leaders as L


def rows(n, seed, spread):
    """Unit vectors around a few centres, with repeated ones, kinds and names."""
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 8))
    v = centres[r.integers(0, 12, n)] + spread * r.normal(size=(n, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[5], v[n // 2] = v[3], 0.0
    p = random.Random(seed)
    return [(10 * i, v[i].tolist(), p.choice(["P", "Q", "", None]), p.choice([None, f"n{p.randrange(n // 3)}"])) for i in range(n)]


def serial(points, thr, strict, penalty, names, seeds=()):
    led = list(seeds)
    for ord_, vec, kind, name in points:
        def near(q):
            s = np.dot(vec, q[1]) - (penalty if kind and q[2] and kind != q[2] else 0)
            return s > thr if strict else s >= thr
        if not any(near(q) for q in led) and not (names and name is not None and any(q[3] == name for q in led)):
            led.append((ord_, vec, kind, name))
    return [q[0] for q in led[len(seeds):]]


SCHEMA = "ord long, vec array<double>, kind string, name string"


@pytest.mark.parametrize(("spread", "strict", "penalty", "names", "head"), [(0.2, True, 0.0, False, 20), (0.5, False, 0.2, True, 15), (0.1, False, 0.1, True, 1000)])
def test_election_equals_the_serial_pass(spark, spread, strict, penalty, names, head):
    points = rows(400, 7, spread)
    seeds = [(-5 + i, p[1], p[2], f"seed {i}") for i, p in enumerate(rows(400, 7, spread)[7:9])]
    df = spark.createDataFrame(points, SCHEMA).repartition(4)
    reach = L.Reach(0.8, strict, penalty)
    got = L.elect(df, reach, seeds=spark.createDataFrame(seeds, SCHEMA), names=names, head=head)
    assert sorted(r.ord for r in got.collect()) == serial(points, 0.8, strict, penalty, names, seeds)
    plain = L.elect(df, reach, names=names, head=head)
    assert sorted(r.ord for r in plain.collect()) == serial(points, 0.8, strict, penalty, names)


def test_members_join_the_earliest_leader(spark):
    points = rows(300, 3, 0.3)
    led = serial(points, 0.7, True, 0.0, False)
    by = dict((p[0], p[1]) for p in points)
    want = {p[0]: next(q for q in led if q == p[0] or q < p[0] and np.dot(p[1], by[q]) > 0.7) for p in points}
    df = spark.createDataFrame(points, SCHEMA).select("ord", "vec")
    for head in (10, 1000):
        assert {r.ord: r.leader for r in L.clusters(df, L.Reach(0.7, True), head=head).collect()} == want


def test_nothing_elects_nothing(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert L.elect(df, L.Reach(0.8, True)).count() == 0
    one = spark.createDataFrame([(1, [1.0, 0.0], None, None)], SCHEMA)
    assert [r.ord for r in L.elect(one, L.Reach(0.8, True), seeds=df).collect()] == [1]
    assert L.elect(df, L.Reach(0.8, True), seeds=one).count() == 0


@pytest.mark.parametrize("block", [7, 4096])
def test_candidate_lists_over_time(spark, block):
    schema = [(p[0], f"e{p[0]}", p[1], p[2]) for p in rows(60, 1, 0.4)]
    queries = [(i, p[1], p[2]) for i, p in enumerate(rows(30, 2, 0.4))]
    got = G.top_k_as_of(spark.createDataFrame(queries, "qid long, vec array<double>, kind string"),
                        spark.createDataFrame(schema, "ord long, name string, vec array<double>, kind string"), 3, types=("kind",), penalty=0.2,
                        blanks_match=True, block_rows=block)
    found = {}
    for r in got.collect():
        found.setdefault(r.qid, []).append((r.since, r.until, r.names, r.scores))
    for qid, vec, kind in queries:
        spans = sorted(found[qid])
        assert spans[0][0] == -(2 ** 62) and spans[-1][1] == 2 ** 62 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
        for at in (0, 5, 111, 300, 599, 10 ** 6):
            known = [(-(np.dot(vec, v) - (0.2 if kind and k and kind != k else 0)), o, n) for o, n, v, k in schema if o < at]
            want = [n for _, _, n in sorted(known)[:3]]
            assert next(s[2] for s in spans if s[0] < at <= s[1]) == want


def test_average_linkage_names_the_serial_clusters(spark):
    """Tight and loose groups, equal vectors, and a chain whose ends are far apart."""
    from graphloom.operators.schemas import average_linkage_clusters

    points = rows(90, 5, 0.35)
    angle = np.linspace(0, 1.3, 9) ** 1.2
    points += [(2000 + i, [float(np.cos(a)), float(np.sin(a)), *[0.0] * 6], None, None) for i, a in enumerate(angle)]
    groups, v = [[p[0]] for p in points], {p[0]: np.array(p[1]) for p in points}
    while True:
        best = max((float(np.mean([v[a] @ v[b] for a in x for b in y])), -i, -j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        if best[0] <= 0.8:
            break
        groups[-best[1]] += groups.pop(-best[2])
    df = spark.createDataFrame([(p[0], f"n{p[0]}", p[1]) for p in points], "ord long, name string, vec array<double>")
    got = {r.name: r.cluster for r in average_linkage_clusters(df, 0.8).collect()}
    assert got == {f"n{o}": f"n{min(g)}" for g in groups for o in g}
    assert average_linkage_clusters(df.limit(0), 0.8).count() == 0


def test_expected_information_in_chunks_of_any_size():
    """Against the sum over all overlaps, with chunks far smaller than the clusters."""
    import math

    from graphloom.operators.clustering import _expected_term

    def whole(n, x, y):
        lo, hi = max(1, x + y - n), min(x, y)
        p = lambda c: math.comb(y, c) * math.comb(n - y, x - c) / math.comb(n, x)
        return sum(c / n * math.log(n * c / (x * y)) * p(c) for c in range(lo, hi + 1))

    for n, x, y in ((10, 3, 4), (10, 9, 8), (7, 7, 3), (5, 1, 1), (400, 150, 260), (1000, 999, 2), (300, 300, 300)):
        for chunk in (1, 7, 4096):
            assert abs(_expected_term(n, x, y, chunk) - whole(n, x, y)) < 1e-12
    assert 0 < _expected_term(3 * 10 ** 9, 10 ** 9, 10 ** 9) < 1e-8


def test_wide_rounds_settle_more_points_than_heads_hold(spark):
    """Points that hardly reach each other lead at once; a round per head would take one for every few points."""
    v = np.random.default_rng(5).normal(size=(400, 16))
    v[200:300] = v[:100] + 0.05 * v[100:200]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ord long, vec array<double>")
    rounds, wide = [], L._wide

    def counted(*args):
        rounds.append(1)
        return wide(*args)

    L._wide = counted
    try:
        got = {r.ord: r.leader for r in L.clusters(df, L.Reach(0.8, True), head=20).collect()}
    finally:
        L._wide = wide
    want, lead = {}, []
    for i, x in enumerate(v):
        want[i] = next((j for j in lead if v[j] @ x > 0.8), i)
        if want[i] == i:
            lead.append(i)
    assert got == want
    assert 1 <= len(rounds) <= 3


def test_cells_that_prune_nothing_are_not_used(spark):
    from graphloom.operators.leaders import Reach, _Cells

    rng = np.random.default_rng(1)
    far = rng.normal(size=(1500, 48))
    close = np.repeat(np.eye(48)[:5], 300, axis=0) + 0.001 * rng.normal(size=(1500, 48))
    for v, used in ((far, False), (close, True)):
        v = v / np.linalg.norm(v, axis=1)[:, None]
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "ord long, vec array<double>")
        assert (len(_Cells(df, Reach(0.85, True), 4).pivots) > 1) == used
