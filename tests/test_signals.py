"""The nine relation signals against the serial fold over composed definition texts."""

from __future__ import annotations

import random

import numpy as np
import pytest

from graphloom.functions.vectors import FUSION_WEIGHTS, hash_rows, hashing_vector
from graphloom.operators import canonical as C

FIELDS = ("relation", "definition", "general_definition_edc", "general_definition_abstract", "head_type", "tail_type")
SCHEMA = "position long, item_id long, " + ", ".join(f"{f} string" for f in FIELDS) + ", raw_output string, answered boolean"


def occurrences(n=60):
    r = random.Random(12)
    pick = lambda *x: r.choice(x)
    return [(i * 3 + 1, i, pick("born in", "born at", "lives in", "works for", "worked for", "owns"), pick("place of birth", "where one lives", "", None),
             pick("the birth place", "the home", "the employer"), pick("place", "person", "thing"), pick("Person", "Place", "", None), pick("City", "Firm", None),
             pick("0", "1", "2", "Answer 5", "3", "no", "9"), r.random() > 0.1) for i in range(n)]


def vector(case, row):
    style = C.RELATION_CASES[case]["style"]
    rel, d, edc, abstract, head, tail = (x or "" for x in row)
    parts = [hash_rows([x])[0] for x in (rel, d, head, tail)]
    if style == "concat":
        v = np.concatenate(parts)
    elif style == "weighted":
        v = sum(w * p for w, p in zip(FUSION_WEIGHTS.values(), parts))
    else:
        return hash_rows([{"name": rel, "name_gendef_edc": f"{rel}. {edc}", "name_gendef_abstract": f"{rel}. {abstract}", "name_detail": f"{rel}. {d}",
                           "name_detail_headtail": f"{rel}. {d}. Head: {head}. Tail: {tail}"}[style]])[0]
    return v / np.linalg.norm(v)


def serial(rows, case, thr, seed=()):
    cfg, schema, out = C.RELATION_CASES[case], {}, []
    for s in seed:
        schema[s[0]] = (vector(case, s), s[4] or "", s[5] or "")
    for row in rows:
        rel, raw, ok = row[2], row[8], row[9]
        q, head, tail = vector(case, row[2:8]), row[6] or "", row[7] or ""
        scored = sorted((-round(q @ v - (0.2 if cfg["typed"] and (h, t) != (head, tail) else 0), 12), i, n) for i, (n, (v, h, t)) in enumerate(schema.items()))[:5]
        names = [n for _, _, n in scored]
        if not cfg["llm"]:
            final = names[0] if names and -scored[0][0] >= thr else None
        elif not ok:
            final = names[0] if names else None
        else:
            digits = [int(x) for x in raw.split() if x.isdigit()]
            final = names[digits[0] - 1] if digits and 0 < digits[0] <= len(names) else None
        out.append((row[0], final or rel, final is None, names))
        if final is None:
            schema.setdefault(rel, (q, head, tail))
    return out, set(schema)


@pytest.mark.parametrize("case", list(C.RELATION_CASES))
def test_signal_equals_the_serial_fold(spark, case):
    rows = occurrences()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    seed = (("born in", "place of birth", "the birth place", "place", "Person", "City"), ("runs", "who leads", "the leader", "person", "Person", "Firm"))
    for start in ((), seed):
        table = spark.createDataFrame([(i - 9, *s) for i, s in enumerate(start)], "ord long, name string, " + ", ".join(f"{f} string" for f in FIELDS[1:])) \
            if start else None
        got, schema = C.canonicalize_signal(df, case, hashing_vector, seed=table, threshold=0.8)
        want, names = serial(rows, case, 0.8, start)
        assert sorted((r.position, r.pred, r.is_new, r.names) for r in got.collect()) == want
        assert {r.name for r in schema.collect()} == names


def test_seed_without_the_signal_s_definition_is_refused(spark):
    df = spark.createDataFrame(occurrences(5), SCHEMA)
    seed = spark.createDataFrame([(-1, "owns", "has a thing", " ", "", "A", "B")], "ord long, name string, " + ", ".join(f"{f} string" for f in FIELDS[1:]))
    with pytest.raises(ValueError, match="case3_name_gendef_edc needs general_definition_edc.*'owns'"):
        C.canonicalize_signal(df, "case3_name_gendef_edc", hashing_vector, seed=seed)
    got, _ = C.canonicalize_signal(df, "case7_detail_typed", hashing_vector, seed=seed, allow_new=False)
    assert {r.pred for r in got.collect()} == {"owns"}
