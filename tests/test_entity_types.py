"""Growing entity types against the serial fold, and the stage that runs on a finished run's tables alone."""

from __future__ import annotations

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from graphloom.config import BuildConfig
from graphloom.functions.vectors import hash_rows, hashing_vector
from graphloom.operators import canonical as C
from graphloom.plans.construct import Build

GROUPS = "item_id long, ord long, fine string, definition string, parent string, members array<string>, raw_output string, answered boolean"


def groups(n=70):
    r = random.Random(6)
    say = ["red ring", "red rings", "blue ring", "widget", "widgets", "steel bolt", "bolt"]
    out = []
    for i in range(n):
        for o, fine in enumerate(r.sample(say, r.randint(1, 3))):
            out.append((i, o * 2, fine, r.choice(["", "a round thing", "a round things", "used in machines", None]), r.choice(["Good", "Tool", "", None]),
                        [f"e{r.randrange(30)}" for _ in range(r.randint(1, 3))], r.choice(["0", "1", "2", "Answer 5", "3", "no", "9", "B"]), r.random() > 0.1))
    return out


def serial(rows, case, thr, answers, seed=(), k=5):
    """One group after the other: look up, reuse or mint; the last assignment of an entity stays."""
    cfg = C.ENTITY_CASES[case]

    def vec(name, definition):
        return hash_rows([f"{name}. {definition}" if cfg["style"] != "name" and definition else name])[0]

    schema, given, types = {n: (vec(n, d), p, d) for n, d, p in seed}, [], {}
    for item, o, fine, definition, parent, members, raw, ok in rows:
        q = vec(fine, definition)
        scored = [(-round(q @ v - (0.2 if cfg["parent"] and parent and p and p != parent else 0), 12), i, n) for i, (n, (v, p, _)) in enumerate(schema.items())]
        scored = sorted(scored)[:k]
        names = [n for _, _, n in scored]
        if not answers:
            final = names[0] if scored and -scored[0][0] >= thr else None
            decision = "embed_new" if final is None else "embed_reuse"
        elif not ok:
            final, decision = (names[0], "fallback_top1") if names else (None, "fallback_none")
        else:
            digits = [int(x) for x in raw.split() if x.isdigit()]
            pick = digits[0] if digits else ord(raw) - 65 if len(raw) == 1 and raw.isupper() else None
            pick = pick if pick is not None and pick < len(names) + 1 else None
            final = names[pick - 1] if pick else None
            decision = "fallback_parse_fail" if pick is None else "llm_new_entity" if pick == 0 else "llm_reuse"
        new = final is None
        if new:
            final = fine
            schema.setdefault(fine, (q, parent, definition))
        given.append((item, o, fine, final, new, decision, names))
        types.update(dict.fromkeys(members, final))
    return given, types, {(n, d, p) for n, (_, p, d) in schema.items()}


@pytest.mark.parametrize("case", list(C.ENTITY_CASES))
@pytest.mark.parametrize("answers", [False, True])
def test_growth_equals_the_serial_fold(spark, case, answers):
    rows = groups()
    df = spark.createDataFrame(rows, GROUPS).repartition(4)
    for seed in ((), (("bolt", "", "Tool"), ("ring of steel", "a round thing", "Good"))):
        given, types, schema = serial(rows, case, 0.7, answers, seed)
        start = spark.createDataFrame([(i - 10, *s) for i, s in enumerate(seed)], "ord long, name string, definition string, parent string") if seed else None
        got, grown = C.canonicalize_types(df, case, hashing_vector, seed=start, responses=answers, threshold=0.7)
        found = sorted((r.item_id, r.ord, r.fine, r.pred, r.is_new, r.decision, r.names) for r in got.collect())
        assert found == sorted(given)
        assert {r.entity: r.type for r in C.entity_type_map(got).collect()} == types
        assert {(r.name, r.definition, r.parent) for r in grown.collect()} == schema


def test_frozen_types_mint_nothing(spark):
    rows = groups(20)
    seed = spark.createDataFrame([(-2, "bolt", "", "Tool"), (-1, "ring", "a round thing", "Good")], "ord long, name string, definition string, parent string")
    got, schema = C.canonicalize_types(spark.createDataFrame(rows, GROUPS), "ec3_definition_parent", hashing_vector, seed=seed, allow_new=False, threshold=0.7)
    assert {r.pred for r in got.collect()} <= {"bolt", "ring"} and got.filter("is_new").count() == 0 and schema.count() == 2


def test_types_of_a_finished_run(spark):
    folder = tempfile.mkdtemp(prefix="graphloom-test-")
    run = Build(spark, folder, BuildConfig(relation_threshold=0.7), hashing_vector)
    slots = spark.createDataFrame([("has", "Slot", "Slot")], "relation string, head_type string, tail_type string")
    with pytest.raises(FileNotFoundError, match="entities_0"):
        run.entity_types_only(slots)
    ents = [(i, o, e, p, f, d) for i, o, f, d, p, ms, *_ in groups(15) for e in ms[:1]]
    run.stage("entities_0", lambda: spark.createDataFrame(ents, "item_id long, pos long, entity string, coarse string, fine string, description string"))
    triples = [(i, 0, e, "has", "nobody", "has") for i, _, e, *_ in ents]
    run.stage("decided_case1_embed_threshold_0", lambda: spark.createDataFrame(triples, "item_id long, pos long, h string, r string, t string, pred string"))
    out = run.entity_types_only(slots)
    _, types, _ = serial([(i, o, f, d, p, [e], "", True) for i, o, e, p, f, d in ents], "ec1_name_only", 0.7, False)
    assert {r.entity: r.type for r in out["entity_map_ec1_name_only"].collect()} == types
    assert {r.id: r.type for r in out["nodes_case1_embed_threshold"].collect()} == types | {"nobody": "Slot"}
    again = Build(spark, folder, run.config, lambda c: F.raise_error(F.lit("stored stages are not computed again")))
    assert {r.entity: r.type for r in again.entity_types_only(slots)["entity_map_ec1_name_only"].collect()} == types
