"""Reuse-or-create canonicalization of relations and entity types under three schema policies.

* frozen (policy 3): the schema does not change, so every occurrence is independent: retrieval, choice
  parsing and the fallback chain are plain expressions.
* growing (policies 1 and 2): see :mod:`graphloom.operators.growth`; entity types grow in ``canonicalize_types``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from graphloom.functions.text import strip
from graphloom.functions.vectors import fuse_concat, fuse_weighted
from graphloom.operators import growth
from graphloom.operators.leaders import Reach, elect
from graphloom.operators.retrieval import top_k
from graphloom.session import cut_lineage

# What each relation signal embeds, shows and constrains.
RELATION_CASES = {
    "case1_embed_threshold": dict(style="name", typed=False, field=None, llm=False, shows="name"),
    "case2_name_only": dict(style="name", typed=False, field=None, llm=True, shows="name"),
    "case3_name_gendef_edc": dict(style="name_gendef_edc", typed=False, field="general_definition_edc", llm=True,
                                  shows="general_definition_edc"),
    "case4_name_gendef_abstract": dict(style="name_gendef_abstract", typed=False,
                                       field="general_definition_abstract", llm=True,
                                       shows="general_definition_abstract"),
    "case5_name_detail": dict(style="name_detail", typed=False, field="definition", llm=True, shows="definition"),
    "case6_name_detail_headtail": dict(style="name_detail_headtail", typed=False, field="definition", llm=True,
                                       shows="typed"),
    "case7_detail_typed": dict(style="name_detail", typed=True, field="definition", llm=True, shows="typed"),
    "case8_concat": dict(style="concat", typed=False, field="definition", llm=True, shows="typed"),
    "case9_weighted": dict(style="weighted", typed=False, field="definition", llm=True, shows="typed"),
}
ENTITY_CASES = {
    "ec1_name_only": dict(style="name", parent=False, shows="name"),
    "ec2_name_definition": dict(style="name_definition", parent=False, shows="definition"),
    "ec3_definition_parent": dict(style="name_definition", parent=True, shows="parent"),
}
RELATION_THRESHOLD = 0.85
TYPE_PENALTY = 0.2


def relation_embedding_text(style: str, name: Column, definition: Column, edc: Column, abstract: Column,
                            head: Column, tail: Column) -> Column:
    """Text embedded for one relation; the fused styles embed the four parts on their own."""
    return {
        "name": name,
        "name_gendef_edc": F.format_string("%s. %s", name, edc),
        "name_gendef_abstract": F.format_string("%s. %s", name, abstract),
        "name_detail": F.format_string("%s. %s", name, definition),
        "name_detail_headtail": F.format_string("%s. %s. Head: %s. Tail: %s", name, definition, head, tail),
    }.get(style, name)


def entity_embedding_text(style: str, name: Column, definition: Column) -> Column:
    if style == "name":
        return name
    return F.when(F.coalesce(definition, F.lit("")) == "", name).otherwise(
        F.format_string("%s. %s", name, definition))


def relation_vectors(df: DataFrame, case: str, embed) -> DataFrame:
    """Add ``vec`` for a relation table using ``embed(Column) -> Column``; fused styles embed four parts."""
    style = RELATION_CASES[case]["style"]
    col = lambda c: F.coalesce(F.col(c), F.lit(""))
    if style in ("concat", "weighted"):
        fuse = fuse_concat if style == "concat" else fuse_weighted
        parts = df
        for part, source in (("n", "relation"), ("d", "definition"), ("h", "head_type"), ("t", "tail_type")):
            parts = parts.withColumn(f"_{part}", embed(col(source)))
        return parts.withColumn("vec", fuse("_n", "_d", "_h", "_t")).drop("_n", "_d", "_h", "_t")
    text = relation_embedding_text(style, col("relation"), col("definition"), col("general_definition_edc"),
                                   col("general_definition_abstract"), col("head_type"), col("tail_type"))
    return df.withColumn("vec", embed(text))


def visible_fields(case: str) -> Column:
    """The relation record a signal may see: its own definition field, plus slot types for typed signals."""
    cfg = RELATION_CASES[case]
    fields = [F.coalesce(F.col("relation"), F.lit("")).alias("relation")]
    if cfg["field"]:
        fields.append(F.coalesce(F.col(cfg["field"]), F.lit("")).alias(cfg["field"]))
    if cfg["field"] == "definition":
        fields += [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("head_type", "tail_type")]
    return F.struct(*fields)


def check_seed_schema(schema: DataFrame, case: str) -> DataFrame:
    """Seed rows that lack the definition field the signal depends on (must be empty before a run)."""
    field = RELATION_CASES[case]["field"]
    if field is None:
        return schema.limit(0)
    return schema.filter(F.coalesce(strip(F.col(field)), F.lit("")) == "")


def choice_line(shows: str, rank: Column, name: Column, definition: Column, head: Column, tail: Column,
                parent: Column | None = None) -> Column:
    """One numbered line of a multiple-choice prompt."""
    head_part = F.concat(rank.cast("string"), F.lit(". "), name)
    detail = F.coalesce(definition, F.lit(""))
    if shows == "name":
        return head_part
    if shows == "typed":
        return F.concat(head_part, F.lit(" | "), detail, F.lit(" | "), F.coalesce(head, F.lit("")),
                        F.lit(" -> "), F.coalesce(tail, F.lit("")))
    if shows == "parent":
        p = F.coalesce(parent, F.lit(""))
        base = F.concat(head_part, F.lit(" | "), detail)
        return F.when(p == "", base).otherwise(F.concat(base, F.lit(" | parent: "), p))
    return F.when(detail == "", head_part).otherwise(F.concat(head_part, F.lit(" | "), detail))


def prompt_choices(candidates: DataFrame, query_id: str, line: Column, rank: str = "rank") -> DataFrame:
    """``0. NONE`` followed by the ranked candidate lines: ``(query_id, choices)``."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), line.alias("l"))))
    return candidates.groupBy(query_id).agg(F.concat_ws("\n", F.lit("0. NONE"), F.transform(
        ordered, lambda s: s["l"])).alias("choices"))


def parse_choice(raw: Column, n: Column) -> Column:
    """First integer below ``n``; without any integer a lone capital letter (``A`` is 0); else NULL."""
    text = strip(F.coalesce(raw, F.lit("")))
    digits = F.regexp_extract(text, r"\b([0-9]+)\b", 1)
    letter = F.regexp_extract(text, r"\b([A-Z])\b", 1)
    number = F.when(digits != "", digits.try_cast("bigint")).when(letter != "", (F.ascii(letter) - 65).cast("bigint"))
    return F.when(number < n, number).cast("int")


def choose(names: Column, choice: Column, ok: Column, new_label: str) -> tuple[Column, Column]:
    """(chosen name or NULL, decision state) before the schema policy applies."""
    first = F.try_element_at(names, F.lit(1))
    final = (F.when(~ok, first).when(choice > 0, F.try_element_at(names, choice)))
    state = (F.when(~ok, F.when(first.isNull(), "fallback_none").otherwise("fallback_top1"))
             .when(choice.isNull(), "fallback_parse_fail").when(choice == 0, new_label).otherwise("llm_reuse"))
    return final, state


def choose_by_threshold(names: Column, scores: Column, threshold: float) -> tuple[Column, Column]:
    top, score = F.try_element_at(names, F.lit(1)), F.try_element_at(scores, F.lit(1))
    reuse = F.coalesce(score >= threshold, F.lit(False))
    return F.when(reuse, top), F.when(reuse, "embed_reuse").otherwise("embed_new")


def apply_policy(final: Column, state: Column, names: Column, raw_name: Column, allow_new: bool):
    """(pred, is_new, decision) under the schema policy."""
    if allow_new:
        return F.coalesce(final, raw_name), final.isNull(), state
    first = F.try_element_at(names, F.lit(1))
    suffix = F.when(final.isNotNull(), "").when(first.isNotNull(), "|frozen_top1").otherwise("|frozen_unmatched")
    return F.coalesce(final, first), F.lit(False), F.concat(state, suffix)


def _candidate_lists(cands: DataFrame, key: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", "name", "score")))
    return cands.groupBy(key).agg(F.transform(ordered, lambda s: s["name"]).alias("names"),
                                  F.transform(ordered, lambda s: s["score"]).alias("scores"))


def canonicalize_frozen(occurrences: DataFrame, keys: DataFrame, schema: DataFrame, *, key: str = "relation",
                        responses: bool = False, threshold: float = RELATION_THRESHOLD, k: int = 5, types=(),
                        penalty: float = 0.0, blanks_match: bool = False,
                        new_label: str = "llm_new_relation") -> DataFrame:
    """Decide every occurrence against a fixed schema.

    Candidates are retrieved once per distinct ``key`` (``keys(key, vec, *types)``) and joined back.
    With ``responses`` the occurrences carry ``raw_output`` and ``answered`` from a recorded model run;
    otherwise the cosine threshold decides.
    """
    cands = top_k(keys, schema, k, query_id=key, types=types, penalty=penalty, blanks_match=blanks_match)
    joined = occurrences.join(_candidate_lists(cands, key), key, "left")
    return _decide(joined, F.col(key), responses, threshold, False, new_label)


def _decide(joined, raw_name, responses, threshold, allow_new, new_label):
    names = F.coalesce(F.col("names"), F.array().cast("array<string>"))
    scores = F.coalesce(F.col("scores"), F.array().cast("array<double>"))
    if responses:
        choice = parse_choice(F.col("raw_output"), F.size(names) + 1)
        final, state = choose(names, choice, F.coalesce(F.col("answered"), F.lit(True)), new_label)
    else:
        choice = F.lit(None).cast("int")
        final, state = choose_by_threshold(names, scores, threshold)
    pred, is_new, decision = apply_policy(final, state, names, raw_name, allow_new)
    return (joined.withColumn("pred", pred).withColumn("is_new", is_new).withColumn("decision", decision)
            .withColumn("llm_choice", choice).withColumn("names", names).withColumn("scores", scores))


def canonicalize_growing(occurrences: DataFrame, keys: DataFrame, *, key: str = "relation",
                         seed: DataFrame | None = None, threshold: float = RELATION_THRESHOLD,
                         k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Threshold-decided growth over ``occurrences(position, key, …)`` with ``keys(key, vec)``.

    Returns ``(decisions, schema)``. ``seed(ord, name, vec)`` (negative ``ord``) exists beforehand.
    """
    uses = growth.first_use(occurrences, key).join(keys.select(key, "vec"), key)
    uses = uses.select("ord", F.col(key).alias("name"), "vec")
    known = uses
    if seed is not None:
        known = uses.join(seed.select("name"), "name", "left_anti")
    lead = growth.leader_clusters(known, threshold, strict=False, seeds=seed)
    minted = known.join(lead.filter("ord = leader").select("ord"), "ord").select("ord", "name", "vec")
    schema = minted if seed is None else seed.select("ord", "name", "vec").unionByName(minted)
    iv = growth.top_k_as_of(uses.select(F.col("name").alias("qid"), "vec"), schema, k)
    joined = growth.decide_as_of(occurrences, iv, key)
    return _decide(joined, F.col(key), False, threshold, True, "llm_new_relation"), schema


def replayed_mints(occurrences: DataFrame, key: str, seed: DataFrame | None, k: int) -> DataFrame:
    """``(ord, name)``: the names that recorded answers mint, and where."""
    occ = cut_lineage(occurrences.select("position", key, parse_choice(F.col("raw_output"), F.lit(k + 1)).alias("_pick"),
                                         F.coalesce(F.col("answered"), F.lit(True)).alias("_ok")))
    seed_names = [] if seed is None else [r["name"] for r in seed.select("name").orderBy("ord").limit(k).collect()]
    size, at, taken = len(seed_names), -(2 ** 62), list(seed_names)
    warm = []
    while size < k:
        is_new = F.col("_pick").isNull() | (F.col("_pick") == 0) | (F.col("_pick") > size)
        # an unanswered prompt falls back to the first candidate, and mints only while there is none
        cond = F.when(F.col("_ok"), is_new).otherwise(F.lit(size == 0))
        row = (occ.filter(F.col("position") > at).filter(cond).filter(~F.col(key).isin(taken) if taken else F.lit(True))
               .agg(F.min_by(F.struct("position", key), "position").alias("r")).first()["r"])
        if row is None:
            break
        warm.append((row["position"], row[key]))
        at, size = row["position"], size + 1
        taken.append(row[key])
    late = F.col("_ok") & (F.col("_pick").isNull() | (F.col("_pick") == 0))
    fresh = occ.filter((F.col("position") > at) & late).groupBy(F.col(key).alias("name")).agg(
        F.min("position").alias("ord"))
    if taken:
        fresh = fresh.filter(~F.col("name").isin(taken))
    if seed is not None:
        fresh = fresh.join(seed.select("name"), "name", "left_anti")
    spark = occurrences.sparkSession
    minted = fresh.select("ord", "name")
    if warm:
        minted = spark.createDataFrame(warm, "ord bigint, name string").unionByName(minted)
    return minted


def canonicalize_replayed(occurrences: DataFrame, keys: DataFrame, *, key: str = "relation",
                          seed: DataFrame | None = None, k: int = 5,
                          new_label: str = "llm_new_relation") -> tuple[DataFrame, DataFrame]:
    """Growth driven by recorded model answers (``raw_output``, ``answered``).

    An answer means NEW when it is 0, unreadable, or names a choice beyond the list. The list is shorter
    than ``k`` only until ``k`` elements exist, so the warm-up needs at most ``k`` aggregate look-ups; after
    it, NEW depends on the answer alone and everything is decided in parallel.
    """
    minted = replayed_mints(occurrences, key, seed, k)
    minted = minted.join(keys.select(F.col(key).alias("name"), "vec"), "name").select("ord", "name", "vec")
    schema = minted if seed is None else seed.select("ord", "name", "vec").unionByName(minted)
    iv = growth.top_k_as_of(keys.select(F.col(key).alias("qid"), "vec"), schema, k)
    joined = growth.decide_as_of(occurrences, iv, key)
    return _decide(joined, F.col(key), True, None, True, new_label), schema


def relation_signal(occurrences: DataFrame, case: str, embed) -> tuple[DataFrame, DataFrame]:
    """What a signal sees of ``occurrences(position, relation, definition, …)``; definitions belong to a record's own relation.

    Returns the occurrences with ``qid``, and ``(qid, vec, head_type, tail_type)`` of each distinct composed text (and slot types, if the
    signal looks at them): every text is embedded once, however many records hold it.
    """
    cfg = RELATION_CASES[case]
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = ["relation", "definition", "general_definition_edc", "general_definition_abstract", "head_type", "tail_type"]
    text = relation_embedding_text(cfg["style"], *[blank(c) for c in fields])
    seen = [text, *([blank("head_type"), blank("tail_type")] if cfg["typed"] else []),
            *([blank(c) for c in ("definition", "head_type", "tail_type")] if cfg["style"] in ("concat", "weighted") else [])]
    occ = occurrences.withColumn("qid", F.md5(F.to_json(F.array(*seen))))
    keys = occ.groupBy("qid").agg(F.min_by(F.struct(*[blank(c).alias(c) for c in fields]), "position").alias("f")).select("qid", "f.*")
    return occ, cut_lineage(relation_vectors(keys, case, embed).select("qid", "vec", "head_type", "tail_type"))


def canonicalize_signal(occurrences: DataFrame, case: str, embed, *, seed: DataFrame | None = None, allow_new: bool = True,
                        threshold: float = RELATION_THRESHOLD, penalty: float = TYPE_PENALTY, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Canonical relation of each occurrence under one of the nine signals: ``(decided, schema(ord, name, vec, head_type, tail_type))``.

    ``occurrences(position, item_id, relation, definition, general_definition_edc, general_definition_abstract, head_type, tail_type)``, with
    ``raw_output`` and ``answered`` of a recorded run for the signals that ask a model; the first signal decides by ``threshold``. A relation is
    minted by its first occurrence that reuses nothing, and keeps that record's definition and slot types. The typed signal takes ``penalty``
    from elements whose slot types differ. ``seed(ord, name, definition, …)`` exists beforehand, with negative ``ord``; a seed element
    without the definition that the signal reads is an error.
    """
    cfg = RELATION_CASES[case]
    types = {"types": ("head_type", "tail_type"), "penalty": penalty} if cfg["typed"] else {}
    occ, keys = relation_signal(occurrences, case, embed)
    held = ["ord", "name", "vec", "head_type", "tail_type"]
    if seed is not None:
        bad = check_seed_schema(seed, case).select("name").limit(1).collect()
        if bad:
            raise ValueError(f"{case} needs {cfg['field']} of every seed relation; {bad[0]['name']!r} has none")
        parts = seed.withColumn("relation", F.col("name"))
        seed = cut_lineage(relation_vectors(parts, case, embed).select("ord", "name", "vec", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in held[3:]]))
    if not allow_new:
        return canonicalize_frozen(occ, keys, seed, key="qid", responses=cfg["llm"], threshold=threshold, k=k, **types), seed
    if cfg["llm"]:
        at = replayed_mints(occ, "relation", seed, k)
        minted = at.join(occ.select(F.col("position").alias("ord"), "qid"), "ord").join(keys, "qid").select(*held)
    else:
        uses = occ.groupBy("qid").agg(F.min("position").alias("ord"), F.first("relation").alias("name")).join(keys, "qid")
        led = elect(uses.select("ord", "vec", "name"), Reach(threshold, False), seeds=seed, names=True)
        minted = uses.join(led.select("ord"), "ord", "left_semi").select(*held)
    schema = cut_lineage(minted if seed is None else seed.unionByName(minted))
    lists = growth.top_k_as_of(keys, schema, k, **types)
    return _decide(growth.decide_as_of(occ, lists, "qid"), F.col("relation"), cfg["llm"], threshold, True, "llm_new_relation"), schema


def entity_type_groups(entities: DataFrame) -> DataFrame:
    """One row per item and fine type: first definition and coarse type, members in order.

    ``entities(item_id, pos, entity, coarse, fine, description)``.
    """
    members = F.array_sort(F.collect_list(F.struct("pos", "entity")))
    first = F.min_by(F.struct("description", "coarse"), "pos")
    return entities.groupBy("item_id", "fine").agg(
        F.min("pos").alias("ord"), first["description"].alias("definition"), first["coarse"].alias("parent"),
        F.transform(members, lambda m: m["entity"]).alias("members"))


def type_signal(groups: DataFrame, case: str, embed) -> tuple[DataFrame, DataFrame]:
    """What a signal sees of ``groups(item_id, ord, fine, definition, parent, …)``, in corpus order; groups may bring their ``position``.

    Returns ``(occurrences, keys)``: the groups with ``position`` and ``qid``; and ``(qid, ord, name, kind, vec, definition, parent)``
    of each distinct type, embedded text and parent that the signal tells apart, where it is first used.
    """
    cfg = ENTITY_CASES[case]
    text = entity_embedding_text(cfg["style"], F.col("fine"), F.col("definition"))
    kind = F.col("parent") if cfg["parent"] else F.lit(None).cast("string")
    seen = groups.withColumns({"text": text, "kind": kind}).withColumn("qid", F.md5(F.to_json(F.struct("fine", "text", "kind"))))
    occ = seen if "position" in groups.columns else growth.order_number(seen, ["item_id", "ord"])
    first = F.min_by(F.struct("fine", "text", "kind", "definition", "parent"), "position")
    keys = occ.groupBy("qid").agg(F.min("position").alias("ord"), first.alias("f")).select(
        "qid", "ord", F.col("f.fine").alias("name"), F.col("f.kind").alias("kind"), F.col("f.text").alias("text"), "f.definition", "f.parent")
    return occ.drop("text", "kind"), cut_lineage(keys.withColumn("vec", embed(F.col("text"))).drop("text"))


def type_seed(schema: DataFrame, case: str, embed) -> DataFrame:
    """Entity types ``(ord, name, definition, parent)`` that exist beforehand as a signal embeds them; ``ord`` is negative."""
    cfg = ENTITY_CASES[case]
    return schema.select("ord", "name", F.col("parent").alias("kind") if cfg["parent"] else F.lit(None).cast("string").alias("kind"),
                         embed(entity_embedding_text(cfg["style"], F.col("name"), F.col("definition"))).alias("vec"), "definition", "parent")


def canonicalize_types(groups: DataFrame, case: str, embed, *, seed: DataFrame | None = None, allow_new: bool = True, responses: bool = False,
                       threshold: float = RELATION_THRESHOLD, penalty: float = TYPE_PENALTY, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Canonical type of each (record, fine type) group, under a schema that grows group by group.

    ``groups(item_id, ord, fine, definition, parent, members)`` in the order of records and first mentions, see
    ``entity_type_groups``. Candidates are the ``k`` best elements at the group's moment; an element of another parent costs
    ``penalty`` if the signal looks at parents. With ``responses`` the groups carry ``raw_output`` and ``answered`` of a recorded
    model run; otherwise ``threshold`` decides. A group that reuses nothing mints its fine type, unless a type of that name
    exists; an element keeps the definition and parent with which it was minted.

    Returns ``(decided, schema)``: the groups with ``pred``, ``is_new``, ``decision``, ``names``, ``scores``; and
    ``(ord, name, kind, vec, definition, parent)``. Minting is decided over distinct keys by leader election, in which a name leads once.
    """
    occ, keys = type_signal(groups, case, embed)
    types = {"types": ("kind",), "penalty": penalty, "blanks_match": True} if ENTITY_CASES[case]["parent"] else {}
    held = ["ord", "name", "kind", "vec", "definition", "parent"]
    seed = None if seed is None else cut_lineage(type_seed(seed, case, embed).select(*held))
    if not allow_new:
        out = canonicalize_frozen(occ, keys.drop("ord", "name", "definition", "parent"), seed, key="qid", responses=responses, threshold=threshold, k=k,
                                  new_label="llm_new_entity", **types)
        return out, seed
    if responses:
        at = replayed_mints(occ, "fine", seed, k)
        born = occ.select(F.col("position").alias("ord"), "qid", F.col("fine").alias("_fine"), F.struct("definition", "parent").alias("_own"))
        minted = at.join(born, "ord").join(keys.select("qid", "kind", "vec"), "qid").select(
            "ord", "name", "kind", "vec", "_own.definition", "_own.parent")
    else:
        reach = Reach(threshold, False, types.get("penalty", 0.0))
        led = elect(keys.select("ord", "vec", "kind", "name"), reach, seeds=seed, names=True)
        minted = keys.join(led.select("ord"), "ord", "left_semi").select(*held)
    schema = cut_lineage(minted if seed is None else seed.unionByName(minted))
    lists = growth.top_k_as_of(keys.select("qid", "vec", "kind"), schema, k, **types)
    joined = growth.decide_as_of(occ, lists, "qid")
    return _decide(joined, F.col("fine"), responses, threshold, True, "llm_new_entity"), schema


def entity_type_map(decided: DataFrame) -> DataFrame:
    """Surface -> canonical type, last assignment wins: ``(entity, type)``."""
    rows = decided.filter("pred is not null").select(
        F.struct("item_id", "ord").alias("at"), "pred", F.explode("members").alias("entity"))
    return rows.groupBy("entity").agg(F.max_by("pred", "at").alias("type"))


def aliases(decided: DataFrame, canonical: str = "pred", raw: str = "relation", position: str = "position"):
    """Raw names merged into each canonical name, in first-use order: ``(canonical, aliases)``."""
    firsts = decided.filter(F.col(canonical).isNotNull() & ~F.col("is_new") & (F.col(raw) != F.col(canonical)))
    firsts = firsts.groupBy(canonical, raw).agg(F.min(position).alias("_at"))
    ordered = F.array_sort(F.collect_list(F.struct("_at", raw)))
    return firsts.groupBy(canonical).agg(F.transform(ordered, lambda s: s[raw]).alias("aliases"))


def predicted_triples(decided: DataFrame) -> DataFrame:
    """Canonical triples: the relation replaced by the prediction, unmatched rows dropped."""
    return decided.filter("pred is not null").withColumn("r", F.col("pred"))
