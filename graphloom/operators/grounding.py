"""Grounding of schema slots and surfaces on knowledge-base snapshot tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.functions.text import is_value_literal, norm_entity
from graphloom.session import cut_lineage, ratio


def ancestor_closure(parents: DataFrame) -> DataFrame:
    """Reflexive transitive closure of ``parents(child, parent)``: ``(node, ancestor)``.

    Paths double in length every round, so the number of joins is logarithmic in the depth.
    """
    nodes = parents.select(F.col("child").alias("n")).union(parents.select("parent")).distinct()
    cur = nodes.select(F.col("n").alias("node"), F.col("n").alias("ancestor")).union(
        parents.select("child", "parent")).distinct()
    cur = cut_lineage(cur)
    size = cur.count()
    while True:
        step = cur.alias("a").join(cur.alias("b"), F.col("a.ancestor") == F.col("b.node")).select(
            F.col("a.node").alias("node"), F.col("b.ancestor").alias("ancestor")).distinct()
        cur = cut_lineage(step)
        grown = cur.count()
        if grown == size:
            return cur
        size = grown


def slot_status(slots: DataFrame, allowed: DataFrame, closure: DataFrame) -> DataFrame:
    """Status of every slot class against the classes a knowledge base allows.

    ``slots(relation, slot, cls)``, ``allowed(relation, slot, allowed)``. The order of the tests is fixed:
    confirmed, narrower (slot class below an allowed one), broader (above one), else mismatch.
    """
    a = slots.join(allowed, ["relation", "slot"], "left")
    up = closure.select(F.col("node").alias("cls"), F.col("ancestor").alias("allowed"), F.lit(True).alias("below"))
    down = closure.select(F.col("node").alias("allowed"), F.col("ancestor").alias("cls"), F.lit(True).alias("above"))
    rows = a.join(up, ["cls", "allowed"], "left").join(down, ["cls", "allowed"], "left")
    any_ = lambda c: F.max(F.coalesce(c, F.lit(False)))
    s = rows.groupBy("relation", "slot", "cls").agg(
        any_(F.col("allowed").isNotNull()).alias("has"), any_(F.col("allowed") == F.col("cls")).alias("eq"),
        any_(F.col("below")).alias("below"), any_(F.col("above")).alias("above"))
    return s.select("relation", "slot", "cls", F.when(F.col("cls").isNull(), "literal_or_unmapped")
                    .when(~F.col("has"), "unverified").when(F.col("eq"), "confirmed").when(F.col("below"), "narrower")
                    .when(F.col("above"), "broader").otherwise("mismatch").alias("status"))


def apply_overrides(status: DataFrame, overrides: DataFrame) -> DataFrame:
    """Force the status of adjudicated slots."""
    o = overrides.select("relation", "slot", F.col("status").alias("_s"))
    return status.join(o, ["relation", "slot"], "left").withColumn("status", F.coalesce("_s", "status")).drop("_s")


def status_histogram(status: DataFrame) -> DataFrame:
    return status.groupBy("slot", "status").agg(F.count(F.lit(1)).alias("n"))


def most_specific_type(entity_classes: DataFrame, type_classes: DataFrame, closure: DataFrame) -> DataFrame:
    """Schema type of an entity: applicable types rank by direct class first, then by depth, then by name.

    ``entity_classes(entity, cls)``, ``type_classes(type, cls)``; depth is the number of ancestors.
    """
    depth = closure.groupBy(F.col("node").alias("cls")).agg(F.count(F.lit(1)).alias("depth"))
    reach = entity_classes.join(closure.withColumnRenamed("node", "cls"), "cls", "left").select(
        "entity", "cls", F.coalesce("ancestor", "cls").alias("up"))
    hits = reach.join(type_classes.select("type", F.col("cls").alias("up")), "up").groupBy("entity", "type", "up").agg(
        F.max(F.col("cls") == F.col("up")).alias("direct"))
    hits = hits.join(depth.withColumnRenamed("cls", "up"), "up", "left").fillna(1, ["depth"])
    rank = F.struct((~F.col("direct")).alias("a"), (-F.col("depth")).alias("b"), F.col("type").alias("c"))
    return hits.groupBy("entity").agg(F.min_by("type", rank).alias("type"))


def resolve_properties(relations: DataFrame, labels: DataFrame, alias: DataFrame, constrained: DataFrame) -> DataFrame:
    """Property of each relation: by label, else by alias; one that has constraints is preferred.

    ``labels(name, prop, ord)``, ``alias(name, prop, ord)``, ``constrained(prop)``.
    """
    def picks(source, via):
        return source.select(F.col("name").alias("relation"), "prop", "ord", F.lit(via).alias("via"))

    by_label = relations.join(picks(labels, "label"), "relation")
    rest = relations.join(by_label.select("relation"), "relation", "left_anti")
    cands = by_label.unionByName(rest.join(picks(alias, "alias"), "relation"))
    cands = cands.join(constrained.select("prop").distinct().withColumn("ok", F.lit(True)), "prop", "left")
    best = cands.groupBy("relation").agg(F.min_by(F.struct("prop", "via"), F.struct(
        F.col("ok").isNull().alias("x"), "ord")).alias("p"))
    return relations.join(best, "relation", "left").select("relation", F.col("p.prop").alias("prop"),
                                                           F.coalesce("p.via", F.lit("none")).alias("via"))


def type_class_map(types: DataFrame, curated: DataFrame, class_labels: DataFrame, search: DataFrame) -> DataFrame:
    """Class of each schema type: curated and label-verified, else curated as is, else found by label."""
    rows = (types.join(curated.select("type", F.col("cls").alias("c")), "type", "left")
            .join(class_labels.select(F.col("cls").alias("c"), "label"), "c", "left")
            .join(search.select(F.col("label").alias("type"), F.col("cls").alias("s")), "type", "left"))
    status = (F.when(F.col("c").isNotNull() & (F.lower("label") == F.lower("type")), "verified")
              .when(F.col("c").isNotNull(), "curated").when(F.col("s").isNotNull(), "searched").otherwise("unresolved"))
    return rows.select("type", F.coalesce("c", "s").alias("cls"), status.alias("status"))


def surface_roles(triples: DataFrame) -> DataFrame:
    """Distinct surfaces with the slots they fill: ``(surface, roles)``."""
    ends = triples.select(F.explode(F.array(
        F.struct(F.trim("h").alias("surface"), F.lit(1).alias("head"), F.lit(0).alias("tail")),
        F.struct(F.trim("t").alias("surface"), F.lit(0).alias("head"), F.lit(1).alias("tail")))).alias("e")).select("e.*")
    s = ends.groupBy("surface").agg(F.max("head").alias("head"), F.max("tail").alias("tail"))
    return s.select("surface", F.when((F.col("head") == 1) & (F.col("tail") == 1), "head,tail").when(
        F.col("head") == 1, "head").otherwise("tail").alias("roles"))


def link_entities(surfaces: DataFrame, labels: DataFrame, aliases: DataFrame, search: DataFrame,
                  entity_types: DataFrame) -> DataFrame:
    """Linking cascade: exact label, else alias, else search; the first candidate with a schema type wins.

    Candidate tables are ``(name, kb_id, ord)``; ``entity_types(entity, type)`` maps knowledge-base ids to
    schema types and lists ids with a class but no schema type as NULL. Returns one row per surface with
    ``kb_id``, ``schema_type``, ``status`` and ``link_via``.
    """
    lit = surfaces.select("surface", is_value_literal(F.col("surface")).alias("literal"))
    todo = lit.filter(~F.col("literal")).select("surface")
    found = None
    for via, table in (("label", labels), ("alias", aliases), ("search", search)):
        c = todo.join(table.select(F.col("name").alias("surface"), "kb_id", "ord"), "surface").withColumn("via", F.lit(via))
        todo = todo.join(c.select("surface"), "surface", "left_anti")
        found = c if found is None else found.unionByName(c)
    types = entity_types.select(F.col("entity").alias("kb_id"), "type", F.lit(True).alias("classed"))
    rows = found.join(types, "kb_id", "left")
    best = rows.groupBy("surface").agg(
        F.count(F.lit(1)).alias("n_candidates"), F.first("via").alias("link_via"),
        F.min_by(F.struct("kb_id", "type", "classed"), F.struct(
            F.col("type").isNull().alias("a"), F.col("classed").isNull().alias("b"), "ord")).alias("b"))
    rows = lit.join(best, "surface", "left")
    status = (F.when(F.col("literal"), "literal").when(F.col("b").isNull(), "unlinked")
              .when(F.col("b.type").isNotNull(), "linked").when(F.col("b.classed").isNull(), "no_p31")
              .when(F.col("n_candidates") > 1, "ambiguous").otherwise("no_type_match"))
    return rows.select("surface", norm_entity(F.col("surface")).alias("surface_norm"), F.col("b.kb_id").alias("kb_id"),
                       F.col("b.type").alias("schema_type"), status.alias("status"), "link_via",
                       F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"))


def follow_redirects(surfaces: DataFrame, classes: DataFrame, redirects: DataFrame) -> DataFrame:
    """Classes of each surface, taken from its redirect target when it has none itself.

    ``classes(name, cls)``, ``redirects(name, target)`` -> ``(surface, cls, via_redirect)``.
    """
    own = surfaces.join(classes.select(F.col("name").alias("surface"), "cls"), "surface")
    bare = surfaces.join(own.select("surface"), "surface", "left_anti")
    moved = (bare.join(redirects.select(F.col("name").alias("surface"), "target"), "surface")
             .join(classes.select(F.col("name").alias("target"), "cls"), "target"))
    return own.select("surface", "cls", F.lit(None).cast("string").alias("via_redirect")).unionByName(
        moved.select("surface", "cls", F.col("target").alias("via_redirect")))


def redirect_types(surfaces: DataFrame, classes: DataFrame, redirects: DataFrame, type_classes: DataFrame,
                   closure: DataFrame) -> DataFrame:
    """Status per surface after following redirects: literal, unlinked, linked or no_type_match."""
    lit = surfaces.select("surface", is_value_literal(F.col("surface")).alias("literal"))
    found = follow_redirects(lit.filter(~F.col("literal")).select("surface"), classes, redirects)
    types = most_specific_type(found.select(F.col("surface").alias("entity"), "cls"), type_classes, closure)
    any_ = found.groupBy("surface").agg(F.max("via_redirect").alias("via_redirect"))
    rows = lit.join(any_.withColumn("has", F.lit(True)), "surface", "left").join(
        types.select(F.col("entity").alias("surface"), "type"), "surface", "left")
    return rows.select("surface", F.col("type").alias("schema_type"), "via_redirect", F.when(F.col("literal"), "literal")
                       .when(F.col("has").isNull(), "unlinked").when(F.col("type").isNull(), "no_type_match")
                       .otherwise("linked").alias("status"))


def link_report(linked: DataFrame) -> DataFrame:
    """Counts per status and the share of entities linked: one row per status."""
    n = linked.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(F.lit(1))  # one row per status
    ents = F.sum(F.when(F.col("status") != "literal", F.col("n")).otherwise(0)).over(w)
    hit = F.sum(F.when(F.col("status") == "linked", F.col("n")).otherwise(0)).over(w)
    return n.withColumn("entity_coverage", ratio(hit, ents))
