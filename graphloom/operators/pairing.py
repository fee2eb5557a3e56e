"""Alignment of predicted and reference triples inside one record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from graphloom.functions.text import norm_entity

RANK_BUCKET = 1 << 20


def kth_occurrence(df: DataFrame, keys: list, order: str = "pos", bucket: int = RANK_BUCKET,
                   longest: int | None = None) -> DataFrame:
    """Add ``k``: the running number of a row among the rows with the same keys, by ``order``.

    List positions are normally far below ``bucket`` and one window does it. Longer lists are numbered per
    position bucket and shifted by the sizes of the buckets before, so no key is ever ranked in one task.
    ``longest`` is the largest position if the caller knows it; otherwise it is measured.
    """
    if longest is None:
        longest = df.agg(F.max(order)).first()[0] or 0
    w = W.partitionBy(*keys).orderBy(order)
    if longest < bucket:
        return df.withColumn("k", F.row_number().over(w))
    df = df.withColumn("_b", F.floor(F.col(order) / bucket))
    sizes = df.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.withColumn("_s", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(*keys, "_b").orderBy(order)
    return (df.withColumn("k", F.row_number().over(inside)).join(shift, [*keys, "_b"])
            .withColumn("k", F.col("k") + F.col("_s")).drop("_b", "_s"))


def keyed(triples: DataFrame, norm=norm_entity) -> DataFrame:
    """Add the normalised pair key ``(nh, nt)``."""
    return triples.withColumn("nh", norm(F.col("h"))).withColumn("nt", norm(F.col("t")))


def relation_mentions(pred: DataFrame, gold: DataFrame, longest: int | None = None) -> DataFrame:
    """Pair the k-th predicted with the k-th reference triple of a record's (head, tail) pair.

    ``pred(case_id, item_id, pos, h, r, t)``, ``gold(item_id, pos, h, r, t)`` -> ``(case_id, item_id, pred,
    gold)``. Both inputs are tagged and shuffled once on (record, head, tail); numbering and pairing reuse
    that partitioning, and the reference is not repeated per case.
    """
    cols = ["case_id", "item_id", "pos", "nh", "nt", "r"]
    p = keyed(pred).select(cols)
    g = keyed(gold).withColumn("case_id", F.lit(None).cast(dict(pred.dtypes)["case_id"])).select(cols)
    rows = p.unionByName(g).repartition("item_id", "nh", "nt")
    rows = kth_occurrence(rows, ["item_id", "nh", "nt", "case_id"], longest=longest)
    ref = F.max(F.when(F.col("case_id").isNull(), F.col("r"))).alias("gold")
    found = F.collect_list(F.when(F.col("case_id").isNotNull(), F.struct("case_id", "r"))).alias("found")
    return (rows.groupBy("item_id", "nh", "nt", "k").agg(ref, found).filter("gold is not null")
            .select("item_id", "gold", F.explode("found").alias("f"))
            .select("f.case_id", "item_id", F.col("f.r").alias("pred"), "gold"))


def entity_type_mentions(gold: DataFrame, decided: DataFrame, slot_types: DataFrame,
                         grounding: DataFrame | None = None) -> DataFrame:
    """(predicted type, slot type, slot status) per entity occurrence in a reference triple.

    ``decided(ec_case, item_id, ord, pred, members)``; ``slot_types(relation, head_type, tail_type)``;
    ``grounding(relation, head_status, tail_status)``. Relations are compared by normalised name, members
    by normalised surface, and the last type given to a surface in a record counts.
    """
    typed = typed_surfaces(decided)
    slots = slot_types.select(norm_entity(F.col("relation")).alias("nr"), "head_type", "tail_type")
    slots = slots.groupBy("nr").agg(F.first("head_type").alias("head_type"), F.first("tail_type").alias("tail_type"))
    if grounding is None:
        status = slots.select("nr", F.lit(None).cast("string").alias("head_status"),
                              F.lit(None).cast("string").alias("tail_status"))
    else:
        status = grounding.select(norm_entity(F.col("relation")).alias("nr"), "head_status", "tail_status")
    info = slots.join(status, "nr", "left")
    rows = (keyed(gold).withColumn("nr", norm_entity(F.col("r"))).join(info, "nr")
            .select("item_id", F.explode(F.array(
                F.struct(F.col("nh").alias("surface"), F.col("head_type").alias("gold"),
                         F.coalesce("head_status", F.lit("na")).alias("status")),
                F.struct(F.col("nt").alias("surface"), F.col("tail_type").alias("gold"),
                         F.coalesce("tail_status", F.lit("na")).alias("status")))).alias("o"))
            .select("item_id", "o.*").filter("gold is not null and gold <> ''"))
    return rows.join(typed, ["item_id", "surface"]).select("ec_case", "item_id", "pred", "gold", "status")


def entity_kb_mentions(gold: DataFrame, decided: DataFrame, kb_types: DataFrame) -> DataFrame:
    """Like :func:`entity_type_mentions` with the knowledge-base type of the surface itself.

    ``kb_types(surface, schema_type, status)`` is keyed by normalised surface; only linked rows count.
    """
    linked = kb_types.filter("status = 'linked' and schema_type is not null").select(
        "surface", F.col("schema_type").alias("gold"))
    rows = keyed(gold).select("item_id", F.explode(F.array("nh", "nt")).alias("surface")).join(linked, "surface")
    return rows.join(typed_surfaces(decided), ["item_id", "surface"]).select("ec_case", "item_id", "pred", "gold")


def typed_surfaces(decided: DataFrame) -> DataFrame:
    rows = decided.filter("pred is not null").select(
        "ec_case", "item_id", "pred", "ord", F.posexplode("members").alias("m", "member"))
    return rows.groupBy("ec_case", "item_id", norm_entity(F.col("member")).alias("surface")).agg(
        F.max_by("pred", F.struct("ord", "m")).alias("pred"))


def jaccard_prefix(tokens: Column, threshold: float) -> Column:
    """Smallest sorted-token prefix that any set within the Jaccard threshold must share (exact filter)."""
    t = F.array_sort(tokens)
    n = F.size(t)
    return F.slice(t, F.lit(1), n - F.ceil(n * F.lit(threshold)).cast("int") + 1)
