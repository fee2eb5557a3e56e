"""Schema-level operators: set comparison, redundancy, growth over time, merges, seed coverage."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.functions.text import norm_schema_relation
from graphloom.functions.vectors import DIGITS, matrix
from graphloom.operators.growth import leader_clusters, order_number
from graphloom.operators.retrieval import STRIP_BYTES, TILE_COLUMNS, TILE_ROWS, nearest_other
from graphloom.session import cut_lineage, ratio



def schema_precision(pred: DataFrame, gold: DataFrame, normalised: bool = False) -> DataFrame:
    """Share of predicted relation names that the reference schema has: ``(n_pred, n_hit, precision)``."""
    name = norm_schema_relation(F.col("relation")) if normalised else F.col("relation")
    p = pred.select(name.alias("r")).distinct()
    g = gold.select(name.alias("r")).distinct().withColumn("hit", F.lit(1))
    s = p.join(g, "r", "left").agg(F.count(F.lit(1)).alias("n_pred"), F.count("hit").alias("n_hit"))
    return s.withColumn("precision", ratio("n_hit", "n_pred"))


def gold_coverage(gold_relations: DataFrame, seed: DataFrame) -> DataFrame:
    """Share of reference relations present in a seed schema, with the missing ones."""
    g = gold_relations.select("r").distinct()
    s = seed.select(F.col("relation").alias("r")).distinct().withColumn("hit", F.lit(1))
    rows = g.join(s, "r", "left")
    return rows.agg(F.count(F.lit(1)).alias("n_gold"), F.count("hit").alias("n_covered"),
                    F.array_join(F.array_sort(F.collect_set(F.when(F.col("hit").isNull(), F.col("r")))), ",")
                    .alias("missing")).withColumn("coverage", ratio("n_covered", "n_gold"))


def lexical_redundancy(schema: DataFrame) -> DataFrame:
    """Share of relation pairs that are equal or contain one another after normalisation.

    Equal names and containments are found by an equi-join on substrings: every name offers its distinct
    substrings that are themselves names, so only real hits are formed instead of all pairs.
    """
    names = schema.select(F.col("ord"), norm_schema_relation(F.col("relation")).alias("n"))
    total = names.agg(F.count(F.lit(1)).alias("k")).withColumn("pairs", F.col("k") * (F.col("k") - 1) / 2)
    copies = names.groupBy("n").agg(F.count(F.lit(1)).alias("c"))
    same = copies.select((F.col("c") * (F.col("c") - 1) / 2).alias("x"))
    # substrings of each distinct name, joined to the distinct names
    size = F.length("n")
    subs = copies.filter(size > 0).select("n", "c", F.explode(F.array_distinct(F.flatten(F.transform(
        F.sequence(F.lit(1), size), lambda i: F.transform(
            F.sequence(F.lit(1), size - i + 1), lambda l: F.substring(F.col("n"), i, l)))))).alias("s"))
    inner = copies.select(F.col("n").alias("s"), F.col("c").alias("sc"))
    part = subs.filter("s <> n").join(inner, "s").select((F.col("c") * F.col("sc")).alias("x"))
    # the empty string is contained in every other name
    empty = copies.filter("n = ''").select(F.col("c").alias("e")).withColumn("_", F.lit(1))
    blank = copies.filter("n <> ''").agg(F.sum("c").alias("rest")).withColumn("_", F.lit(1)).join(empty, "_").select(
        (F.col("rest") * F.col("e")).alias("x"))
    hits = same.unionByName(part.select(F.col("x").cast("double"))).unionByName(
        blank.select(F.col("x").cast("double"))).agg(F.coalesce(F.sum("x"), F.lit(0.0)).alias("redundant"))
    return total.withColumn("_", F.lit(1)).join(hits.withColumn("_", F.lit(1)), "_").select(
        F.col("k").alias("n_relations"), F.col("redundant").cast("bigint").alias("n_redundant"),
        ratio("redundant", "pairs").alias("redundancy"))


def semantic_redundancy(schema: DataFrame) -> DataFrame:
    """Mean over the schema of the highest cosine to another element; zero below two elements."""
    best = nearest_other(schema)
    return best.agg(F.count(F.lit(1)).alias("n_relations"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("redundancy"))


def redundant_pairs(schema: DataFrame, threshold: float = 0.85, batch: int = 2048) -> DataFrame:
    """Pairs of schema elements with cosine above the threshold: ``(a, b, score)`` with ``a`` before ``b``.

    The result is the pair list itself, so its size is the answer's size. Elements meet in the same exact
    block join as instances do: strips of bounded size against strips of bounded size, ``batch`` rows at a time. A row is
    copied once per strip.
    """
    size = schema.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    n, strip = size["n"], max(batch, STRIP_BYTES // (8 * max(1, size["d"] or 1)))
    spread = math.isqrt(8 * schema.sparkSession.sparkContext.defaultParallelism)  # strips that give each core some pairs of them
    blocks = max(1, -(-n // strip), min(-(-n // batch), spread))
    rows = schema.select("ord", "name", F.col("vec").cast("array<double>").alias("vec")).withColumn(
        "home", F.pmod(F.xxhash64("ord"), F.lit(blocks)).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.struct(
        F.least(x, F.col("home")).alias("x"), F.greatest(x, F.col("home")).alias("y")))
    tasks = rows.withColumn("t", F.explode(meet)).select("*", "t.x", "t.y").drop("t")

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ord").reset_index(drop=True)
        v, home, name = np.stack(pdf["vec"].to_numpy()), pdf["home"].to_numpy(), pdf["name"].to_numpy(dtype=object)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for a in range(0, len(v), batch):
            for b in range(a, len(v), batch):
                s = v[a:a + batch] @ v[b:b + batch].T
                ok = np.triu(s > threshold, 1) if a == b else s > threshold
                if pdf["x"].iloc[0] != pdf["y"].iloc[0]:
                    ok &= home[a:a + batch, None] != home[None, b:b + batch]
                i, j = np.nonzero(ok)
                found.append((i + a, j + b, s[i, j]))
        i, j, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        column = lambda at: pd.Series(name[at], dtype=object)
        return pd.DataFrame({"a": column(i), "b": column(j), "score": scores})

    return tasks.groupBy("x", "y").applyInPandas(pairs, "a string, b string, score double")


def _meet_best(x, xo, y, yo, threshold, best):
    """Take into ``best`` (score and number per row of ``x`` and of ``y``) the pairs more similar than ``threshold``; rows are in order.

    Single precision tells which pairs may be; only these are worked out and rounded. Equal scores go to the lower number.
    """
    far = [float(np.sqrt((m * m).sum(axis=1).max(initial=0.0))) for m in (x, y)]
    slack = 4.0 * (x.shape[1] + 2) * np.finfo(np.float32).eps * max(1.0, far[0] * far[1])
    small, same = [m.astype(np.float32) for m in (x, y)], xo is yo
    for a in range(0, len(x), TILE_ROWS):
        for b in range(0, len(y), TILE_COLUMNS):
            rows, cols = slice(a, a + TILE_ROWS), slice(b, b + TILE_COLUMNS)
            apart = small[0][rows] @ small[1][cols].T <= threshold - slack  # not so what is no number: it is worked out too
            count = apart.size - np.count_nonzero(apart)
            if not count:
                continue
            near = ~apart
            if same:
                i = np.arange(max(a, b), min(a + near.shape[0], b + near.shape[1]))
                near[i - a, i - b] = False
            if count > near.size // 16:  # a dense tile holds no list of its pairs
                full = np.round(x[rows] @ y[cols].T, DIGITS)
                full[~near] = -np.inf
                found = [(np.arange(len(full)) + a, full.argmax(axis=1) + b), (full.argmax(axis=0) + a, np.arange(full.shape[1]) + b)]
                found = [(r, c, full[r - a, c - b]) for r, c in found]
            else:
                r, c = (k + start for k, start in zip(np.nonzero(near), (a, b), strict=True))
                found = [(r, c, np.round(np.einsum("ij,ij->i", x[r], y[c]), DIGITS))] * 2
            for (r, c, v), own, other, (score, who) in zip(found, (0, 1), (yo, xo), best, strict=True):
                at, them = (r, other[c]) if own == 0 else (c, other[r])
                over = v > threshold
                at, them, v = at[over], them[over], v[over]
                order = np.lexsort((them, -v, at))
                at, them, v = at[order], them[order], v[order]
                first = np.ones(len(at), dtype=bool)
                first[1:] = at[1:] != at[:-1]
                at, them, v = at[first], them[first], v[first]
                better = (v > score[at]) | ((v == score[at]) & (them < who[at]))
                score[at[better]], who[at[better]] = v[better], them[better]


def nearest_above(points: DataFrame, threshold: float, strip_bytes: int = STRIP_BYTES) -> DataFrame:
    """The most similar other point of ``points(id, vec)``, for those that have one above ``threshold``: ``(id, other, score)``.

    Strips of bounded size meet each other once, for both sides; a row is copied once per strip and a task emits one pair a row.
    """
    size = points.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("d")).first()
    n, strip = size["n"], max(TILE_ROWS, strip_bytes // (8 * max(1, size["d"] or 1)))
    blocks = max(1, -(-n // strip), min(-(-n // TILE_ROWS), math.isqrt(8 * points.sparkSession.sparkContext.defaultParallelism)))
    rows = points.select("id", F.col("vec").cast("array<double>").alias("vec")).withColumn("home", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    meet = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.struct(
        F.least(x, F.col("home")).alias("x"), F.greatest(x, F.col("home")).alias("y")))
    tasks = rows.withColumn("t", F.explode(meet)).select("id", "vec", "home", "t.x", "t.y")

    def cell(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        home, left = table.column("home").to_numpy(), table.column("x")[0].as_py()
        ids, vec = table.column("id").to_numpy(), matrix(table.column("vec"))
        right = table.column("y")[0].as_py()
        sides = [home == left, home == right]
        if not all(m.any() for m in sides):
            return pa.table({"id": pa.array([], pa.int64()), "other": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        best = [(np.full(m.sum(), -np.inf), np.full(m.sum(), np.iinfo(np.int64).max)) for m in sides]
        x, xo = vec[sides[0]], ids[sides[0]]
        y, yo = (x, xo) if left == right else (vec[sides[1]], ids[sides[1]])
        _meet_best(x, xo, y, yo, threshold, best)
        found = [np.flatnonzero(score > threshold) for score, _ in best]
        return pa.table({"id": np.concatenate([ids[m][k] for m, k in zip(sides, found, strict=True)]),
                         "other": np.concatenate([who[k] for (_, who), k in zip(best, found, strict=True)]),
                         "score": np.concatenate([score[k] for (score, _), k in zip(best, found, strict=True)])})

    met = tasks.groupBy("x", "y").applyInArrow(cell, "id long, other long, score double")
    return met.groupBy("id").agg(F.max(F.struct("score", (-F.col("other")).alias("o"))).alias("b")).select(
        "id", (-F.col("b.o")).alias("other"), F.col("b.score").alias("score"))


def average_linkage_clusters(schema: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Average-linkage clusters of ``schema(ord, name, vec)`` at cosine distance ``1 - threshold``: ``(name, cluster)``.

    The mean similarity of two clusters is the product of their mean vectors, so a cluster is one row ``(id, n, vec)`` and no pair
    of elements is kept. In every round each cluster finds its nearest other one (exact top-k), and clusters that are each other's
    nearest and more similar than ``threshold`` become one, at once: a merge never brings a cluster nearer to a third than the
    nearer of its parts was, so these are merges of the serial order too. For the same reason a cluster without a neighbour
    above the threshold is final and leaves. Equal vectors are one cluster from the start. A cluster is named by its smallest ``ord``.
    """
    rows = cut_lineage(schema.select("ord", "name", F.col("vec").cast("array<double>").alias("vec")))
    state = cut_lineage(rows.groupBy("vec").agg(F.min("ord").alias("id"), F.count(F.lit(1)).cast("double").alias("n")))
    label = cut_lineage(rows.join(state.select("vec", "id"), "vec").select("name", "id"))
    while True:
        best = cut_lineage(nearest_above(state.select("id", "vec"), threshold))
        back = best.select(F.col("id").alias("other"), F.col("other").alias("id"))
        pairs = cut_lineage(best.join(back, ["id", "other"]).filter("id < other").select("id", "other"))
        if pairs.isEmpty():
            break
        gone = pairs.select(F.col("other").alias("id"), F.col("id").alias("into"))
        moved = state.join(best.select("id"), "id", "left_semi").join(gone, "id", "left").select(F.coalesce("into", "id").alias("id"), "n", "vec")
        one = moved.groupBy("id").agg(F.sum("n").alias("n"), F.collect_list(F.struct("n", "vec")).alias("parts"))  # two parts at most
        mean = F.aggregate("parts", F.transform(F.col("parts")[0]["vec"], lambda x: F.lit(0.0)), lambda acc, p: F.zip_with(
            acc, p["vec"], lambda x, y: x + y * p["n"]))
        state = cut_lineage(one.select("id", "n", F.transform(mean, lambda x: x / F.col("n")).alias("vec")))
        label = cut_lineage(label.join(gone, "id", "left").select("name", F.coalesce("into", "id").alias("id")))
    first = rows.select(F.col("ord").alias("id"), F.col("name").alias("cluster"))
    return label.join(first, "id").select("name", "cluster")


def schema_growth(used: DataFrame, by=()) -> DataFrame:
    """Size of the used schema after every record, from ``used(by…, item_id, r)``.

    Only first uses matter. The running total is a window over one row per record that introduced
    something (at most the size of the schema), joined back by range of records.
    """
    by = list(by)
    first = used.filter(F.col("r").isNotNull()).groupBy(*by, "r").agg(F.min("item_id").alias("item_id"))
    steps = first.groupBy(*by, "item_id").agg(F.count(F.lit(1)).alias("added"))
    w = W.partitionBy(*by).orderBy("item_id")
    run = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    return steps.select(*by, F.col("item_id").alias("since"), "added", F.sum("added").over(run).alias("size"),
                        F.lead("item_id").over(w).alias("until"))


def schema_as_of(used: DataFrame, n_items: int, by=()) -> DataFrame:
    """Schema after the first ``n_items`` records, in first-use order: ``(by…, r, ord)``."""
    by = list(by)
    first = used.filter((F.col("item_id") < n_items) & F.col("r").isNotNull()).groupBy(*by, "r").agg(
        F.min(F.struct("item_id", "pos")).alias("at"))
    return first.withColumn("ord", F.row_number().over(W.partitionBy(*by).orderBy("at")) - 1).select(*by, "r", "ord")


def stability(growth: DataFrame) -> DataFrame:
    """Share of the schema kept from one step to the next (1.0 while it only grows)."""
    return growth.withColumn("kept", F.when(F.col("until").isNull(), F.lit(None)).otherwise(F.lit(1.0)))


def merge_schemas(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union of two relation schemas ``(name, definition, head_type, tail_type, aliases, examples)``.

    The existing side wins where it has a value; alias and example lists are united in order, and differing
    slot types are reported in ``conflict``.
    """
    cols = ["definition", "head_type", "tail_type", "aliases", "examples"]
    n = new.select("name", *[F.col(c).alias(f"_{c}") for c in cols])
    rows = old.join(n, "name", "full")
    empty = F.array().cast("array<string>")
    union = lambda c: F.array_union(F.coalesce(F.col(c), empty), F.coalesce(F.col(f"_{c}"), empty))
    differs = lambda c: F.coalesce(F.col(c) != F.col(f"_{c}"), F.lit(False))
    return rows.select("name", *[F.coalesce(c, f"_{c}").alias(c) for c in cols[:3]],
                       union("aliases").alias("aliases"), union("examples").alias("examples"),
                       (differs("head_type") | differs("tail_type")).alias("conflict"))


def merge_attributes(old, new):
    """Attribute maps united, the newer value winning."""
    kept = F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k))
    return F.when(old.isNull(), new).when(new.isNull(), old).otherwise(F.map_concat(kept, new))


def schema_statistics(entity_types: DataFrame, relation_types: DataFrame) -> DataFrame:
    """Counts of entity types, relation types and attributes over ``(name, attributes MAP)`` tables."""
    size = F.coalesce(F.map_size("attributes") if hasattr(F, "map_size") else F.size("attributes"), F.lit(0))
    both = entity_types.select(F.lit("e").alias("k"), size.alias("a")).unionByName(
        relation_types.select(F.lit("r").alias("k"), size.alias("a")))
    return both.agg(F.count(F.when(F.col("k") == "e", 1)).alias("n_entity_types"),
                    F.count(F.when(F.col("k") == "r", 1)).alias("n_relation_types"),
                    F.sum(F.greatest("a", F.lit(0))).alias("n_attributes"))


def retype(schema: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace slot types from a mapping table ``(relation, head_type, tail_type)`` where it has a row."""
    m = mapping.select("relation", F.col("head_type").alias("_h"), F.col("tail_type").alias("_t"))
    return schema.join(m, "relation", "left").withColumn("head_type", F.coalesce("_h", "head_type")).withColumn(
        "tail_type", F.coalesce("_t", "tail_type")).drop("_h", "_t")


def relation_phrase_map(triples: DataFrame, embed, threshold: float = 0.9) -> DataFrame:
    """Leader clusters of open relation phrases (sorted order): ``(r, canonical)``."""
    names = order_number(triples.select("r").distinct(), ["r"], "ord").withColumn("vec", embed(F.col("r")))
    lead = leader_clusters(names, threshold, strict=True)
    return (names.join(lead, "ord").select("r", "leader")
            .join(names.select(F.col("ord").alias("leader"), F.col("r").alias("canonical")), "leader")
            .select("r", "canonical"))


def definition_coverage(open_triples: DataFrame, definitions: DataFrame) -> DataFrame:
    """Per record the share of open triples whose relation has a definition in that record."""
    d = definitions.select("item_id", "relation").distinct().select("item_id", F.col("relation").alias("r"),
                                                                    F.lit(1).alias("defined"))
    rows = open_triples.join(d, ["item_id", "r"], "left")
    return rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("n"), F.count("defined").alias("n_defined"))


def relation_definition_coverage(open_triples: DataFrame, definitions: DataFrame) -> DataFrame:
    d = definitions.select("item_id", "relation").distinct().select("item_id", F.col("relation").alias("r"),
                                                                    F.lit(1).alias("defined"))
    rows = open_triples.join(d, ["item_id", "r"], "left")
    return rows.groupBy("r").agg(F.count(F.lit(1)).alias("n"), (F.count("defined") / F.count(F.lit(1))).alias("coverage"))


def identity_rate(decided: DataFrame, by=()) -> DataFrame:
    """Share of triples whose relation kept its open name, overall and where no definition existed.

    ``decided(by…, r, pred, defined)``.
    """
    kept = F.coalesce(F.col("pred") == F.col("r"), F.lit(False))
    missing = ~F.col("defined")
    s = decided.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(kept, 1)).alias("k"),
                                 F.count(F.when(missing, 1)).alias("nm"), F.count(F.when(missing & kept, 1)).alias("km"))
    return s.select(*by, F.col("n").alias("n_triples"), ratio("k", "n").alias("identity_all"),
                    ratio("km", "nm").alias("identity_missing_definition"))


def name_entropy(decided: DataFrame, by=()) -> DataFrame:
    """Natural-log entropy of the open names behind each canonical name."""
    by = list(by)
    c = decided.filter("pred is not null").groupBy(*by, "pred", "r").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    return c.groupBy(*by, "pred").agg(n.alias("n"), (F.log(n) - F.sum(F.col("n") * F.log("n")) / n).alias("entropy"))
