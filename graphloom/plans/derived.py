"""Knowledge-graph views derived from the star-schema tables.

One order is one record. Reference triples state its facts; predicted triples are the same facts seen
through three deterministic noise patterns (surface variants, renamed relations, misses, swaps). All views
are plain expressions over the whole tables, so their size grows with the data.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from graphloom.functions.vectors import dot, l2_normalize
from graphloom.session import broadcast_if_small

RELATIONS = ["containsPart", "hasPriority", "locatedIn", "orderedOn", "partOf", "placedOrder", "totalPrice"]
SLOT_TYPES = {
    "placedOrder": ("Customer", "Order"), "locatedIn": ("Customer", "Nation"), "partOf": ("Nation", "Region"),
    "hasPriority": ("Order", "Priority"), "orderedOn": ("Order", "Date"), "totalPrice": ("Order", "Number"),
    "containsPart": ("Order", "Part"),
}
CASE_IDS = (1, 2, 3)


class Tables:
    """Lazy access to one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._read: dict = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def view(self, build, *args) -> DataFrame:
        """Build a derived view once per folder, so that repeated uses share one plan object."""
        key = (build.__name__, args)
        if key not in self._read:
            self._read[key] = build(self, *args)
        return self._read[key]

    def spread(self, name: str, key: str) -> DataFrame:
        """The table over at least as many partitions as there are cores.

        A table of many files is left alone; a single small file is one scan task, which would run every
        later per-row expression on one core.
        """
        df = self[name]
        cores = self.spark.sparkContext.defaultParallelism
        return df if len(df.inputFiles()) >= cores else df.repartition(cores, key)


def shared(build):
    """Memoise a view builder per :class:`Tables`."""
    @functools.wraps(build)
    def cached(t, *args):
        return t.view(build, *args)

    return cached


@shared
def order_facts(t: Tables) -> DataFrame:
    """Orders with customer, nation and region names (the small dimensions broadcast by size), partitioned by record.

    What is derived per record keeps this partitioning, so that it meets :func:`kg_gold` and the views of it without a shuffle.
    The two names travel as one array: views that need one of them only then read the same shuffle.
    """
    geo = broadcast_if_small(t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", "n_name", "r_name"))
    cust = t["customer"].select("c_custkey", "c_name", "c_nationkey")
    rows = t["orders"].join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("item_id"), F.array("c_name", "o_orderpriority").alias("_names"), "c_nationkey", "o_orderdate", "o_totalprice")
    return rows.repartition("item_id").join(geo, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "item_id", F.col("_names")[0].alias("c_name"), "n_name", "r_name", F.col("_names")[1].alias("o_orderpriority"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderdate",
        F.format_string("%.2f", "o_totalprice").alias("price"), "o_totalprice",
        F.concat(F.lit("Order_"), F.col("item_id").cast("string")).alias("order_name"))


def numbered_lines(t: Tables, *part: str, extra: tuple = ()) -> DataFrame:
    """Line items with ``k``, their number in the order, and columns of their part; partitioned by ``l_orderkey``.

    Parts come first, in one row per key, as a join after the numbering would shuffle the lines once more; a line without a part has its number too.
    """
    parts = t["part"].groupBy("p_partkey").agg(F.collect_list(F.struct(*part)).alias("_parts"))
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    lines = t["lineitem"].select("l_orderkey", *order, *extra).join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
    w = W.partitionBy("l_orderkey").orderBy(*order)
    return lines.withColumn("k", F.row_number().over(w)).select("l_orderkey", "l_partkey", "k", *extra, F.inline("_parts"))


@shared
def kg_text(t: Tables) -> DataFrame:
    """One sentence per record: ``(item_id, text)``; some omit the region, some add a pronoun."""
    o = order_facts(t)
    region = F.when(F.col("item_id") % 4 == 0, F.lit("")).otherwise(F.concat(F.lit(" in "), F.col("r_name")))
    tail = F.when(F.col("item_id") % 6 == 0, F.lit(" It was shipped.")).otherwise(F.lit(""))
    return o.select("item_id", F.concat(
        F.replace("c_name", F.lit("#"), F.lit("")), F.lit(" from "), F.col("n_name"), region,
        F.lit(" placed "), F.col("order_name"), F.lit(" on "), F.date_format("o_orderdate", "MMMM d, yyyy"),
        F.lit(" for "), F.format_number("o_totalprice", 2), F.lit("."), tail).alias("text"))


@shared
def kg_gold(t: Tables) -> DataFrame:
    """Reference triples ``(item_id, pos, h, r, t)``, partitioned by record."""
    o = order_facts(t)

    def fact(pos, h, r, tail):
        return F.struct(F.lit(pos).cast("bigint").alias("pos"), F.col(h).alias("h"), F.lit(r).alias("r"),
                        F.col(tail).alias("t"))

    head = o.select("item_id", F.inline(F.array(
        fact(0, "c_name", "placedOrder", "order_name"), fact(1, "c_name", "locatedIn", "n_name"),
        fact(2, "n_name", "partOf", "r_name"), fact(3, "order_name", "hasPriority", "o_orderpriority"),
        fact(4, "order_name", "orderedOn", "day"), fact(5, "order_name", "totalPrice", "price"))))
    lines = numbered_lines(t, "p_name").select(
        F.col("l_orderkey").alias("item_id"), (F.col("k") + 5).cast("bigint").alias("pos"),
        F.concat(F.lit("Order_"), F.col("l_orderkey").cast("string")).alias("h"),
        F.lit("containsPart").alias("r"), F.col("p_name").alias("t"))
    lines = lines.filter("pos > 5")  # true of all: with it every view of the triples numbers the lines, over one and the same shuffle
    return head.unionByName(lines)


@shared
def kg_pred(t: Tables, cases=CASE_IDS) -> DataFrame:
    """Predicted triples ``(case_id, item_id, pos, h, r, t)`` under one noise pattern per case."""
    g = kg_gold(t).withColumn("case_id", F.explode(F.array(*[F.lit(c).cast("bigint") for c in cases])))
    k = (F.col("item_id") * 7 + F.col("pos") * 3 + F.col("case_id")) % 10
    renamed = (F.when(F.col("r") == "locatedIn", "situatedIn").when(F.col("r") == "partOf", "locatedIn")
               .otherwise(F.concat(F.col("r"), F.lit("Of"))))
    # pattern 7: the extractor missed the triple (a plain comparison would move a filter on keys below the shuffle that the reference shares)
    g = g.withColumn("k", k).filter(F.coalesce(F.col("k") != 7, F.lit(False)))
    return g.select(
        "case_id", "item_id", "pos",
        F.when(F.col("k") == 5, F.replace(F.upper("h"), F.lit(" "), F.lit("_")))
        .when(F.col("k") == 8, F.col("t")).otherwise(F.col("h")).alias("h"),
        F.when(F.col("k") == 6, renamed).otherwise(F.col("r")).alias("r"),
        F.when(F.col("k") == 8, F.col("h")).when(F.col("k") == 9, F.concat(F.col("t"), F.lit(" unit")))
        .otherwise(F.col("t")).alias("t"))


@shared
def kg_trace(t: Tables) -> DataFrame:
    """Predicted triples with a ranked candidate list ``top_k`` and the final relation ``pred``."""
    rels = F.array(*[F.lit(r) for r in RELATIONS])
    n = len(RELATIONS)
    shift = (F.col("item_id") + F.col("pos") + F.col("case_id")) % n
    rotated = F.concat(F.slice(rels, shift.cast("int") + 1, F.lit(n)), F.slice(rels, F.lit(1), shift.cast("int")))
    shown = F.when(F.col("item_id") % 2 == 1, F.slice(rotated, 1, 4)).otherwise(rotated)
    return kg_pred(t).withColumn("top_k", shown).withColumn("pred", F.col("r"))


def slot_types(spark: SparkSession) -> DataFrame:
    """The reference schema: ``(ord, relation, head_type, tail_type, definition)`` (a fixed small table)."""
    rows = [(i, r, *SLOT_TYPES[r], f"the {SLOT_TYPES[r][0]} has the {SLOT_TYPES[r][1]} by {r}")
            for i, r in enumerate(SLOT_TYPES)]
    return spark.createDataFrame(rows, "ord bigint, relation string, head_type string, tail_type string, "
                                       "definition string")


@shared
def sd_entities(t: Tables) -> DataFrame:
    """Entity definitions per record ``(item_id, pos, entity, coarse, fine, description)``."""
    o = order_facts(t)

    def row(pos, entity, coarse, fine, text):
        return F.struct(F.lit(pos).cast("bigint").alias("pos"), F.col(entity).alias("entity"),
                        F.lit(coarse).alias("coarse"), F.lit(fine).alias("fine"),
                        F.concat(F.col(entity), F.lit(text)).alias("description"))

    return o.select("item_id", F.inline(F.array(
        row(0, "c_name", "Agent", "Customer", " is a customer"), row(1, "order_name", "Event", "Order", " is an order"),
        row(2, "n_name", "Place", "Nation", " is a nation"), row(3, "r_name", "Place", "Region", " is a region"))))


@shared
def part_entities(t: Tables) -> DataFrame:
    """Entity definitions per record with open fine types: one per line item, ``(item_id, pos, entity, coarse, fine, description)``."""
    kind = F.col("p_size") % 3
    return numbered_lines(t, "p_partkey", "p_name", "p_size", "p_type").select(
        F.col("l_orderkey").alias("item_id"), F.col("k").cast("bigint").alias("pos"), F.concat("p_name", F.lit(" "), F.col("p_partkey").cast("string")).alias("entity"),
        F.when(kind == 0, "Good").when(kind == 1, "Tool").otherwise("").alias("coarse"), F.col("p_name").alias("fine"),
        F.concat(F.lit("made for "), F.lower("p_type"), F.lit(" use")).alias("description"))


@shared
def ec_decisions(t: Tables) -> DataFrame:
    """Entity-type decisions ``(ec_case, item_id, ord, fine, pred, members)`` with type confusions."""
    e = sd_entities(t).withColumn("ec_case", F.explode(F.array(*[F.lit(c).cast("bigint") for c in CASE_IDS])))
    merged = (F.col("ec_case") > 1) & (F.col("item_id") % 3 == 0) & (F.col("fine") == "Nation")
    lost = (F.col("ec_case") == 3) & (F.col("item_id") % 5 == 0) & (F.col("fine") == "Order")
    pred = F.when(merged, "Region").when(lost, "Event").otherwise(F.col("fine"))
    return e.select("ec_case", "item_id", F.col("pos").alias("ord"), "fine", "coarse", pred.alias("pred"),
                    F.array("entity").alias("members"))


@shared
def vectors(t: Tables) -> DataFrame:
    """All embeddings as a schema: ``(ord, name, vec, head_type, tail_type, parent)``."""
    v = F.col("vec_id")
    return t["embeddings"].select(
        v.alias("ord"), F.concat(F.lit("rel_"), v.cast("string")).alias("name"),
        F.col("embedding").cast("array<double>").alias("vec"),
        F.concat(F.lit("T"), (F.col("label") % 3).cast("string")).alias("head_type"),
        F.concat(F.lit("T"), (F.col("label") % 2).cast("string")).alias("tail_type"),
        F.when(F.col("label") % 5 == 0, F.lit("")).otherwise(
            F.concat(F.lit("P"), (F.col("label") % 2).cast("string"))).alias("parent"))


@shared
def mixed_vectors(t: Tables) -> DataFrame:
    """One query per embedding: its vector blended with its neighbour's (id xor 1) at five strengths."""
    s = vectors(t)
    eps = F.element_at(F.array(*[F.lit(x) for x in (0.1, 0.3, 0.35, 0.5, 0.9)]), (F.col("qid") % 5 + 1).cast("int"))
    other = s.select(F.col("ord").alias("other"), F.col("vec").alias("o_vec"))
    q = s.withColumn("qid", F.col("ord")).withColumn("other", F.col("ord").bitwiseXOR(F.lit(1).cast("bigint")))
    q = q.join(other, "other", "left").withColumn("eps", eps)
    blend = F.zip_with("vec", F.coalesce("o_vec", "vec"), lambda a, b: a + F.col("eps") * b)
    return q.withColumn("vec", l2_normalize(blend)).select(
        "qid", "vec", "tail_type",
        F.when(F.col("qid") % 7 == 0, F.lit("TX")).otherwise(F.col("head_type")).alias("head_type"),
        F.when(F.col("qid") % 4 == 0, F.lit("P0")).otherwise(F.col("parent")).alias("parent"))


@shared
def vector_pool(t: Tables) -> DataFrame:
    """Embeddings and their blends interleaved: ``(ord, name, vec)`` with 2 rows per embedding."""
    a = vectors(t).select((F.col("ord") * 2).alias("ord"), "vec")
    b = mixed_vectors(t).select((F.col("qid") * 2 + 1).alias("ord"), "vec")
    return a.unionByName(b).withColumn("name", F.concat(F.lit("rel_"), F.col("ord").cast("string")))


def cosine(a, b):
    return dot(a, b)


@shared
def open_relations(t: Tables) -> DataFrame:
    """Open relation phrases in corpus order: one occurrence per line item, ``(position, item_id, relation)``."""
    return numbered_lines(t, "p_name", "p_brand").select(
        (F.shiftleft(F.col("l_orderkey"), 20) + F.col("k")).alias("position"), F.col("l_orderkey").alias("item_id"),
        F.lower(F.concat("p_name", F.lit(" "), F.replace("p_brand", F.lit("Brand#"), F.lit("brand ")))).alias("relation"))
