"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source whose target is ``c`` times its words gives each document ``floor(c)`` copies and one more with probability
``c - floor(c)``. Pivotal rounding decides those extra copies: of two fractional documents one hands words of its
expected share to the other until one of them is wholly in or wholly out. Which of the two possible moves is made is
random, with odds that keep each document's chance; a move keeps the expected words of the pair, so the words of a
source change only by the rounding of the very last document.

The reduction tree: leaves are documents of one source, one size band and one prefix of a hashed id, about ``FAN`` in
a group; a group settles all but one fractional document, which goes up to the group of the next shorter prefix, then
of the wider band, then of the source. Each level shuffles a ``FAN``-th of the rows of the one below, and no level
holds more than a few ``FAN`` rows in a group, however large the source. About ``RESERVE`` documents of each source,
picked by hash, wait for the last group, where documents go from long to short: what remains open is short. Random
numbers are hashes of the documents, so reruns agree.

Defined results: a null text has size 0 and takes nothing; a null source is a source of its own, the last; rows that
repeat an id are documents of their own; without any words every target is 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import count_words, cut, text_key

WEIGHTS = (5, 2, 1)
MOST = 3
FAN_BITS = 6
RESERVE = 128
EPS = 1e-9
#: Per-source figures are broadcast up to this many sources; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 50_000

_DOC = "struct<o:bigint,h:bigint,doc_id:bigint,key:bigint,size:bigint,whole:int,w:double>"
_OUT = "struct<doc_id:bigint,key:bigint,size:bigint,copies:int>"


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, rows)`` -> with ``target``: shares by weight of all sizes, none above ``most`` times its source.

    With sources in order of cap per weight, a source is capped if its share of what the capped ones before it leave
    would reach its cap; the others share the rest by weight.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int") + 1)
    s = sizes.withColumn("weight", weight).withColumn("cap", (most * F.col("source_size")).cast("double"))
    s = s.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everyone)
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    s = s.withColumn("capped", F.col("ratio") <= F.col("level"))
    rest = total - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everyone), F.lit(0.0))
    free = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everyone)
    return s.select("source", "source_size", "rows", F.when(F.col("capped"), F.col("cap")).otherwise(
        rest * F.col("weight") / free).alias("target"))


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _settle(rows: Column) -> Column:
    """Of a group's documents in order all but one settled: ``done``, and ``c``, the one still open."""
    none = F.lit(None).cast(_DOC)

    def out(doc: Column, extra: int) -> Column:
        return F.array(F.struct(doc["doc_id"].alias("doc_id"), doc["key"].alias("key"), doc["size"].alias("size"),
                                (doc["whole"] + F.lit(extra)).cast("int").alias("copies")).cast(_OUT))

    def now(doc: Column, words: Column) -> Column:
        return F.struct(*[doc[k].alias(k) for k in ("o", "h", "doc_id", "key", "size", "whole")], words.alias("w")).cast(_DOC)

    def step(acc: Column, x: Column) -> Column:
        a = acc["c"]
        gain, loss = F.least(a["size"] - a["w"], x["w"]), F.least(a["w"], x["size"] - x["w"])
        up = _uniform(a["h"], x["h"], a["w"]) * (gain + loss) < loss
        move = F.when(up, gain).otherwise(-loss)
        wa, wx = a["w"] + move, x["w"] - move
        settled = F.when((wa <= EPS) | (wa >= a["size"] - EPS), True).otherwise(False)
        goes, words, left = F.when(settled, a).otherwise(x), F.when(settled, wa).otherwise(wx), F.when(settled, wx).otherwise(wa)
        done = F.concat(acc["done"], F.when(words > EPS, out(goes, 1)).otherwise(out(goes, 0)))
        return F.when(a.isNull(), F.struct(acc["done"].alias("done"), x.cast(_DOC).alias("c"))).otherwise(
            F.struct(done.alias("done"), now(F.when(settled, x).otherwise(a), left).alias("c")))

    start = F.struct(F.array().cast(f"array<{_OUT}>").alias("done"), none.alias("c"))
    return F.aggregate(rows, start, step)


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs(doc_id, source, text)`` -> ``(doc_id, key, source, size, source_size, target, copies, taken)``, a row a row."""
    light = cut(docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("source"),
                            text_key(F.col("text")).alias("key"), count_words(F.col("text")).alias("size")))
    goal = cut(targets(light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows")), weights, most))
    if goal.count() <= BROADCAST_SOURCES:
        goal = F.broadcast(goal)
    g = goal.withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = light.join(g, light["source"].eqNullSafe(g["of"]), "left").drop("of")
    rows = rows.withColumn("whole", F.floor(rate + EPS).cast("int")).withColumn("p", F.greatest(rate - F.col("whole"), F.lit(0.0)))
    sure = (F.col("p") < EPS) | (F.col("size") == 0)
    about = ["source", "source_size", "target"]
    settled = [rows.filter(sure).select(*about, "doc_id", "key", "size", F.col("whole").alias("copies"))]

    count = light.count()
    bits = max(0, math.ceil(math.log2(max(1, count / (1 << FAN_BITS)))))
    h = F.xxhash64("doc_id", "key")
    reserved = _uniform(h, F.lit("reserve")) * F.col("rows") < RESERVE
    open_rows = rows.filter(~sure).select(
        *about, F.floor(4 * F.log2(F.col("size"))).cast("int").alias("band"),
        (F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0)).cast("long").alias("prefix"), reserved.alias("reserved"),
        F.struct((-F.col("size")).alias("o"), h.alias("h"), "doc_id", "key", "size", "whole", (F.col("p") * F.col("size")).alias("w")).cast(_DOC).alias("doc"))
    level = open_rows.filter(~F.col("reserved")).drop("reserved")
    reserve = open_rows.filter("reserved").drop("reserved")
    steps = [("prefix", FAN_BITS)] * math.ceil(bits / FAN_BITS) + [("band", 3), ("band", 30)]
    for what, shift in [("", 0), *steps]:
        if what:
            level = level.withColumn(what, F.shiftright(what, shift) if what == "band" else F.shiftrightunsigned(what, shift))
        if shift == 30:
            level = level.unionByName(reserve.withColumns({"band": F.lit(0), "prefix": F.lit(0).cast("long")}))
        group = level.groupBy(*about, "band", "prefix").agg(F.array_sort(F.collect_list("doc")).alias("docs"))
        done = cut(group.select(*about, "band", "prefix", _settle(F.col("docs")).alias("s")))
        settled.append(done.select(*about, F.explode("s.done").alias("d")).select(*about, "d.*"))
        level = done.filter("s.c is not null").select(*about, "band", "prefix", F.col("s.c").alias("doc"))
    last = F.when(_uniform(F.col("doc.h"), F.lit("last")) * F.col("doc.size") < F.col("doc.w"), 1).otherwise(0)
    settled.append(level.select(*about, "doc.doc_id", "doc.key", "doc.size", (F.col("doc.whole") + last).cast("int").alias("copies")))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out.select("doc_id", "key", "source", "size", "source_size", "target", "copies",
                      (F.col("size") * F.col("copies")).cast("long").alias("taken"))
