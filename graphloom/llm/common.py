"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from graphloom.session import cut_lineage, ensure_checkpoint_dir

BITMAP_BITS = 1 << 26


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there; a lost executor costs no earlier step."""
    return cut_lineage(df)


def words_of(text: Column) -> Column:
    """The runs of characters other than space and U+0009 to U+000D; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    """Number of words without building them: a word starts where a separator or the beginning precedes it."""
    return F.size(words_of(text)).cast("long")


def text_key(text: Column) -> Column:
    """64 bits of a text; together with ``doc_id`` they name a row, so that rows repeating an id stay apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sha_hex(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(text, F.lit("")), "UTF-8"), 256)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and the executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """Bits of hashed ids, about sixteen an id but ``BITMAP_BITS`` (8 MiB) at most; built by aggregation.

    It preselects rows during a scan. A false hit has to be harmless to the caller; there are no false misses.
    """
    bits, count = 1 << 16, ids.count()
    while bits < min(16 * count, BITMAP_BITS):
        bits <<= 1
    spot = F.xxhash64(column)
    rows = ids.select((F.pmod(spot, F.lit(bits)) / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 64L) as int))").alias("b")) \
        .groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out


def in_bitmap(words: np.ndarray, spot: np.ndarray) -> np.ndarray:
    """Whether the ids of these 64-bit hashes may be in the bitmap."""
    at = spot % (len(words) * 64)
    return (words[at // 64] >> (spot % 64)) & 1 == 1


def positions(rows: DataFrame, group: str, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` sorted by ``group`` and ``order`` and written with a number ``at``; and per range and group ``(part, group, first,
    before, n)``: the number of the first row there, how many rows of the group are in earlier ranges, and in all.
    """
    keys = [group, *order]
    placed = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33).cast("int").alias("part")
    counts = placed.groupBy(part, group).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("here"))
    all_of = Window.partitionBy(group)
    earlier = all_of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", group, "first", F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("before"), F.sum("here").over(all_of).alias("n"))
    return placed.withColumn("part", F.shiftright("at", 33).cast("int")), cut(counts)


def numbered(rows: DataFrame, group: str, order: list[str], trees: DataFrame | None = None) -> DataFrame:
    """``rows`` with their position ``pos`` in their group in ``order``, and ``n``, its size; with ``tree`` of ``trees(group, tree)`` if given.

    Rows are range-partitioned and sorted, and counts per range and group turn places into positions: a group may have any size. ``rows``
    should be written already, as the ranges take a pass of their own; its last order column should tell all rows apart.
    """
    placed, counts = positions(rows, group, order)
    counts = counts.select(F.col("part").alias("p"), F.col(group).alias("g"), (F.col("before") - F.col("first")).alias("shift"), "n")
    if trees is not None:
        counts = counts.join(trees.select(F.col(group).alias("h"), "tree"), F.col("g").eqNullSafe(F.col("h"))).drop("h")
    joined = placed.join(counts, (F.col("part") == F.col("p")) & F.col(group).eqNullSafe(F.col("g")))
    return joined.withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "p", "g", "shift")
