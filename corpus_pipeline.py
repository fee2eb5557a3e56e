"""A training corpus from ``documents``: toxic texts go, near duplicates keep one, repeated passages are cut, sources
are mixed to their weights, and what remains is encoded.

Each stage takes what its predecessor kept, as a table written in between. All but the last return the columns of
``documents``. SQL cannot express the stages; their operators are tested one by one against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm import bpe, mixing, near_duplicates, substrings, toxicity
from graphloom.llm.common import shared_path, text_key
from graphloom.llm.queries import tokenizer_path
from graphloom.session import ship

#: Similarity from which two documents of the corpus are copies; ``op3_near_duplicates`` has its own.
NEAR_PERCENT = 80
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it is fitted on the labelled rows of ``docs``."""
    net = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs.select(*COLUMNS), net)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one of the smallest id. Of rows repeating an id, all stay or go."""
    gone = near_duplicates.near_duplicates(docs, percent=NEAR_PERCENT).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated windows leave the text; a text that loses none stays as it is."""
    return substrings.replace_texts(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mixing.mix(docs).filter("copies > 0").groupBy("doc_id", "key").agg(F.sum("copies").cast("int").alias("copies"))
    key = text_key(F.col("text"))
    rows = docs.select(*COLUMNS).withColumn("key", key).dropDuplicates(["doc_id", "key"])
    same = rows["doc_id"].eqNullSafe(taken["doc_id"]) & (rows["key"] == taken["key"])
    return rows.join(taken, same).select(*[rows[c] for c in COLUMNS], F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).drop("copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, tokenizer_path())


def _shipped(stage):
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(ship(spark), docs, sf_dir)

    return call


STAGES = [("toxicity", _shipped(remove_toxic)), ("near_duplicates", _shipped(drop_near_duplicates)), ("substrings", _shipped(cut_repeats)),
          ("mixing", _shipped(mix_sources)), ("bpe", _shipped(encode))]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the table between two stages lies in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = shared_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
