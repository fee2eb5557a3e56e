"""Corpus readers: benchmark XML, linearised triplets, question-answer corpora, chunk notes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from graphloom.functions.text import clean_text
from graphloom.operators.parsing import linearised_triples

ENTRY_SCHEMA = ("_eid string, modifiedtripleset struct<mtriple:array<string>>, "
                "lex array<struct<_VALUE:string,_comment:string>>")
HOTPOT_SCHEMA = ("_id string, question string, answer string, supporting_facts array<array<string>>, "
                 "context array<struct<title:string,sents:array<string>>>")
MUSIQUE_SCHEMA = ("id string, question string, answer string, paragraphs array<struct<idx:bigint,title:string,"
                  "paragraph_text:string,is_supporting:boolean,seq:bigint>>")


def read_benchmark_xml(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a benchmark XML file: ``(eid, text, triples)``.

    The text is the first ``good`` wording, else the first non-empty one; triples are split at the bar.
    """
    rows = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY_SCHEMA).load(path)
    filled = F.filter("lex", lambda x: F.trim(F.coalesce(x["_VALUE"], F.lit(""))) != "")
    good = F.filter(filled, lambda x: x["_comment"] == "good")
    text = F.coalesce(F.try_element_at(good, F.lit(1))["_VALUE"], F.try_element_at(filled, F.lit(1))["_VALUE"])
    parts = F.transform("modifiedtripleset.mtriple", lambda m: F.transform(F.split(m, r"\|"), lambda p: F.trim(p)))
    rows = rows.select(F.col("_eid").alias("eid"), clean_text(text).alias("text"),
                       F.filter(parts, lambda p: F.size(p) == 3).alias("triples"))
    return rows.filter("text is not null and size(triples) > 0")


def read_linearised(df: DataFrame, text: str = "context", triplets: str = "triplets") -> DataFrame:
    """Marker-linearised corpus rows as ``(text, triples)``."""
    return df.select(clean_text(F.coalesce(F.col(text), F.lit(""))).alias("text"),
                     linearised_triples(F.col(triplets)).alias("triples")).filter("text <> '' and size(triples) > 0")


def read_structured(df: DataFrame, triples: str = "triples") -> DataFrame:
    """Structured triplets whose nodes are objects with a ``surfaceform``: adds ``rows ARRAY<ARRAY<STRING>>``."""
    node = lambda n: F.coalesce(F.get_json_object(n, "$.surfaceform"), n)
    return df.withColumn("rows", F.transform(triples, lambda x: F.array(
        F.trim(node(x["subject"])), F.trim(node(x["predicate"])), F.trim(node(x["object"])))))


def read_hotpot(spark: SparkSession, path: str) -> DataFrame:
    """Question file (one JSON array) as chunks ``(q_id, para_index, title, text, is_supporting)``."""
    raw = spark.read.text(path, wholetext=True)
    kind = ("array<struct<_id:string,question:string,answer:string,supporting_facts:array<array<string>>,"
            "context:array<array<string>>>>")
    q = raw.select(F.explode(F.from_json("value", kind)).alias("q")).select("q.*")
    return _hotpot_chunks(q)


def _hotpot_chunks(q: DataFrame) -> DataFrame:
    gold = F.transform("supporting_facts", lambda f: f[0])
    rows = q.select(F.col("_id").alias("q_id"), gold.alias("gold"), F.posexplode("context").alias("para_index", "c"))
    title = clean_text(F.col("c")[0])
    body = clean_text(F.array_join(F.coalesce(F.from_json(F.col("c")[1], "array<string>"), F.array(F.col("c")[1])), ""))
    return rows.select("q_id", "para_index", title.alias("title"), F.when(body == "", title).otherwise(
        F.concat(title, F.lit(". "), body)).alias("text"), F.array_contains("gold", title).alias("is_supporting"))


def read_musique(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines questions as chunks with the source's own ``idx`` and ``seq``."""
    q = spark.read.schema(MUSIQUE_SCHEMA).json(path)
    rows = q.select(F.col("id").alias("q_id"), F.posexplode("paragraphs").alias("para_index", "p"))
    title, body = clean_text(F.col("p.title")), clean_text(F.col("p.paragraph_text"))
    return rows.select("q_id", "para_index", title.alias("title"), F.when(body == "", title).otherwise(
        F.concat(title, F.lit(". "), body)).alias("text"), F.coalesce("p.is_supporting", F.lit(False)).alias("is_supporting"),
        F.col("p.idx").alias("idx"), F.col("p.seq").alias("seq"))


def dedup_chunks(chunks: DataFrame, keys=("title", "text")) -> DataFrame:
    """First chunk of each key by question and paragraph."""
    keys = list(keys)
    first = chunks.groupBy(*keys).agg(F.min(F.struct("q_id", "para_index")).alias("_f"))
    return chunks.join(first.select(*keys, F.col("_f.q_id").alias("q_id"), F.col("_f.para_index").alias("para_index")),
                       [*keys, "q_id", "para_index"], "left_semi")


def chunk_notes(chunks: DataFrame) -> DataFrame:
    """Running number of each chunk inside its title: ``chunks(title, text, order)`` -> ``(title, seq, text)``."""
    w = W.partitionBy("title").orderBy("order")
    seq = (F.row_number().over(w) - 1).cast("bigint")
    return chunks.select("title", seq.alias("seq"), clean_text(F.col("text")).alias("text"))


def check_alignment(chunks: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows where the corpus file and the chunk file disagree (must be empty before notes are written)."""
    a = chunks.select("ord", clean_text(F.col("text")).alias("a"))
    b = lines.select("ord", clean_text(F.col("text")).alias("b"))
    return a.join(b, "ord", "full").filter(~F.col("a").eqNullSafe(F.col("b")))
