"""Registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import archives, bpe, decontaminate, fingerprints, licenses, merkle, mixing, near_duplicates, prefix_trie, substrings, topk, toxicity, url_filter
from .common import table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents"), tokenizer_path())


def op2_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, folder, "documents"))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archives.archive(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(table(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "labels")))


def op7_substrings(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.deduplicate(table(spark, folder, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, folder, "documents"))


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(table(spark, folder, "pages"))


def op11_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.encode(F.concat_ws(",", "items"), "UTF-8"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    claimed = {"text": F.when(tampered, lower).otherwise(F.col("text"))}
    return merkle.verify(merkle.manifest(table(spark, folder, "documents"), claimed))


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, folder, "conversations"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_topk, op3_near_duplicates, op4_warc, op5_license_scan, op6_toxicity, op7_substrings,
                                   op8_fingerprints, op9_mixing, op10_url_filter, op11_decontaminate,
                                   op12_merkle, op13_prefix_trie)}

_OP2 = """
WITH v AS (SELECT vec_id, min([floor(1024 * x::DOUBLE)::BIGINT FOR x IN embedding]) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x::DOUBLE)]) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

_OP7 = """
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM s),
m AS (SELECT g, min(doc_id) AS lo FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
x AS (SELECT DISTINCT g.doc_id, g.i + k.k AS i FROM g JOIN m ON g.g = m.g AND g.doc_id > m.lo, (SELECT unnest(range(0, 13)) AS k) k),
y AS (SELECT doc_id, list(i) AS gone FROM x GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string([ws[i] FOR i IN range(1, len(ws) + 1) IF gone IS NULL OR NOT list_contains(gone, i)], ' ')) AS kept_sha256
FROM w LEFT JOIN y ON y.doc_id = w.doc_id
"""

_OP11 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT item_id, least(10, len(ws)) AS size, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i, ws FROM b WHERE len(ws) > 0),
w AS (SELECT DISTINCT item_id, size, array_to_string(ws[i:i + size - 1], ' ') AS g FROM g),
sizes AS (SELECT DISTINCT size FROM w),
s AS (SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS i, ws FROM d, sizes WHERE len(ws) >= size),
m AS (SELECT s.doc_id, s.i, s.size, w.item_id FROM s JOIN w ON w.size = s.size AND w.g = array_to_string(s.ws[s.i:s.i + s.size - 1], ' ')),
h AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words,
       coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""

ORACLE = {"op2_topk": _OP2, "op5_license_scan": licenses.duckdb_sql(), "op7_substrings": _OP7, "op11_decontaminate": _OP11}
