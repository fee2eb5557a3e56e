"""Incremental canonicalization: micro-batches extend a stored schema.

The schema is the only state. Each micro-batch decides its occurrences against the schema before it plus
what the batch itself mints in order, then appends its mints. Because minting depends on first uses only,
any split of the input into batches gives the decisions of one run over everything. Batch output folders
are named by batch id and overwritten, so a replayed batch after a failure changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.operators.canonical import RELATION_THRESHOLD, canonicalize_growing

SCHEMA_DDL = "ord bigint, name string, vec array<double>, batch bigint"


def schema_before(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    """Schema minted by the batches before this one (partition pruning keeps a replay off its own attempt)."""
    try:
        rows = spark.read.schema(SCHEMA_DDL).parquet(f"{folder}/schema")
        return rows.filter(F.col("batch") < batch)
    except Exception as e:  # noqa: BLE001 - the first batch has no folder yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], SCHEMA_DDL)


def process_batch(occurrences: DataFrame, batch: int, folder: str, embed, threshold: float = RELATION_THRESHOLD,
                  k: int = 5) -> None:
    """Decide one batch of ``(position, item_id, relation, …)`` and store decisions and mints."""
    spark = occurrences.sparkSession
    before = schema_before(spark, folder, batch).select("ord", "name", "vec")
    seed = None if before.isEmpty() else before
    keys = occurrences.select("relation").distinct().withColumn("vec", embed(F.col("relation")))
    decided, schema = canonicalize_growing(occurrences, keys, seed=seed, threshold=threshold, k=k)
    fresh = schema if seed is None else schema.join(before.select("name"), "name", "left_anti")
    decided.select("position", "item_id", "relation", "pred", "is_new", "decision").write.mode("overwrite").parquet(
        f"{folder}/decisions/batch={batch}")
    fresh.select("ord", "name", "vec").write.mode("overwrite").parquet(f"{folder}/schema/batch={batch}")


def run_stream(stream: DataFrame, folder: str, embed, threshold: float = RELATION_THRESHOLD, available_now: bool = True):
    """Start the incremental job; its progress lives in ``<folder>/checkpoint``."""
    w = stream.writeStream.foreachBatch(lambda df, b: process_batch(df, b, folder, embed, threshold))
    w = w.option("checkpointLocation", f"{folder}/checkpoint")
    return (w.trigger(availableNow=True) if available_now else w).start()
