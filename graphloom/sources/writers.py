"""Sinks: graph text and JSON, schema dumps, decision files, metric sheets, event logs.

All writes go through Spark's commit protocol, so a reader never sees half a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.operators.parsing import python_list_text


def triple_lists(triples: DataFrame, items: DataFrame, by=()) -> DataFrame:
    """One ordered triple list per record; records without triples keep an empty list."""
    by = list(by)
    rows = F.array_sort(F.collect_list(F.struct("pos", F.array("h", "r", "t").alias("x"))))
    lists = triples.groupBy(*by, "item_id").agg(F.transform(rows, lambda s: s["x"]).alias("triples"))
    base = items.select("item_id")
    if by:
        cases = triples.select(*by).distinct().withColumn("_", F.lit(1))
        base = base.withColumn("_", F.lit(1)).join(cases, "_").drop("_")
    return base.join(lists, [*by, "item_id"], "left").withColumn(
        "triples", F.coalesce("triples", F.array().cast("array<array<string>>")))


def write_graph_lines(triples: DataFrame, items: DataFrame, path: str) -> None:
    """Graph text in record order: one list per line, empty lists kept, files in name order."""
    lines = triple_lists(triples, items).withColumn("value", python_list_text(F.col("triples")))
    lines.repartitionByRange("item_id").sortWithinPartitions("item_id").select("value").write.mode("overwrite").text(path)


def write_graph(nodes: DataFrame, triples: DataFrame, path: str, by=()) -> None:
    """Graph as two JSON tables (entities, relations), partitioned by case."""
    by = list(by)
    ents = nodes.withColumn("attributes", F.create_map().cast("map<string,string>"))
    rels = triples.select(*by, F.col("h").alias("head"), F.col("r").alias("relation"), F.col("t").alias("tail"),
                          F.create_map().cast("map<string,string>").alias("attributes"))
    for name, df in (("entities", ents), ("relations", rels)):
        df.write.mode("overwrite").partitionBy(*by).json(f"{path}/{name}")


def write_schema(schema: DataFrame, path: str, by=("case_id",)) -> None:
    schema.write.mode("overwrite").partitionBy(*by).json(path)


def write_decisions(decided: DataFrame, path: str, by=("case_id",)) -> None:
    """Decisions per record with prompts and raw answers removed, one folder per case."""
    row = F.struct("pos", F.array("h", "r", "t").alias("input"), "pred", F.col("names").alias("top_k"))
    per = decided.groupBy(*by, "item_id").agg(F.array_sort(F.collect_list(row)).alias("triplets"))
    per.write.mode("overwrite").partitionBy(*by).json(path)


def write_stages(items: DataFrame, stages: dict, path: str) -> None:
    """All stage results of a record side by side (outer-joined by record)."""
    out = items
    for name, df in stages.items():
        out = out.join(df.withColumnRenamed("value", name), "item_id", "left")
    out.write.mode("overwrite").json(path)


def write_metrics(df: DataFrame, path: str, fmt: str = "json", decimals: int = 4) -> None:
    """A metric table, rounded at the sink only."""
    cols = [F.round(c, decimals).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    w = df.select(cols).write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.json(path))


def append_events(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def comparison_sheet(runs: DataFrame, row: str, column: str, value: str, columns=None) -> DataFrame:
    """Pivoted sheet with a ``<column>_best`` flag per column group."""
    wide = runs.groupBy(row).pivot(column, columns).agg(F.first(value))
    names = [c for c in wide.columns if c != row]
    for c in names:  # one row per run configuration
        wide = wide.withColumn(f"{c}_best", F.col(c) == F.max(c).over(W.partitionBy(F.lit(1))))
    return wide


def manifest(paths: DataFrame) -> DataFrame:
    """Release manifest: files, rows and bytes per table from ``(table, rows, bytes)``."""
    return paths.groupBy("table").agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"))
