"""Partition agreement between predicted and reference labels, from one contingency table.

Mentions are reduced to (case, pred, gold) counts before anything else, so every score below works on a
table of label pairs, independent of the number of mentions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from graphloom.session import cut_lineage, f1, ratio

# Terms of the expected mutual information computed at once, and the log of a chance that is left out.
EMI_CHUNK, NEGLIGIBLE = 4096, -80.0


def contingency(mentions: DataFrame, by=("case_id",)) -> DataFrame:
    """``(by…, pred, gold, o)`` with the row, column and total sums ``np``, ``ng``, ``n``."""
    by = list(by)
    # every score reads the cells more than once; a row per pair of labels is written, the mentions are paired once
    cells = cut_lineage(mentions.groupBy(*by, "pred", "gold").agg(F.count(F.lit(1)).alias("o")))
    return (cells.withColumn("np", F.sum("o").over(W.partitionBy(*by, "pred")))
            .withColumn("ng", F.sum("o").over(W.partitionBy(*by, "gold")))
            .withColumn("n", F.sum("o").over(W.partitionBy(*by))))


def _pairs(c):
    return (F.col(c) * (F.col(c) - 1) / 2).cast("double")


def pair_counts(cells: DataFrame, by=("case_id",)) -> DataFrame:
    """Pairs of mentions together in prediction, in reference, and in both; plus cluster counts."""
    by = list(by)
    return cells.groupBy(*by).agg(
        F.max("n").alias("n_mentions"), F.count_distinct("pred").alias("n_pred_clusters"),
        F.count_distinct("gold").alias("n_gold_clusters"),
        F.sum(_pairs("o")).alias("both"),
        F.sum(_pairs("np") * F.col("o") / F.col("np")).alias("same_pred"),
        F.sum(_pairs("ng") * F.col("o") / F.col("ng")).alias("same_gold"),
    )


def pairwise(cells: DataFrame, by=("case_id",)) -> DataFrame:
    rows = pair_counts(cells, by).withColumn("pairwise_p", ratio("both", "same_pred")).withColumn(
        "pairwise_r", ratio("both", "same_gold"))
    return rows.withColumn("pairwise_f1", f1("pairwise_p", "pairwise_r"))


def bcubed(cells: DataFrame, by=("case_id",)) -> DataFrame:
    sq = (F.col("o") * F.col("o")).cast("double")
    rows = cells.groupBy(*by).agg(
        (F.sum(sq / F.col("np")) / F.max("n")).alias("bcubed_p"),
        (F.sum(sq / F.col("ng")) / F.max("n")).alias("bcubed_r"))
    return rows.withColumn("bcubed_f1", f1("bcubed_p", "bcubed_r"))


def purity(cells: DataFrame, by=("case_id",)) -> DataFrame:
    """Macro (mean best share per cluster) and micro (best overlap mass) precision, recall and F1."""
    by = list(by)
    side_p = cells.groupBy(*by, "pred").agg(F.max("o").alias("best"), F.max("np").alias("s"), F.max("n").alias("n"))
    side_g = cells.groupBy(*by, "gold").agg(F.max("o").alias("best"), F.max("ng").alias("s"), F.max("n").alias("n"))

    def side(df, x):
        return df.groupBy(*by).agg(F.avg(F.col("best") / F.col("s")).alias(f"macro_{x}"),
                                   (F.sum("best") / F.max("n")).alias(f"micro_{x}"))

    rows = side(side_p, "p").join(side(side_g, "r"), by)
    return rows.withColumn("macro_f1", f1("macro_p", "macro_r")).withColumn("micro_f1", f1("micro_p", "micro_r"))


def information(cells: DataFrame, by=("case_id",)) -> DataFrame:
    """ARI, Fowlkes-Mallows, mutual information, homogeneity, completeness, V-measure and NMI."""
    by = list(by)
    o, np_, ng, n = (F.col(c).cast("double") for c in ("o", "np", "ng", "n"))
    base = cells.groupBy(*by).agg(
        F.max("n").cast("double").alias("n"),
        F.sum(o / n * F.log(n * o / (np_ * ng))).alias("mi"),
        (-F.sum(o / n * F.log(np_ / n))).alias("h_pred"), (-F.sum(o / n * F.log(ng / n))).alias("h_gold"))
    pc = pair_counts(cells, by).select(*by, "both", "same_pred", "same_gold")
    rows = base.join(pc, by)
    all_pairs = F.col("n") * (F.col("n") - 1) / 2
    expected = F.col("same_pred") * F.col("same_gold") / all_pairs
    ceiling = (F.col("same_pred") + F.col("same_gold")) / 2
    rows = (rows
            .withColumn("ari", F.when((all_pairs == 0) | (ceiling == expected), F.lit(1.0)).otherwise(
                (F.col("both") - expected) / (ceiling - expected)))
            .withColumn("fmi", F.when(F.col("both") == 0, F.lit(0.0)).otherwise(
                F.col("both") / F.sqrt(F.col("same_pred") * F.col("same_gold"))))
            .withColumn("homogeneity", ratio("mi", "h_gold", 1.0))
            .withColumn("completeness", ratio("mi", "h_pred", 1.0)))
    return (rows.withColumn("v_measure", f1("homogeneity", "completeness"))
            .withColumn("nmi", F.col("v_measure"))
            .select(*by, "ari", "nmi", "v_measure", "homogeneity", "completeness", "fmi", "mi", "h_pred", "h_gold"))


def adjusted_mutual_information(cells: DataFrame, by=("case_id",)) -> DataFrame:
    """AMI with the arithmetic-mean normaliser.

    The expected mutual information is a sum over pairs of cluster sizes. Sizes that occur many times are
    grouped first, and each (size, size) pair is one row, so the sum runs in parallel over the label table.
    """
    by = list(by)
    a = cells.select(*by, "pred", "np", "n").distinct().groupBy(*by, "n", "np").agg(F.count(F.lit(1)).alias("ca"))
    b = cells.select(*by, "gold", "ng").distinct().groupBy(*by, "ng").agg(F.count(F.lit(1)).alias("cb"))

    @F.pandas_udf("double")
    def term(n: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_expected_term(int(i), int(j), int(k)) for i, j, k in zip(n, x, y)])

    emi = a.join(b, by).withColumn("e", term("n", "np", "ng") * F.col("ca") * F.col("cb")).groupBy(*by).agg(
        F.sum("e").alias("emi"))
    rows = information(cells, by).join(emi, by)
    mean_h = (F.col("h_pred") + F.col("h_gold")) / 2
    den = mean_h - F.col("emi")
    return rows.withColumn("ami", F.when(mean_h == 0, F.lit(1.0)).otherwise(
        (F.col("mi") - F.col("emi")) / F.when(F.abs(den) < 1e-15, F.lit(1e-15)).otherwise(den))).select(*by, "ami")


def _expected_term(n, x, y, chunk=EMI_CHUNK):
    """Expected mutual information of two clusters of ``x`` and ``y`` out of ``n`` mentions, over their overlap ``c``.

    The chance of ``c`` is followed from its most likely value to both sides by ratios, ``chunk`` values at a time, until the rest is
    negligible; the chances are then scaled to one. So memory does not follow the clusters' sizes, and no factorial is needed.
    """
    lo, hi = max(0, x + y - n), min(x, y)
    mode = min(max((x + 1) * (y + 1) // (n + 2), lo), hi)
    weight, total = 1.0, _gain(float(mode), n, x, y)
    for side, end in ((1, hi), (-1, lo)):
        at, level = mode, 0.0
        while at != end and level > NEGLIGIBLE:
            c = np.arange(1, min(chunk, abs(end - at)) + 1, dtype=np.float64) * side + at
            low = np.minimum(c, c - side)  # each ratio is between low and low + 1
            ratio_ = np.log(x - low) + np.log(y - low) - np.log(low + 1) - np.log(n - x - y + low + 1)
            log_p = level + side * np.cumsum(ratio_)
            p = np.exp(log_p)
            weight += p.sum()
            total += float((p * _gain(c, n, x, y)).sum())
            at, level = int(c[-1]), float(log_p[-1])
    return total / weight


def _gain(c, n, x, y):
    return np.where(c > 0, c / n * np.log(np.maximum(c, 1) * n / (float(x) * y)), 0.0)


def all_scores(mentions: DataFrame, by=("case_id",)) -> DataFrame:
    """Every partition score in one row per case, from one shared contingency table."""
    by = list(by)
    cells = contingency(mentions, by)
    info = information(cells, by).drop("mi", "h_pred", "h_gold")
    return (pairwise(cells, by).drop("both", "same_pred", "same_gold").join(bcubed(cells, by), by)
            .join(purity(cells, by), by).join(info, by).join(adjusted_mutual_information(cells, by), by))
