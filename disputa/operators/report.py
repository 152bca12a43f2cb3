"""Summaries of comparison rows: macro means, pooled (micro) scores, curves, bands, budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from disputa.functions.graph import precision_recall


def macro_micro(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, macro_f1, totals, micro precision, recall and f1) of (keys, correct, pred_total, gold_total, f1) rows."""
    s = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("f1").alias("macro_f1"), *(F.sum(c).alias(c) for c in ("correct", "pred_total", "gold_total")))
    return s.select(*keys, "n", "macro_f1", "correct", "pred_total", "gold_total", *precision_recall(F.col("correct"), F.col("pred_total"), F.col("gold_total"), "micro_"))


def curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, threshold, f1): mean of f1 by threshold."""
    return rows.groupBy(*keys, "threshold").agg(F.avg("f1").alias("f1"))


def bands(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, band, totals, recall, precision) pooled over graphs."""
    s = rows.groupBy(*keys, "band").agg(*(F.sum(c).alias(c) for c in ("pred_total", "gold_total", "tp_pred", "tp_gold")))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return s.withColumn("recall", part("tp_gold", "gold_total")).withColumn("precision", part("tp_pred", "pred_total"))


def weighted_mean(rows: DataFrame, keys: list[str], mean: str, n: str) -> DataFrame:
    """(keys, n, mean): means weighted by their counts; 0 without any."""
    total = F.sum(n)
    return rows.groupBy(*keys).agg(total.alias("n"), F.when(total > 0, F.sum(F.col(mean) * F.col(n)) / total).otherwise(0.0).alias("mean"))


def error_budget(counts: DataFrame) -> DataFrame:
    """One row: hits, wrong types, reversed, missed and spurious relations over all graphs."""
    s = counts.agg(*(F.sum(c).cast("long").alias(c) for c in ("correct", "mistyped", "reversed", "pred_total", "gold_total")))
    matched = F.col("correct") + F.col("mistyped") + F.col("reversed")
    return s.select("correct", "mistyped", "reversed", (F.col("gold_total") - matched).alias("missed"), (F.col("pred_total") - matched).alias("spurious"))


def shares(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n, percent) of a value's distribution."""
    from pyspark.sql import Window as W

    n = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    total = F.sum("n").over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1)))
    return n.withColumn("percent", 100 * F.col("n") / total)


def common_units(rows: DataFrame, unit: str, condition: str) -> DataFrame:
    """(unit): units that every condition has."""
    need = rows.select(F.countDistinct(condition).alias("k"))
    return rows.groupBy(unit).agg(F.countDistinct(condition).alias("k")).join(need, "k", "left_semi").select(unit)
