"""Confusion tables and the scores that follow from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """y_true, y_pred, n for every pair of labels that occur on either side, zeros included."""
    counts = df.groupBy(F.col(truth).alias("y_true"), F.col(predicted).alias("y_pred")).agg(F.count("*").alias("n"))
    labels = counts.select(F.col("y_true").alias("y")).union(counts.select("y_pred")).distinct()
    grid = labels.select(F.col("y").alias("y_true")).crossJoin(labels.select(F.col("y").alias("y_pred")))
    return grid.join(counts, ["y_true", "y_pred"], "left").fillna(0, ["n"])


def class_report(table: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support of a confusion table; 0 where a ratio has no cases."""
    hit = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    true = table.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"), hit.alias("tp"))
    pred = table.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted")
    return true.join(pred, "label").select("label", ratio(tp, predicted).alias("precision"), ratio(tp, support).alias("recall"), ratio(2 * tp, support + predicted).alias("f1"), support)


def scores(table: DataFrame) -> DataFrame:
    """accuracy (which is micro F1 for one label a row), macro and weighted precision, recall and F1: one row."""
    report = class_report(table)
    total = F.sum("support")
    weighted = [(F.sum(F.col(m) * F.col("support")) / total).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")]
    macro = [F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    return report.agg((F.sum(F.col("recall") * F.col("support")) / total).alias("accuracy"), *macro, *weighted, total.alias("support"))


def target_first(table: DataFrame, target: object) -> DataFrame:
    """The confusion table with row and column ranks that put one label first."""
    rank = lambda c: F.when(F.col(c) == target, 0).otherwise(1)
    order = lambda c: F.dense_rank().over(Window.orderBy(rank(c), F.col(c))) - 1
    return table.select("*", order("y_true").alias("row"), order("y_pred").alias("column"))


def targets_first(tables: DataFrame, by: list[str]) -> DataFrame:
    """Confusion tables (by, y_true, y_pred, n) once for each of their labels as `target`, with row and column numbers that put it first and leave the others in order.
    A table's labels are numbered once, so the work is the tables' size times their labels."""
    labels = tables.select(*by, F.col("y_true").alias("y")).union(tables.select(*by, "y_pred")).distinct()
    ranked = labels.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("y")) - 1)
    as_ = lambda name, at: ranked.select(*by, F.col("y").alias(name), F.col("i").alias(at))
    rows = tables.join(as_("y_true", "_t"), [*by, "y_true"]).join(as_("y_pred", "_p"), [*by, "y_pred"]).join(as_("target", "_g"), by)
    place = lambda c: F.when(F.col(c) == F.col("_g"), 0).when(F.col(c) < F.col("_g"), F.col(c) + 1).otherwise(F.col(c))
    return rows.select(*by, "target", "y_true", "y_pred", "n", place("_t").alias("row"), place("_p").alias("column"))


def weight_profile(coefficients: DataFrame) -> DataFrame:
    """k, weight from (feature_idx, k, weight): mean absolute weight a frequency, scaled to [0, 1]; flat profiles are 0."""
    per_k = coefficients.groupBy("k").agg(F.avg(F.abs("weight")).alias("w"))
    bounds = per_k.agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("w") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.0))
    return per_k.crossJoin(F.broadcast(bounds)).select("k", scaled.alias("weight"))


def weight_summary(coefficients: DataFrame) -> DataFrame:
    return coefficients.agg(F.avg("weight").alias("mean"), F.stddev_pop("weight").alias("std"), F.max("weight").alias("max"), F.min("weight").alias("min"))


def across_runs(runs: DataFrame, by: list[str], value: str) -> DataFrame:
    return runs.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("n_runs"))


def batch_mean(df: DataFrame, batch: str, value: str) -> DataFrame:
    """The unweighted mean of the batches' means: a short last batch counts as much as a full one."""
    return df.groupBy(batch).agg(F.avg(value).alias("_m")).agg(F.avg("_m").alias(value))
