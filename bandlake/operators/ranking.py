"""Deterministic ranks, samples, splits and heads.

Randomness is the order of md5(id || seed), the same on any engine. Ranks within large groups are counted by ranges of
that hash, so no task holds a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(id_col: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f"-{seed}")))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null equals null; the keys are those of `left`."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (left[k].eqNullSafe(renamed[f"_right_{k}"]) for k in keys))
    return left.join(renamed, same, how).drop(*(f"_right_{k}" for k in keys))


def hashed_rank(df: DataFrame, by: list[str], id_col: str, seed: int = 42) -> DataFrame:
    """df with `rank` (from 1, in hash order) and `group_size` within the groups; rows are counted by 4,096 hash ranges of each group. A null
    group is a group, and a null id an id, so every row gets its rank."""
    keyed = df.withColumn("_key", hash_order(id_col, seed)).withColumn("_range", F.substring("_key", 1, 3))
    counts = keyed.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*by, "_range", before.alias("_before"), F.sum("_n").over(group).alias("group_size"))
    ranked = keyed.withColumn("_row", F.row_number().over(Window.partitionBy(*by, "_range").orderBy("_key", id_col)))
    joined = _joined(ranked, offsets, [*by, "_range"])
    return joined.withColumn("rank", F.col("_before") + F.col("_row")).select(*df.columns, "rank", "group_size")


def stratified_split(df: DataFrame, label_col: str, id_col: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test: of each label round(test_size * n) rows, halves up."""
    ranked = hashed_rank(df, [label_col], id_col, seed)
    return ranked.withColumn("is_test", F.col("rank") <= F.floor(F.col("group_size") * test_size + 0.5)).drop("rank", "group_size")


def group_split(df: DataFrame, group_col: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """df with is_test: whole groups, ceil(test_size * number of groups) of them."""
    groups = hashed_rank(df.select(group_col).distinct().withColumn("_all", F.lit(1)), ["_all"], group_col, seed)
    test = groups.where(F.col("rank") <= F.ceil(F.round(F.col("group_size") * test_size, 9))).select(group_col, F.lit(True).alias("is_test"))
    return _joined(df, test, [group_col], "left").withColumn("is_test", F.coalesce("is_test", F.lit(False))).select(*df.columns, "is_test")


def first_share(df: DataFrame, id_col: str, share: float, seed: int = 42) -> DataFrame:
    """df with is_dev: round(n * share) rows in hash order."""
    ranked = hashed_rank(df.withColumn("_all", F.lit(1)), ["_all"], id_col, seed)
    return ranked.withColumn("is_dev", F.col("rank") <= F.floor(F.col("group_size") * share + 0.5)).drop("rank", "group_size", "_all")


def sample(df: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(hash_order(id_col, seed), id_col).limit(n)


def sample_per_group(df: DataFrame, by: list[str], id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group in hash order; Spark keeps n rows a group in each task before it shuffles."""
    w = Window.partitionBy(*by).orderBy(hash_order(id_col, seed), id_col)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def head_per_group(df: DataFrame, by: list[str], order: list[str], n: int, total: int | None = None) -> DataFrame:
    """The first n rows of each group, then the first `total` of those."""
    found = df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
    return found.orderBy(*order).limit(total) if total else found


def top_k(df: DataFrame, value: str, index: str, k: int) -> DataFrame:
    """The k largest values, larger indices first among equals."""
    return df.orderBy(F.desc(value), F.desc(index)).limit(k)


def batches(df: DataFrame, id_col: str, size: int, seed: int | None = None) -> DataFrame:
    """df with `batch`: consecutive ids (nulls first), or hash order with a seed, in batches of `size`. Ids are counted by ranges between their quantiles."""
    if seed is not None:
        ranked = hashed_rank(df.withColumn("_all", F.lit(1)), ["_all"], id_col, seed)
        return ranked.withColumn("batch", F.floor((F.col("rank") - 1) / size).cast("long")).drop("rank", "group_size", "_all")
    quantiles = df.agg(F.percentile_approx(id_col, [i / 256 for i in range(1, 256)], 4096).alias("_q"))
    part = F.when(F.col(id_col).isNull(), -1).otherwise(F.size(F.filter(F.array_distinct("_q"), lambda q: q < F.col(id_col))))
    keyed = df.crossJoin(F.broadcast(quantiles)).withColumn("_range", part).drop("_q")
    counts = keyed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = keyed.withColumn("_row", F.row_number().over(Window.partitionBy("_range").orderBy(id_col)))
    joined = ranked.join(counts.select("_range", before.alias("_before")), "_range")
    return joined.withColumn("batch", F.floor((F.col("_before") + F.col("_row") - 1) / size).cast("long")).select(*df.columns, "batch")


def cumulative_best(df: DataFrame, order: str, value: str) -> DataFrame:
    """df with the running minimum of a short metric history, and whether a row set it (for early stopping)."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.min(value).over(w)
    return df.select("*", F.least(F.coalesce(before, F.col(value)), F.col(value)).alias("best"), (before.isNull() | (F.col(value) < before)).alias("is_best"))
