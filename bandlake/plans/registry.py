"""The table of queries: each takes (spark, sf_dir); SQL beside it gives the same rows on another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlake.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Six digits, and no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("series"))


# SQL building blocks over embeddings: s(vec_id, label, t, v) and d(vec_id, label, k, m)
SERIES_SQL = "s as (select vec_id, label, unnest(range(0, 64)) as t, cast(unnest(embedding) as double) as v from embeddings)"


def rfft_sql(source: str = "s", n: int = 64, keys: str = "vec_id, label", name: str = "d", scale: int | None = None) -> str:
    """Orthonormal |rfft| of source(keys, t, v)."""
    return (
        f"{name} as (select {keys}, k, sqrt(re * re + im * im) / sqrt(cast({scale or n} as double)) as m from (select {keys}, k, sum(v * cos(2 * pi() * ((k * t) % {n}) / {n})) as re, sum(v * sin(2 * pi() * ((k * t) % {n}) / {n})) as im "
        f"from {source}, (select unnest(range(0, {n // 2 + 1})) as k) group by {keys}, k))"
    )


def dct_sql(source: str = "s", n: int = 64, keys: str = "vec_id, label", name: str = "d") -> str:
    return (
        f"{name} as (select {keys}, k, sum(v * cos(pi() * (2 * t + 1) * k / {2 * n})) * case when k = 0 then sqrt(cast(1.0 / {n} as double)) else sqrt(cast(2.0 / {n} as double)) end as m "
        f"from {source}, (select unnest(range(0, {n})) as k) group by {keys}, k)"
    )


def window_sql(name: str, n: int = 64) -> str:
    angle = f"2 * pi() * t / {n - 1}"
    return {"hann": f"(0.5 - 0.5 * cos({angle}))", "hamming": f"(0.54 - 0.46 * cos({angle}))", "blackman": f"(0.42 - 0.5 * cos({angle}) + 0.08 * cos(2 * {angle}))"}[name]
