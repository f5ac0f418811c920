"""Registers the transforms as SQL functions and the table function spectrum(series)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from bandlake.functions import transforms


def register(spark: SparkSession) -> None:
    """rfft_magnitude, dct, inverse_dct (arrays, by Arrow batches) and spectrum (rows k, frequency, magnitude, from the first)."""
    functions = {"rfft_magnitude": transforms._rfft, "dct": lambda x: x @ transforms.dct_basis(x.shape[1]).T, "inverse_dct": lambda x: x @ transforms.dct_basis(x.shape[1])}
    for name, f in functions.items():
        spark.udf.register(name, transforms._arrow(f))
    spark.sql("""
        create or replace temporary function spectrum(series array<double>) returns table (k int, frequency double, magnitude double)
        return select pos, pos / greatest(1, size(m) - 1), col from (select rfft_magnitude(series) as m) lateral view posexplode(m) as pos, col
    """)
