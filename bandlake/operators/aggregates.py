"""Aggregates of series tables: (sample, label, feature_idx, series), one row per sample and feature.

Array columns are summed position by position after a posexplode, with partial sums before each shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType

from bandlake.functions import arrays, transforms


def mean_spectrum(df: DataFrame, by: Sequence[str] = (), window: str | None = None, series: str = "series", transform: str = "fft") -> DataFrame:
    """Mean coefficient of each frequency, within groups."""
    c = transforms.apply_transform(arrays.doubles(series), transform, window)
    return df.select(*by, F.posexplode(c).alias("k", "m")).groupBy(*by, "k").agg(F.avg("m").alias("mean"))


def zero_padded_spectra(df: DataFrame, factors: Sequence[int], by: Sequence[str] = (), window: str | None = None, series: str = "series") -> DataFrame:
    """Mean magnitude spectra of the series padded to each factor, windowed after padding: factor, k, frequency (0 to 1), mean."""
    x = arrays.doubles(series)
    each = F.array(*(F.struct(F.lit(f).alias("factor"), arrays.window(arrays.zero_pad(x, f), window).alias("padded")) for f in sorted(set(factors))))
    padded = df.select(*by, F.inline(each))
    spectra = padded.select(*by, "factor", transforms.rfft_magnitude(F.col("padded")).alias("spectrum"))
    long = spectra.select(*by, "factor", F.size("spectrum").alias("n"), F.posexplode("spectrum").alias("k", "m"))
    return long.groupBy(*by, "factor", "k").agg((F.first("k") / F.greatest(F.max("n") - 1, F.lit(1))).alias("frequency"), F.avg("m").alias("mean"))


def autocorrelation_curves(df: DataFrame, max_lag: int, label: str | None = None, series: str = "series") -> DataFrame:
    """Mean autocorrelation of each lag; with a label, of all rows (label null) and of each label."""
    rho = transforms.autocorrelation(arrays.doubles(series), max_lag)
    if label is None:
        return df.select(F.posexplode(rho).alias("lag", "r")).groupBy("lag").agg(F.avg("r").alias("rho"))
    long = df.select(F.col(label).alias("label"), F.posexplode(rho).alias("lag", "r"))
    sets = long.groupingSets([["lag"], ["label", "lag"]], "label", "lag").agg(F.avg("r").alias("rho"), F.grouping("label").alias("is_total"))
    return sets


def key_lags(length: int, max_lag: int) -> list[int]:
    """Lags worth marking: fixed values 4 and 8, and quarters of the length."""
    return sorted({x for x in (4, 8, *(round(length * q) for q in (0.25, 0.5, 0.75))) if 0 < x <= max_lag})


def aligned_curves(curves: DataFrame, model: str = "model", lag: str = "lag") -> DataFrame:
    """Curves cut to the lags that every model has."""
    ends = curves.groupBy(model).agg(F.max(lag).alias("_end")).agg(F.min("_end").alias("_end"))
    return curves.crossJoin(F.broadcast(ends)).where(F.col(lag) <= F.col("_end")).drop("_end")


def position_stats(df: DataFrame, by: Sequence[str], column: Column) -> DataFrame:
    """Mean and population deviation of each position of an array."""
    return df.select(*by, F.posexplode(column).alias("k", "v")).groupBy(*by, "k").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def value_stats(df: DataFrame, by: Sequence[str], series: str = "series") -> DataFrame:
    """Mean, population deviation and extremes of all values."""
    return df.select(*by, F.explode(arrays.doubles(series)).alias("v")).groupBy(*by).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"), F.count("v").alias("n"))


def band_means(df: DataFrame, keys: Sequence[str], bands: Sequence[tuple[int, int]], coefficients: Column, rms: bool = False) -> DataFrame:
    """Mean (or root mean square) of the coefficients in each band, by array functions on one row."""
    value = (lambda c: F.sqrt(arrays.mean(F.transform(c, lambda x: x * x)))) if rms else arrays.mean
    each = F.array(*(value(arrays.band_slice(F.col("_c"), lo, hi)) for lo, hi in bands))
    return df.select(*keys, coefficients.alias("_c")).select(*keys, F.posexplode(each).alias("band", "value"))


def feature_mean(df: DataFrame, sample: str, series: str = "series") -> DataFrame:
    """One series a sample: the mean over its features."""
    long = df.select(sample, F.posexplode(arrays.doubles(series)).alias("t", "v")).groupBy(sample, "t").agg(F.avg("v").alias("v"))
    return long.groupBy(sample).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "v"))), lambda x: x["v"]).alias("series"))


def correlation(df: DataFrame, x: str, y: str, by: Sequence[str] = (), least_pairs: int = 10) -> DataFrame:
    """Pearson's r of the finite pairs, its t value, two-sided p value and number; null r below least_pairs."""
    ok = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    found = ok.groupBy(*by).agg(F.corr(x, y).alias("r"), F.count("*").alias("n"))
    r = F.when(F.col("n") >= least_pairs, F.col("r"))
    tested = found.select(*by, r.alias("r"), F.when(F.abs(r) < 1, r * F.sqrt(F.try_divide(F.col("n") - 2, 1 - r * r))).alias("t"), "n")
    return tested.withColumn("p", F.when(F.abs("r") >= 1, 0.0).otherwise(_two_sided("t", (F.col("n") - 2).cast("double"))))


def student_p(t: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """Two-sided p values of Student's t: the regularised incomplete beta function of dof / (dof + t^2), by its continued fraction."""
    t, dof = np.asarray(t, float), np.asarray(dof, float)
    x = dof / (dof + t * t)
    a, b = dof / 2, np.full_like(dof, 0.5)
    turn = x > (a + 1) / (a + b + 2)  # the fraction converges fast on the other side
    a, b, x = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, 1 - x, x)
    log_gamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    c, d = np.ones_like(x), 1 / (1 - (a + b) * x / (a + 1))
    total = d.copy()
    for m in range(1, 5000):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        for step in (even, odd):
            d, c = 1 / (1 + step * d), 1 + step / c
            total = total * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    found = front * total
    return np.clip(np.where(turn, 1 - found, found), 0, 1)


@arrow_udf(DoubleType())
def _two_sided(t: pa.Array, dof: pa.Array) -> pa.Array:
    known = np.asarray(pa.compute.and_(t.is_valid(), pa.compute.greater(dof, 0)).fill_null(False))
    out = np.full(len(t), np.nan)
    out[known] = student_p(np.asarray(t.fill_null(0.0))[known], np.asarray(dof)[known])
    return pa.array(out, mask=~known)


def lookup_join(df: DataFrame, table: DataFrame, key: str, value: str, small_rows: int = 1_000_000) -> DataFrame:
    """Left join with one row a key (the largest value that isn't NaN); NaN counts as missing. Broadcast only if the table is small."""
    clean = table.select(key, F.when(~F.isnan(value), F.col(value)).alias(value)).groupBy(key).agg(F.max(value).alias(value))
    small = clean.count() <= small_rows
    return df.join(F.broadcast(clean) if small else clean, key, "left")


def band_decomposition(df: DataFrame, keys: Sequence[str], features: str, n_bands: int, size: int | None = None) -> DataFrame:
    """keys, dim, band, token, value of an array of series (one a dimension, over tokens): band 0 is the series itself, 1 to n_bands its parts, which sum to it unless a filter `size` is given.
    A series at a time is taken apart in one Arrow pass."""
    each = df.select(*keys, F.posexplode(features).alias("dim", "_x"))
    rows = each.select(*keys, "dim", F.posexplode(transforms.decomposed(F.col("_x").cast("array<double>"), n_bands, size)).alias("band", "_y"))
    return rows.select(*keys, "dim", "band", F.posexplode("_y").alias("token", "value"))


def spectrum_surfaces(df: DataFrame, sample: str, dim: str, series: str = "series", dim_step: int = 1, transform: str = "fft") -> DataFrame:
    """Two surfaces over frequency, as rows axis, at, k, value: mean magnitudes of each sample, numbered from 1 by falling energy (then by sample), and of each `dim_step`-th dimension."""
    if dim_step < 1:
        raise ValueError("dim_step is at least 1")
    m = df.select(sample, dim, transforms.apply_transform(arrays.doubles(series), transform).alias("_m"))
    energy = m.groupBy(sample).agg(F.sum(F.aggregate("_m", F.lit(0.0), lambda a, x: a + x * x)).alias("_e"))
    ranked = ordered_places(energy, [F.col("_e").desc(), F.col(sample)], "at").select(sample, "at")
    long = m.select(sample, dim, F.posexplode("_m").alias("k", "v"))
    by_sample = long.groupBy(sample, "k").agg(F.avg("v").alias("value")).join(ranked, sample).select(F.lit("sample").alias("axis"), "at", "k", "value")
    by_dim = long.where(F.col(dim) % dim_step == 0).groupBy(F.col(dim).cast("long").alias("at"), "k").agg(F.avg("v").alias("value"))
    return by_sample.unionByName(by_dim.select(F.lit("dimension").alias("axis"), "at", "k", "value"))


def ordered_places(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with the rows' places (from 1) in an order, by a range exchange and counts of its parts instead of one task's window."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    own = Window.partitionBy("_part").orderBy(*order)
    placed = sorted_.withColumn("_own", F.row_number().over(own))
    counts = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a part
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")
