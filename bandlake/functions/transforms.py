"""Spectral transforms of array columns, as Arrow functions over batches of series.

Series of equal length are transformed together; each length's basis is computed once a batch. A null series, or
one with a null in it, gives null; an empty one gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from bandlake.functions import arrays, bands


#: Longer series are not multiplied by a basis of cosines.
BASIS = 512


def by_length(series: pa.Array, f: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """Applies f to the stacked rows of each length."""
    values = series.cast(pa.list_(pa.float64()))
    flat = values.flatten()
    sizes = np.asarray(pa.compute.list_value_length(values).fill_null(0))
    starts = np.cumsum(sizes) - sizes
    valid = np.asarray(values.is_valid())
    if flat.null_count:
        holes = np.add.reduceat(np.append(np.asarray(flat.is_null()).astype(np.int64), 0), np.minimum(starts, len(flat))) if len(starts) else np.zeros(0)
        valid &= ~((holes > 0) & (sizes > 0))
    x = np.asarray(flat.fill_null(0.0), dtype=np.float64)
    rows: list = [None] * len(values)
    lengths = np.zeros(len(values), np.int64)
    for n in np.unique(sizes[valid]):
        at = np.flatnonzero(valid & (sizes == n))
        found = f(x[starts[at][:, None] + np.arange(n)]) if n else np.zeros((len(at), 0))
        lengths[at] = found.shape[1]
        if len(at) == len(values):
            return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * found.shape[1]), pa.array(found.reshape(-1)))
        for i, r in zip(at, found, strict=True):
            rows[i] = r
    return pa.array(rows, pa.list_(pa.float64()))


@lru_cache(maxsize=2)
def dct_basis(n: int) -> np.ndarray:
    """Orthonormal cosines, a row per frequency; the last ones are kept, as a block goes there and back."""
    k, t = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * (2 * t + 1) * k / (2 * n)) * np.sqrt(2.0 / n)
    basis[0] /= np.sqrt(2.0)
    basis.flags.writeable = False
    return basis


def dct_rows(x: np.ndarray) -> np.ndarray:
    """Orthonormal cosine transform along the last axis; long rows by way of a Fourier transform, as a basis grows with the square."""
    n = x.shape[-1]
    if n <= BASIS:
        return x @ dct_basis(n).T
    v = np.concatenate([x[..., ::2], x[..., 1::2][..., ::-1]], axis=-1)
    y = (np.fft.fft(v, axis=-1) * np.exp(-0.5j * np.pi * np.arange(n) / n)).real * np.sqrt(2.0 / n)
    y[..., 0] /= np.sqrt(2.0)
    return y


def inverse_dct_rows(y: np.ndarray) -> np.ndarray:
    n = y.shape[-1]
    if n <= BASIS:
        return y @ dct_basis(n)
    y = y * np.sqrt(n / 2.0)
    y[..., 0] *= np.sqrt(2.0)
    back = np.concatenate([np.zeros_like(y[..., :1]), y[..., :0:-1]], axis=-1)
    v = np.fft.ifft((y - 1j * back) * np.exp(0.5j * np.pi * np.arange(n) / n), axis=-1).real
    x = np.empty_like(v)
    x[..., ::2] = v[..., : n - n // 2]
    x[..., 1::2] = v[..., n - n // 2 :][..., ::-1]
    return x


def _rfft(x: np.ndarray) -> np.ndarray:
    return np.abs(np.fft.rfft(x, axis=1)) / np.sqrt(x.shape[1])


def _autocorrelation(x: np.ndarray, max_lag: int) -> np.ndarray:
    n = x.shape[1]
    x = x - x.mean(axis=1, keepdims=True)
    power = np.abs(np.fft.rfft(x, 2 * n, axis=1)) ** 2
    r = np.fft.irfft(power, axis=1)[:, : min(max_lag, n - 1) + 1]
    zero = r[:, :1] <= 1e-12 * n
    return np.where(zero, 0.0, r / np.where(zero, 1.0, r[:, :1]))


def _arrow(f: Callable[[np.ndarray], np.ndarray]):
    @arrow_udf("array<double>")
    def run(series: pa.Array) -> pa.Array:
        return by_length(series, f)

    return run


def rfft_magnitude(c: Column, window: str | None = None) -> Column:
    """Orthonormal |rfft| of the windowed series: len // 2 + 1 values."""
    return _arrow(_rfft)(arrays.window(c, window))


def dct(c: Column) -> Column:
    return _arrow(dct_rows)(c)


def dct_sums(c: Column) -> Column:
    """The cosine transform without normalisation: 2 sum x cos(pi (2n + 1) k / 2N)."""

    def f(x: np.ndarray) -> np.ndarray:
        n = x.shape[1]
        scale = np.full(n, np.sqrt(2.0 * n))
        scale[0] = 2 * np.sqrt(n)
        return dct_rows(x) * scale

    return _arrow(f)(c)


def mel_decibels(x: np.ndarray, bank: np.ndarray, length: int, hop: int) -> np.ndarray:
    """(rows, frames, bands): see mel_spectrogram. Frames are taken in blocks, so that a long series needs no copy of all of them."""
    x = np.pad(x, ((0, 0), (length // 2, length // 2)))
    frames = np.lib.stride_tricks.sliding_window_view(x, length, axis=1)[:, ::hop]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)
    power = np.concatenate([np.abs(np.fft.rfft(frames[:, i : i + 256] * hann, axis=2)) ** 2 @ bank.T for i in range(0, max(1, frames.shape[1]), 256)], axis=1)
    db = 10 * np.log10(np.maximum(power, 1e-10)) - 10 * np.log10(np.maximum(power.max(axis=(1, 2), keepdims=True), 1e-10))
    return np.maximum(db, -80)


def mel_spectrogram(c: Column, bank: np.ndarray, length: int = 512, hop: int = 128) -> Column:
    """Decibels below the loudest, frame by frame: |rfft|^2 of Hann-windowed frames times a bank of length // 2 + 1 columns, at most 80 below. Frames
    are centred on multiples of `hop`, and the series is extended by zeros."""
    return _arrow(lambda x: mel_decibels(x, bank, length, hop).reshape(len(x), -1))(c)


def inverse_dct(c: Column) -> Column:
    return _arrow(inverse_dct_rows)(c)


def autocorrelation(c: Column, max_lag: int) -> Column:
    """Centred, biased, divided by lag 0; a constant series has zeros. Lags beyond the series are left out."""
    if max_lag < 0:
        raise ValueError("max_lag must not be negative")
    return _arrow(lambda x: _autocorrelation(x, max_lag))(c)


def filter_bank(c: Column, bank: np.ndarray) -> Column:
    """Weighted sums of the coefficients, one per row of the bank."""
    return _arrow(lambda x: x[:, : bank.shape[1]] @ bank[:, : x.shape[1]].T)(c)


def pooled_filter(weights: np.ndarray, n: int) -> np.ndarray:
    """The filter averaged down (or spread) to n frequencies."""
    size = len(weights)
    low, high = np.arange(n) * size // n, -(-(np.arange(n) + 1) * size // n)
    total = np.concatenate([[0.0], np.cumsum(weights)])
    return (total[high] - total[low]) / (high - low)


def unpooled_filter(values: np.ndarray, size: int) -> np.ndarray:
    """The transpose of pooled_filter: what a gradient by the pooled filter is by the filter."""
    n = len(values)
    low, high = np.arange(n) * size // n, -(-(np.arange(n) + 1) * size // n)
    edge = np.zeros(size + 1)
    np.add.at(edge, low, values / (high - low))
    np.add.at(edge, high, -values / (high - low))
    return np.cumsum(edge[:-1])


def openness(weights: np.ndarray, n: int, sigmoid: bool) -> np.ndarray:
    """The filter for a series of length n: pooled, then, for a learnt one, its sigmoid."""
    w = pooled_filter(weights, n)
    return 1 / (1 + np.exp(-w)) if sigmoid else w


def _filtered(weights: np.ndarray, sigmoid: bool) -> Callable[[np.ndarray], np.ndarray]:
    return lambda x: inverse_dct_rows(dct_rows(x) * openness(weights, x.shape[-1], sigmoid))


def frequency_filter(c: Column, weights: np.ndarray, sigmoid: bool = False) -> Column:
    """Cosine transform, times the filter pooled to the series' length, and back."""
    return _arrow(_filtered(weights, sigmoid))(c)


def filter_lanes(c: Column, weights: np.ndarray, sigmoid: bool = False) -> Column:
    """frequency_filter of each series of an array of series, row by row."""

    @arrow_udf("array<array<double>>")
    def run(rows: pa.Array) -> pa.Array:
        rows = rows.cast(pa.list_(pa.list_(pa.float64())))
        found = by_length(rows.flatten(), _filtered(weights, sigmoid))
        sizes = pa.compute.list_value_length(rows).fill_null(0).to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), found, mask=rows.is_null() if rows.null_count else None)

    return run(c)


TRANSFORMS: dict[str, Callable[..., Column]] = {"dct": dct, "fft": rfft_magnitude, "dft": rfft_magnitude, "haar": arrays.haar}


def register_transform(name: str, f: Callable[..., Column]) -> None:
    TRANSFORMS[name] = f


def apply_transform(c: Column, name: str, window: str | None = None) -> Column:
    """A transform by name. A window needs a Fourier transform."""
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name!r}: one of {sorted(TRANSFORMS)}")
    return TRANSFORMS[name](c, window) if name in ("fft", "dft") else TRANSFORMS[name](c)


def spectrum(c: Column, alias: tuple[str, str] = ("k", "magnitude")) -> Column:
    """A generator of (k, value) rows."""
    return F.posexplode(c).alias(*alias)


def decomposed(c: Column, n_bands: int, size: int | None = None) -> Column:
    """A series as its parts in each of n_bands bands: rows of an array, first the series itself, then a row a band. Bands are those of bands.allocated(size, n_bands),
    pooled to the series' length; without a size they are allocated over its own frequencies, so that the rows of the bands sum to the series (shorter series leave bands empty)."""

    @arrow_udf("array<array<double>>")
    def run(series: pa.Array) -> pa.Array:
        def f(x: np.ndarray) -> np.ndarray:
            n = x.shape[1]
            y = dct_rows(x)
            parts = [x]
            if size is None:
                layout = bands.allocated(n, n_bands) if n >= n_bands else [(k, k + 1) if k < n else (0, 0) for k in range(n_bands)]
                gates = [((np.arange(n) >= lo) & (np.arange(n) < hi)).astype(float) for lo, hi in layout]
            else:
                gates = [pooled_filter(((np.arange(size) >= lo) & (np.arange(size) < hi)).astype(float), n) for lo, hi in bands.allocated(size, n_bands, exact=False)]
            parts += [inverse_dct_rows(y * g) for g in gates]
            return np.concatenate(parts, axis=1)

        flat = by_length(series, f)
        rows = n_bands + 1
        sizes = (pa.compute.list_value_length(flat).fill_null(0).to_numpy(zero_copy_only=False) // rows).astype(np.int64)
        inner = np.concatenate([[0], np.cumsum(np.repeat(sizes, rows))]).astype(np.int32)
        outer = np.arange(len(flat) + 1, dtype=np.int32) * rows
        return pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), flat.flatten()), mask=flat.is_null() if flat.null_count else None)

    return run(c)
