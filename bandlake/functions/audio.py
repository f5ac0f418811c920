"""Sound as array columns: sampling rates, spectrograms with a time axis, onsets and tempo."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from bandlake.functions import bands, transforms

CROSSINGS = 16
CHUNK = 1 << 16


def lowpass(up: int, down: int, crossings: int = CROSSINGS) -> tuple[np.ndarray, int]:
    """(taps by phase, first sample's offset) of a Hann-windowed sinc: row r holds the weights of the samples around a place r / up behind one of them."""
    cut = min(1.0, up / down)
    half = math.ceil(crossings / cut)
    k = np.arange(-half + 1, half + 1)
    t = np.arange(up)[:, None] / up - k[None, :]
    window = np.where(np.abs(t) < half, 0.5 + 0.5 * np.cos(np.pi * t / half), 0.0)
    return cut * np.sinc(cut * t) * window, -half + 1


def resampled(x: np.ndarray, rate: int, to: int, crossings: int = CROSSINGS) -> np.ndarray:
    """Rows of samples at another rate, by one set of taps for each phase. Samples outside a row are 0; a row of n becomes ceil(n * to / rate) long."""
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    if up == down:
        return x
    taps, first = lowpass(up, down, crossings)
    width, n = taps.shape[1], -(-x.shape[1] * up // down)
    padded = np.pad(x, ((0, 0), (-first, width)))
    out = np.empty((len(x), n))
    for at in range(0, n, CHUNK):
        j = np.arange(at, min(n, at + CHUNK))
        base, phase = j * down // up, j * down % up
        out[:, j] = np.einsum("mjk,jk->mj", padded[:, base[:, None] + np.arange(width)], taps[phase], optimize=True)
    return out


def resample(c: Column, rate: int, to: int, crossings: int = CROSSINGS) -> Column:
    """The series at another sampling rate, without what lies above half the lower one."""
    if rate < 1 or to < 1:
        raise ValueError("rates are whole numbers above 0")

    @arrow_udf("array<double>")
    def run(series: pa.Array) -> pa.Array:
        return transforms.by_length(series, lambda x: resampled(x, rate, to, crossings))

    return run(c)


def frames(c: Column, width: int) -> Column:
    """A flat array of frames of `width` values each as an array of frames."""
    n = F.floor(F.size(c) / width).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(c, i * width + 1, F.lit(width)))).otherwise(F.array().cast("array<array<double>>"))


def spectrogram(df: DataFrame, keys: list[str], series: str, rate: int, n_mels: int = 128, length: int = 2048, hop: int = 512) -> DataFrame:
    """keys, frame, time (seconds), mel, db: decibels below the loudest of each series' mel spectrogram."""
    bank = bands.mel_filter_bank(length // 2 + 1, n_mels, rate)
    flat = df.select(*keys, transforms.mel_spectrogram(F.col(series), bank, length, hop).alias("_f"))
    each = flat.select(*keys, F.posexplode(frames(F.col("_f"), n_mels)).alias("frame", "_m"))
    return each.select(*keys, "frame", (F.col("frame") * F.lit(hop / rate)).alias("time"), F.posexplode("_m").alias("mel", "db"))


def onsets(x: np.ndarray, rate: int, length: int, hop: int, n_mels: int) -> np.ndarray:
    """How much louder each frame is than the one before, in decibels, over the mel bands where it is; the first frame has 0."""
    bank = bands.mel_filter_bank(length // 2 + 1, n_mels, rate)
    db = transforms.mel_decibels(x, bank, length, hop)
    rise = np.maximum(0, np.diff(db, axis=1)).mean(axis=2)
    return np.pad(rise, ((0, 0), (1, 0)))


def tempo_of(onset: np.ndarray, frame_rate: float, around: float = 120.0, spread: float = 1.0, slowest: float = 30.0, fastest: float = 320.0) -> np.ndarray:
    """Beats a minute of rows of onset strengths: the lag of the greatest autocorrelation, weighted by a normal distribution of `spread` octaves around `around`, and refined by the
    parabola through it and its neighbours. Rows without onsets, or too short for a beat, have nan."""
    n = onset.shape[1]
    lo, hi = max(1, math.ceil(60 * frame_rate / fastest)), min(n - 2, math.floor(60 * frame_rate / slowest))
    if hi < lo:
        return np.full(len(onset), np.nan)
    x = onset - onset.mean(axis=1, keepdims=True)
    r = np.fft.irfft(np.abs(np.fft.rfft(x, 2 * n, axis=1)) ** 2, axis=1)[:, : hi + 2]
    lags = np.arange(lo, hi + 1)
    prior = np.exp(-0.5 * (np.log2(60 * frame_rate / lags / around) / spread) ** 2)
    best = lags[(np.maximum(r[:, lags], 0) * prior).argmax(axis=1)]
    rows = np.arange(len(r))
    a, b, c = r[rows, best - 1], r[rows, best], r[rows, best + 1]
    bend = a - 2 * b + c
    shift = np.where(bend < 0, np.clip(0.5 * (a - c) / np.where(bend < 0, bend, 1), -0.5, 0.5), 0.0)
    return np.where(r[:, 0] > 1e-9, 60 * frame_rate / (best + shift), np.nan)


def _one(f: Callable[[np.ndarray], np.ndarray]):
    @arrow_udf("array<double>")
    def run(series: pa.Array) -> pa.Array:
        return transforms.by_length(series, f)

    return run


def onset_strength(c: Column, rate: int, length: int = 2048, hop: int = 512, n_mels: int = 128) -> Column:
    return _one(lambda x: onsets(x, rate, length, hop, n_mels))(c)


def tempo(c: Column, rate: int, length: int = 2048, hop: int = 512, n_mels: int = 128, around: float = 120.0) -> Column:
    """Estimated beats a minute of the samples; null for silence, or for less than two slow beats."""
    found = F.get(_one(lambda x: tempo_of(onsets(x, rate, length, hop, n_mels), rate / hop, around)[:, None])(c), 0)
    return F.when(~F.isnan(found), found)
