"""Band layouts, filter specifications and filter banks over a frequency axis."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Band = tuple[int, int]

#: Layouts given by name, as half-open ranges.
NAMED = {"log5_of_64": [(0, 1), (1, 2), (2, 5), (5, 17), (17, 64)], "log5_of_512": [(0, 2), (2, 9), (9, 34), (34, 130), (130, 512)]}


def equal_width(n: int, width: int) -> list[Band]:
    """Bands of one width; the frequencies that are left over belong to none."""
    return [(i * width, (i + 1) * width) for i in range(n // width)]


def equal_count(n: int, count: int) -> list[Band]:
    """A number of bands; the last takes what is left over."""
    size = n // count
    return [(i * size, n if i == count - 1 else (i + 1) * size) for i in range(count)]


def allocated(n: int, count: int, exact: bool = True) -> list[Band]:
    """Bands whose left-over frequencies go to the outer bands first, left and right in turn.

    exact: a partition, whose first and last bands are the wider ones. Otherwise the compatible layout, whose bands all start at multiples of the
    common width, so that wider bands overlap the next one and the end may be left out; its wider bands are every third from the first, and the last ones.
    """
    if not 0 < count <= n:
        raise ValueError("between one band and as many as frequencies")
    size, extra = divmod(n, count)
    left, right = extra - extra // 2, extra // 2  # how many wider bands there are on each side
    b = np.arange(count)
    wide = ((b < left) if exact else (b % 3 == 0) & (b < 3 * left)) | (b >= count - right)
    start = b * size + (np.cumsum(wide) - wide if exact else 0)
    return list(zip(start.tolist(), (start + size + wide).tolist(), strict=True))


def parse_filter(text: str) -> np.ndarray | None:
    """nofilter(), band(size, first, last), eqalloc(size, bands, band) or auto(size) as weights; None for nofilter()."""
    m = re.fullmatch(r"\s*([a-z]+)\(\s*((?:\d+\s*,?\s*)*)\)\s*", text, re.IGNORECASE)
    if not m:
        raise ValueError(f"not a filter: {text!r}")
    name, args = m[1].lower(), [int(x) for x in re.findall(r"\d+", m[2])]
    count = {"nofilter": 0, "band": 3, "eqalloc": 3, "auto": 1}
    if name not in count:
        raise ValueError(f"unknown filter {name!r}")
    if len(args) != count[name]:
        raise ValueError(f"{name} takes {count[name]} arguments")
    if name == "nofilter":
        return None
    weights = np.zeros(args[0])
    if name == "auto":
        return weights + 1
    if name == "band":
        if not args[1] < args[2] < args[0]:
            raise ValueError("band needs first < last < size")
        lo, hi = args[1], args[2] + 1
    else:
        lo, hi = allocated(args[0], args[1], exact=False)[args[2]]
    weights[lo:hi] = 1
    return weights


def layout_frame(spark: SparkSession, bands: list[Band]) -> DataFrame:
    return spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(bands)], "band int, lo int, hi int")


def describe(spark: SparkSession, bands: list[Band], n: int) -> DataFrame:
    """For each frequency: how many bands hold it, and 'unused', 'single' or 'overlap'."""
    k = spark.range(n).select(F.col("id").cast("int").alias("k"))
    held = k.join(F.broadcast(layout_frame(spark, bands)), (F.col("k") >= F.col("lo")) & (F.col("k") < F.col("hi")), "left")
    count = F.count("band")
    return held.groupBy("k").agg(count.alias("n_bands"), F.when(count == 0, "unused").when(count == 1, "single").otherwise("overlap").alias("state"))


def log_filter_bank(n: int, bands: int = 12, normalise: bool = False) -> np.ndarray:
    """Triangles between logarithmically spaced indices; indices that fall together give one edge. Frequency 0 is outside."""
    edges = np.unique(np.minimum(np.floor(np.logspace(0, np.log10(n), bands + 2)).astype(int), n - 1))
    bank = np.zeros((len(edges) - 2, n))
    for row, (a, b, c) in zip(bank, zip(edges, edges[1:], edges[2:], strict=False), strict=True):
        row[a:b] = np.arange(b - a) / (b - a)
        row[b:c] = 1 - np.arange(c - b) / (c - b)
    return bank / bank.sum(axis=1, keepdims=True) if normalise else bank


def _mel(hz: np.ndarray) -> np.ndarray:
    # fixed values of the Slaney scale: linear below 1000 Hz at 200 / 3 Hz, then 27 steps to 6400 Hz
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1e-9) / 1000) * 27 / np.log(6.4))


def _hz(mel: np.ndarray) -> np.ndarray:
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp((mel - 15) * np.log(6.4) / 27))


def mel_filter_bank(n: int, bands: int = 12, rate: float = 22050) -> np.ndarray:
    """Triangles between frequencies that are equally spaced on the Slaney mel scale, of equal area."""
    hz = np.linspace(0, rate / 2, n)
    edges = _hz(np.linspace(0, float(_mel(np.array(rate / 2))), bands + 2))
    up = (hz[None, :] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - hz[None, :]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]
