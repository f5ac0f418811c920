"""Series as array columns: reshapes, paddings, masks and slices, all as built-in expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(c: Column | str) -> Column:
    return F.col(c).cast("array<double>") if isinstance(c, str) else c.cast("array<double>")


def zero_pad(c: Column, factor: int) -> Column:
    """The series followed by zeros, `factor` times as long."""
    if factor < 1:
        raise ValueError("factor must be at least 1")
    return c if factor == 1 else F.concat(c, F.array_repeat(F.lit(0.0), F.size(c) * (factor - 1)))


def pad_to(c: Column, length: Column | int) -> Column:
    """Right-padded with zeros, never cut."""
    n = F.lit(length) if isinstance(length, int) else length
    return F.concat(c, F.array_repeat(F.lit(0.0), F.greatest(n - F.size(c), F.lit(0))))


def fix_length(c: Column, length: int) -> Column:
    return pad_to(F.slice(c, 1, length), length)


def center_crop(c: Column, length: int) -> Column:
    """The middle `length` values, or the series padded on the right."""
    start = F.when(F.size(c) > length, F.floor((F.size(c) - length) / 2) + 1).otherwise(1)
    return pad_to(F.slice(c, start.cast("int"), F.lit(length)), length)


def halves(c: Column, length: int) -> Column:
    """Two segments of `length` values, the second padded."""
    return F.array(F.slice(c, 1, length), pad_to(F.slice(c, length + 1, length), length))


def band_slice(c: Column, lo: int, hi: int) -> Column:
    return F.slice(c, lo + 1, hi - lo)


def band_mask(c: Column, bands: Sequence[tuple[int, int]]) -> Column:
    """Values outside the half-open bands become 0."""

    def value(x: Column, k: Column) -> Column:
        inside = F.lit(False)
        for lo, hi in bands:
            inside |= (k >= lo) & (k < hi)
        return F.when(inside, x).otherwise(F.lit(0.0))

    return F.transform(c, value)


def mean(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)


def center(c: Column) -> Column:
    m = mean(c)
    return F.transform(c, lambda x: x - m)


def permute(c: Column, order: Sequence[int]) -> Column:
    return F.transform(F.array(*(F.lit(i + 1) for i in order)), lambda i: F.element_at(c, i))


def window(c: Column, name: str | None) -> Column:
    """Multiplied by a symmetric window of the series' length."""
    if name in (None, "none"):
        return c
    # fixed values: the coefficients of the cosine windows
    terms = {"hann": (0.5, 0.5, 0.0), "hamming": (0.54, 0.46, 0.0), "blackman": (0.42, 0.5, 0.08)}
    if name not in terms:
        raise ValueError(f"unknown window {name!r}: one of {sorted(terms)}")
    a, b, d = terms[name]
    last = F.size(c) - 1

    def value(x: Column, i: Column) -> Column:
        angle = 2 * F.pi() * i / last
        return x * F.when(last > 0, F.lit(a) - b * F.cos(angle) + d * F.cos(2 * angle)).otherwise(F.lit(1.0))

    return F.transform(c, value)


def haar(c: Column) -> Column:
    """One level of the Haar wavelet: averages, then differences. An odd series is extended by its last value."""
    even = F.when(F.size(c) % 2 == 0, c).otherwise(F.concat(c, F.slice(c, -1, 1)))
    pairs = F.sequence(F.lit(0), (F.size(even) / 2).cast("int") - 1)
    at = lambda i: F.element_at(even, i + 1)
    low = F.transform(pairs, lambda i: (at(2 * i) + at(2 * i + 1)) / F.sqrt(F.lit(2.0)))
    high = F.transform(pairs, lambda i: (at(2 * i) - at(2 * i + 1)) / F.sqrt(F.lit(2.0)))
    return F.when(F.size(c) == 0, c).otherwise(F.concat(low, high))


def transpose(c: Column) -> Column:
    """An array of equally long series as an array of their steps."""
    return F.transform(F.sequence(F.lit(1), F.size(F.get(c, F.lit(0)))), lambda t: F.transform(c, lambda x: F.element_at(x, t)))


def one_hot(c: Column, classes: Sequence[str]) -> Column:
    """1.0 at the place of the value among the classes; all 0.0 for another value or null."""
    return F.array(*(F.when(c == k, 1.0).otherwise(0.0) for k in classes))


def class_number(c: Column, classes: Sequence[str]) -> Column:
    """The place of the value among the sorted distinct classes, from 0; null for another value or null."""
    at = F.array_position(F.array(*(F.lit(k) for k in sorted(set(classes)))), c.cast("string"))
    return F.when(at > 0, at - 1).cast("int")


def without_special(tokens: Column, special: Column) -> Column:
    """The tokens whose flag in `special` is false."""
    return F.transform(F.filter(F.arrays_zip(tokens.alias("t"), special.alias("s")), lambda x: ~x["s"]), lambda x: x["t"])


def safe_name(c: Column) -> Column:
    return F.translate(c, " /", "__")


def audio_path(track_id: Column, root: str, extension: str = "mp3") -> Column:
    name = F.lpad(track_id.cast("string"), 6, "0")
    return F.concat_ws("/", F.lit(root), F.substring(name, 1, 3), F.concat(name, F.lit(f".{extension}")))
