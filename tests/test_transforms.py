import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bandlake.functions import arrays, bands, transforms
from bandlake.functions.sql import register


def one(spark, rows, f):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x array<double>")
    return [r.y for r in sorted(df.select("i", f(F.col("x")).alias("y")).collect(), key=lambda r: r.i)]


SERIES = [[1.0, 2.0, 4.0, -1.0], [3.0] * 5, [0.5], [], None, [1.0, None], np.random.default_rng(1).standard_normal(37).tolist(), [float(i % 7) for i in range(32)]]


def test_transforms_of_ragged_series(spark):
    spectra, cosines = one(spark, SERIES, transforms.rfft_magnitude), one(spark, SERIES, transforms.dct)
    back = one(spark, SERIES, lambda c: transforms.inverse_dct(transforms.dct(c)))
    rho = one(spark, SERIES, lambda c: transforms.autocorrelation(c, 3))
    for x, m, c, b, r in zip(SERIES, spectra, cosines, back, rho, strict=True):
        if x is None or None in x:
            assert m is c is b is r is None
        elif not x:
            assert m == c == b == r == []
        else:
            n, x, m = len(x), np.array(x), np.array(m)
            assert len(m) == n // 2 + 1 and np.allclose(m, np.abs(np.fft.rfft(x)) / np.sqrt(n))
            double = np.full(len(m), 2.0)
            double[0] = 1
            if n % 2 == 0:
                double[-1] = 1
            assert np.isclose((double * m**2).sum(), (x**2).sum()) and np.isclose((np.array(c) ** 2).sum(), (x**2).sum())
            assert np.allclose(b, x) and len(r) == min(3, n - 1) + 1
            assert r == [0.0] * len(r) if np.ptp(x) == 0 else np.isclose(r[0], 1) and max(map(abs, r)) <= 1 + 1e-9


def test_arrays(spark):
    run = lambda x, f: one(spark, [x], f)[0]
    x = [1.0, 2.0, 3.0, 4.0, 5.0]
    assert run(x, lambda c: arrays.zero_pad(c, 2)) == x + [0.0] * 5
    assert run(x, lambda c: arrays.center_crop(c, 3)) == [2.0, 3.0, 4.0] and run(x, lambda c: arrays.center_crop(c, 7)) == x + [0.0, 0.0]
    assert run(x, lambda c: arrays.fix_length(c, 2)) == [1.0, 2.0]
    assert run(x, lambda c: arrays.halves(c, 3)) == [[1.0, 2.0, 3.0], [4.0, 5.0, 0.0]]
    assert run(x, lambda c: arrays.band_mask(c, [(0, 1), (3, 5)])) == [1.0, 0.0, 0.0, 4.0, 5.0]
    assert run(x, lambda c: arrays.band_slice(c, 1, 3)) == [2.0, 3.0]
    assert run(x, arrays.center) == [-2.0, -1.0, 0.0, 1.0, 2.0]
    assert run(x, lambda c: arrays.permute(c, [4, 0, 1, 2, 3])) == [5.0, 1.0, 2.0, 3.0, 4.0]
    w = run(x[:4], arrays.haar)
    assert np.isclose(sum(v * v for v in w), 30) and np.isclose(w[0], 3 / np.sqrt(2))
    for name, f in (("hann", np.hanning), ("hamming", np.hamming), ("blackman", np.blackman)):
        assert np.allclose(run([1.0] * 9, lambda c, name=name: arrays.window(c, name)), f(9))
    with pytest.raises(ValueError):
        arrays.window(F.col("x"), "kaiser")
    with pytest.raises(ValueError):
        arrays.zero_pad(F.col("x"), 0)
    with pytest.raises(ValueError):
        transforms.apply_transform(F.col("x"), "none")


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 600), st.data())
def test_exact_allocation_is_a_partition(n, data):
    count = data.draw(st.integers(1, n))
    layout = bands.allocated(n, count)
    assert [k for lo, hi in layout for k in range(lo, hi)] == list(range(n))
    assert max(hi - lo for lo, hi in layout) - min(hi - lo for lo, hi in layout) <= 1


def test_layouts_and_banks():
    assert bands.equal_width(33, 4)[-1] == (28, 32) and bands.equal_count(33, 5)[-1] == (24, 33)
    assert bands.allocated(512, 5, exact=False) == [(0, 103), (102, 204), (204, 306), (306, 408), (408, 511)]
    assert len(bands.log_filter_bank(32)) == 9 and len(bands.log_filter_bank(64)) == 10
    assert bands.log_filter_bank(32).max() == 1 and (bands.mel_filter_bank(64) >= 0).all() and bands.mel_filter_bank(64).shape == (12, 64)
    assert bands.parse_filter("nofilter()") is None and bands.parse_filter("band(8, 2, 4)").tolist() == [0, 0, 1, 1, 1, 0, 0, 0]
    assert bands.parse_filter("auto(3)").tolist() == [1, 1, 1] and bands.parse_filter("eqalloc(512, 5, 1)").sum() == 102
    for bad in ("band(8,2)", "band(8,4,2)", "other(1)", "band 8", "nofilter(1)"):
        with pytest.raises(ValueError):
            bands.parse_filter(bad)


def test_filters_of_a_partition_add_up(spark):
    layout = bands.allocated(16, 3)
    x = [np.random.default_rng(n).standard_normal(n).tolist() for n in (16, 32, 11)]
    total = np.zeros(3, object)
    for lo, hi in layout:
        w = np.zeros(16)
        w[lo:hi] = 1
        total = [np.array(y) + t for y, t in zip(one(spark, x, lambda c, w=w: transforms.frequency_filter(c, w)), total, strict=True)]
    assert all(np.allclose(t, y) for t, y in zip(total, x, strict=True))


def test_sql_functions(spark):
    register(spark)
    m = spark.sql("select rfft_magnitude(array(1d, 2d, 4d, -1d)) as m").first().m
    assert np.allclose(m, np.abs(np.fft.rfft([1, 2, 4, -1])) / 2)
    rows = spark.sql("select * from spectrum(array(1d, 2d, 4d, -1d))").collect()
    assert np.allclose([r.magnitude for r in sorted(rows)], m)


def test_more_transforms(spark):
    from bandlake.functions import bands
    from bandlake.operators.aggregates import correlation, student_p
    from bandlake.operators.metrics import batch_mean

    x = np.random.default_rng(3).standard_normal(700)
    df = spark.createDataFrame([(x.tolist(), [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]], "b", ["[CLS]", "a", "[SEP]"], [True, False, True])], "x array<double>, m array<array<double>>, c string, t array<string>, s array<boolean>")
    bank = bands.mel_filter_bank(65, 8)
    r = df.select(transforms.dct_sums(F.col("x")).alias("d"), transforms.mel_spectrogram(F.col("x"), bank, 128, 64).alias("g"), arrays.transpose(F.col("m")).alias("m"), arrays.one_hot(F.col("c"), ["a", "b"]).alias("h"), arrays.without_special(F.col("t"), F.col("s")).alias("t")).first()
    k, t = np.arange(700)[:, None], np.arange(700)[None]
    assert np.allclose(r.d, 2 * (np.cos(np.pi * (2 * t + 1) * k / 1400) @ x)) and r.m == [[1.0, 4.0], [2.0, 5.0], [3.0, 6.0]] and r.h == [0.0, 1.0] and r.t == ["a"]
    padded = np.pad(x, 64)
    power = np.array([np.abs(np.fft.rfft(padded[i : i + 128] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(128) / 128)))) ** 2 for i in range(0, len(padded) - 127, 64)]) @ bank.T
    assert np.allclose(np.array(r.g).reshape(power.shape), np.maximum(10 * np.log10(power / power.max()), -80), atol=1e-6) and max(r.g) == 0
    # critical values of Student's t, from tables
    assert np.allclose(student_p(np.array([2.228, 12.706, 1.96, 0.0, 2.704]), np.array([10, 1, 1e6, 5, 40])), [0.05, 0.05, 0.05, 1.0, 0.01], atol=2e-4)
    rows = spark.createDataFrame([(float(i), float(i * i % 17), i % 3) for i in range(60)] + [(None, 1.0, 0)], "x double, y double, b int")
    found = correlation(rows, "x", "y").first()
    assert abs(found.p - student_p([found.t], [58.0])[0]) < 1e-12 and 0 < found.p < 1 and correlation(rows.limit(5), "x", "y").first().p is None
    assert batch_mean(spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 5.0)], "b int, v double"), "b", "v").first().v == 3.5
