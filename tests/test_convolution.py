import numpy as np
import pytest

from bandlake.operators import convolution as conv

SHAPE = "id int, label string, features array<array<double>>, is_test boolean"


def test_gradient_equals_finite_differences():
    rnd = np.random.default_rng(2)
    shape = conv.Shape(3, 8, (4, 5), 3, 3)
    w = shape.start(1) + rnd.normal(size=len(shape.start(1))) * 0.1
    x, y = rnd.normal(size=(6, 8, 3)), rnd.integers(0, 3, 6)
    got = conv.loss_and_gradient(y, x, w, shape)
    for at in range(len(w)):
        e = np.zeros_like(w)
        e[at] = 1e-6
        want = (conv.loss_and_gradient(y, x, w + e, shape)[0] - conv.loss_and_gradient(y, x, w - e, shape)[0]) / 2e-6
        assert got[3 + at] == pytest.approx(want, abs=2e-4)


def test_windows_and_their_transpose():
    rnd = np.random.default_rng(3)
    x, g = rnd.normal(size=(2, 7, 3)), rnd.normal(size=(2, 5, 9))
    assert np.allclose(conv.windows(x, 3)[1, 2], x[1, 2:5].reshape(-1))
    assert (conv.windows(x, 3) * g).sum() == pytest.approx((x * conv.unwindowed(g, 3, 3)).sum())


def test_patterns_in_time_are_learnt(spark):
    """Classes that differ by the order of steps, at any place: their means over time are equal."""
    rnd = np.random.default_rng(4)
    rows = []
    for i in range(160):
        x = rnd.normal(size=(2, 12)) * 0.1
        at = rnd.integers(0, 9)
        x[:, at : at + 3] += np.array([[2.0, -2.0, 0.0], [0, 0, 0]]) * (1 if i % 2 else -1)
        rows.append((i, "rise" if i % 2 else "fall", x.tolist(), i % 5 == 0))
    df = spark.createDataFrame([*rows, (900, None, rows[0][2], False), (901, "rise", None, True)], SHAPE)
    fitted = conv.fit_convolution(df, channels=(8, 8), epochs=12, batches=2, rate=0.02)
    said = conv.convolved(df, fitted, ["id"]).collect()
    assert len(said) == 32 and np.mean([r.label == r.prediction for r in said]) > 0.95
    assert len(fitted.state.history) == 12 and fitted.state.history[-1]["train_loss"] < fitted.state.history[0]["train_loss"]
    # one step by hand
    one = conv.fit_convolution(df, channels=(8, 8), epochs=1, batches=1, rate=0.02)
    train = [r for r in rows if not r[3]]
    x = np.array([r[2] for r in train]).transpose(0, 2, 1)
    y = np.array([["fall", "rise"].index(r[1]) for r in train])
    mean, scale = x.mean(axis=(0, 1)), x.std(axis=(0, 1))
    w = one.shape.start(42)
    g = conv.loss_and_gradient(y, (x - mean) / scale, w, one.shape)[3:] / len(y)
    assert np.allclose(one.mean, mean) and np.allclose(one.scale, scale) and np.allclose(one.state.weights, w - 0.02 * g / (np.abs(g) + 1e-8), atol=1e-7)
    with pytest.raises(ValueError, match="too few"):
        conv.fit_convolution(spark.createDataFrame([(1, "a", [[1.0, 2.0]], False)], SHAPE))
    with pytest.raises(ValueError, match="one length"):
        conv.fit_convolution(spark.createDataFrame([(1, "a", [[1.0] * 6], False), (2, "b", [[1.0] * 7], False)], SHAPE))
