"""A convolution probe: two convolutions over time, their mean, and a softmax, as learnable filters beside the fixed transforms.

Windows are laid out as rows of a matrix, so a layer is a product; gradients go back through the same layout and are summed over the tasks. Steps are those of the
training loop: mini-batches dealt by a hash, Adam.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandlake.operators.probes import summed
from bandlake.operators.training import State, adam
from bandlake.session import stored

BLOCK_BYTES = 32 << 20


@dataclass
class Shape:
    """Sizes of the network: features in, steps, channels of both convolutions, their kernel, classes."""

    features: int
    steps: int
    channels: tuple[int, int]
    kernel: int
    classes: int

    def parts(self) -> list[tuple[int, int]]:
        """Shapes of the three layers' weights, the last row of each being the intercepts."""
        a, b = self.channels
        return [(self.kernel * self.features + 1, a), (self.kernel * a + 1, b), (b + 1, self.classes)]

    def split(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for r, c in self.parts():
            out.append(flat[at : at + r * c].reshape(r, c))
            at += r * c
        return out

    def start(self, seed: int) -> np.ndarray:
        """Uniform by the layers' fan in and out, intercepts 0."""
        rnd, out = np.random.default_rng(seed), []
        for i, (r, c) in enumerate(self.parts()):
            fan = r - 1 + c * (self.kernel if i < 2 else 1)
            w = rnd.uniform(-1, 1, (r, c)) * np.sqrt(6 / fan)
            w[-1] = 0
            out.append(w.reshape(-1))
        return np.concatenate(out)


def windows(x: np.ndarray, kernel: int) -> np.ndarray:
    """(m, T, C) as (m, T - kernel + 1, kernel * C): the steps of each window side by side."""
    n = x.shape[1] - kernel + 1
    return np.concatenate([x[:, k : k + n] for k in range(kernel)], axis=2)


def unwindowed(g: np.ndarray, kernel: int, channels: int) -> np.ndarray:
    """The transpose of `windows`: each step's gradients from all windows that hold it."""
    n = g.shape[1]
    out = np.zeros((g.shape[0], n + kernel - 1, channels))
    for k in range(kernel):
        out[:, k : k + n] += g[:, :, k * channels : (k + 1) * channels]
    return out


def forward(x: np.ndarray, flat: np.ndarray, shape: Shape) -> tuple[np.ndarray, list]:
    """(class probabilities, what the way back needs) of (m, T, F)."""
    w1, w2, w3 = shape.split(flat)
    a = windows(x, shape.kernel)
    h1 = np.maximum(0, a @ w1[:-1] + w1[-1])
    b = windows(h1, shape.kernel)
    h2 = np.maximum(0, b @ w2[:-1] + w2[-1])
    pooled = h2.mean(axis=1)
    z = pooled @ w3[:-1] + w3[-1]
    z -= z.max(axis=1, keepdims=True)
    p = np.exp(z)
    return p / p.sum(axis=1, keepdims=True), [a, h1, b, h2, pooled]


def loss_and_gradient(y: np.ndarray, x: np.ndarray, flat: np.ndarray, shape: Shape) -> np.ndarray:
    """[loss, hits, rows, gradient] summed over the rows."""
    p, (a, h1, b, h2, pooled) = forward(x, flat, shape)
    _, w2, w3 = shape.split(flat)
    loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
    hits = (p.argmax(axis=1) == y).sum()
    d = p.copy()
    d[np.arange(len(y)), y] -= 1
    g3 = np.concatenate([pooled.T @ d, d.sum(axis=0)[None]])
    back = np.repeat((d @ w3[:-1].T)[:, None] / h2.shape[1], h2.shape[1], axis=1) * (h2 > 0)
    g2 = np.concatenate([np.tensordot(b, back, ([0, 1], [0, 1])), back.sum(axis=(0, 1))[None]])
    back = unwindowed(back @ w2[:-1].T, shape.kernel, h1.shape[2]) * (h1 > 0)
    g1 = np.concatenate([np.tensordot(a, back, ([0, 1], [0, 1])), back.sum(axis=(0, 1))[None]])
    return np.concatenate([[loss, hits, len(y)], g1.reshape(-1), g2.reshape(-1), g3.reshape(-1)])


@dataclass
class Convolution:
    classes: list[str]
    shape: Shape
    mean: np.ndarray
    scale: np.ndarray
    state: State


def _blocks(batch: pa.RecordBatch, features: int, steps: int, cell: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(first row, (m, T, F)) of a batch's samples, in blocks of bounded bytes."""
    flat = np.asarray(batch.column("x").flatten().flatten(), dtype=np.float64).reshape(batch.num_rows, features, steps)
    each = max(1, BLOCK_BYTES // (8 * cell))
    for at in range(0, batch.num_rows, each):
        yield at, flat[at : at + each].transpose(0, 2, 1)


def _cell(shape: Shape) -> int:
    return shape.steps * shape.kernel * max(shape.features, *shape.channels)


def _checked(data: DataFrame) -> tuple[int, int]:
    """(features, steps), which all samples share."""
    sizes = data.select(F.size("features").alias("f"), F.transform("features", F.size).alias("t"))
    ends = sizes.agg(F.min("f").alias("f0"), F.max("f").alias("f1"), F.min(F.array_min("t")).alias("t0"), F.max(F.array_max("t")).alias("t1")).first()
    if ends["f0"] is None or ends["f0"] != ends["f1"] or ends["t0"] != ends["t1"]:
        raise ValueError("samples need features of one number and steps of one length")
    return ends["f0"], ends["t0"]


def fit_convolution(data: DataFrame, channels: tuple[int, int] = (64, 64), kernel: int = 3, epochs: int = 10, batches: int = 8, rate: float = 1e-3, seed: int = 42) -> Convolution:
    """Learns on the rows of data(label, features, is_test) that aren't test rows; features is an array of series of one length. Features are scaled by their mean and
    population deviation over samples and steps. The state's history has the training loss and accuracy of each epoch."""
    train = data.where("not is_test and label is not null and features is not null").select(F.col("label").cast("string").alias("label"), F.col("features").cast("array<array<double>>").alias("x"))
    features, steps = _checked(train.select(F.col("x").alias("features")))
    if steps < 2 * kernel - 1:
        raise ValueError(f"{steps} steps are too few for two kernels of {kernel}")
    classes = sorted(r[0] for r in train.select("label").distinct().collect())
    shape = Shape(features, steps, channels, kernel, len(classes))
    y = F.array_position(F.array(*(F.lit(c) for c in classes)), F.col("label")).cast("int") - 1
    rows = train.select(y.alias("y"), "x").withColumn("batch", F.pmod(F.xxhash64("y", "x", F.lit(seed)), F.lit(batches)).cast("int"))
    rows = stored(rows.hint("rebalance", "batch"), "samples", by="batch")
    cell = _cell(shape)

    def moments(stream: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = 0
        for batch in stream:
            for _, x in _blocks(batch, features, steps, cell):
                total = total + np.concatenate([[x.shape[0] * steps], x.sum(axis=(0, 1))])
        return {0: total} if np.ndim(total) else {}

    v = summed(rows.select("x"), moments)[0]
    mean = v[1:] / v[0]

    def squares(stream: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = 0
        for batch in stream:
            for _, x in _blocks(batch, features, steps, cell):
                total = total + ((x - mean) ** 2).sum(axis=(0, 1))
        return {0: total} if np.ndim(total) else {}

    scale = np.sqrt(summed(rows.select("x"), squares)[0] / v[0])
    scale = np.where(scale > 1e-12 * np.maximum(1, np.abs(mean)), scale, 1.0)
    w = shape.start(seed)
    state = State(classes, features, 0, seed, w, np.zeros_like(w), np.zeros_like(w), rate=rate)

    for epoch in range(1, epochs + 1):
        seen = np.zeros(3)
        for b in np.random.default_rng([seed, epoch]).permutation(batches).tolist():
            weights = state.weights

            def parts(stream: Iterator[pa.RecordBatch], weights=weights) -> dict[int, np.ndarray]:
                total = 0
                for batch in stream:
                    y = np.asarray(batch.column("y"))
                    for at, x in _blocks(batch, features, steps, cell):
                        total = total + loss_and_gradient(y[at : at + len(x)], (x - mean) / scale, weights, shape)
                return {0: total} if np.ndim(total) else {}

            v = summed(rows.where(F.col("batch") == b).select("y", "x"), parts).get(0)
            if v is not None and v[2]:
                seen += v[:3]
                adam(state, v[3:] / v[2])
        state.history.append({"epoch": epoch, "train_loss": float(seen[0] / max(1.0, seen[2])), "train_accuracy": float(seen[1] / max(1.0, seen[2]))})
    return Convolution(classes, shape, mean, scale, state)


def convolved(data: DataFrame, fitted: Convolution, keep: Sequence[str] = (), only_test: bool = True) -> DataFrame:
    """label, prediction of the test rows of data(label, features, is_test), and the columns `keep`."""
    shape, mean, scale, weights, classes = fitted.shape, fitted.mean, fitted.scale, fitted.state.weights, np.array(fitted.classes, dtype=object)
    rows = data.where("features is not null" + (" and is_test" if only_test else "")).select(F.col("label").cast("string").alias("label"), *keep, F.col("features").cast("array<array<double>>").alias("x"))
    kept = [f for f in rows.schema.fields if f.name != "x"]

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at, x in _blocks(batch, shape.features, shape.steps, _cell(shape)):
                p, _ = forward((x - mean) / scale, weights, shape)
                part = batch.slice(at, len(x))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(classes[p.argmax(axis=1)], pa.string())], [*(f.name for f in kept), "prediction"])

    return rows.mapInArrow(task, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "prediction string"]))
