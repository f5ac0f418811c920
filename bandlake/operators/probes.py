"""Linear probes: many small logistic regressions over one table, trained together.

A probe is a target class (or all classes at once) and a set of feature positions. One pass over the data gives every probe's loss
and gradient at its trial point: each task sums its rows' parts, the sums are added by probe in two levels, and only they reach the
driver for the next step. Narrow probes (up to MAX_WIDTH coefficients) also sum their Hessians and take Newton steps; wider ones, of any
width, go on by limited-memory quasi-Newton steps on the same passes. The data stays distributed and is read once a step, whatever the
number of probes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bandlake.functions import arrays, bands, transforms
from bandlake.operators import metrics
from bandlake.operators.ranking import group_split, stratified_split
from bandlake.session import small_batches

MAX_WIDTH = 512
MIN_POSITIVES = 10
TASKS = 64
BLOCK, BLOCK_BYTES = 512, 64 << 20


@dataclass(frozen=True)
class Probe:
    """A probe on positions lo..hi - 1 of each (lo, hi): one-vs-rest of `target`, or of all classes (multinomial) if it is None.

    With `width`, features are laid out feature by feature, `width` coefficients each, and the ranges hold in every feature.
    """

    name: str
    target: str | None
    ranges: tuple[tuple[int, int], ...]
    width: int | None = None
    n_features: int = 1

    def positions(self) -> np.ndarray:
        k = np.unique(np.concatenate([np.arange(lo, hi) for lo, hi in self.ranges]))
        return k if self.width is None else (np.arange(self.n_features)[:, None] * self.width + k).reshape(-1)


@dataclass
class Fitted:
    """Scaled-space coefficients of each probe (the last of a row is the intercept; a multinomial probe has a row a class) and the scaling."""

    probes: list[Probe]
    weights: list[np.ndarray]
    mean: np.ndarray
    scale: np.ndarray
    skipped: list[str] = field(default_factory=list)
    classes: list[str] = field(default_factory=list)


class Descent:
    """Limited-memory BFGS with backtracking, a pass at a time: `trial` is where the next pass evaluates."""

    def __init__(self, start: np.ndarray, memory: int = 10):
        self.at, self.trial, self.memory = start, start, memory
        self.loss, self.gradient = np.inf, None
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.length, self.slope = 1.0, 0.0

    def tell(self, loss: float, gradient: np.ndarray, tolerance: float) -> bool:
        """Takes the trial's loss and gradient; True when converged."""
        if self.gradient is not None and not loss <= self.loss + 1e-4 * self.length * self.slope:
            self.length *= 0.5
            if self.length < 1e-10:
                return True
            self.trial = self.at + self.length * self.direction
            return False
        if self.gradient is not None:
            s, y = self.trial - self.at, gradient - self.gradient
            if s @ y > 1e-12 * (y @ y):
                self.steps = [*self.steps[1 - self.memory :], (s, y)] if len(self.steps) >= self.memory else [*self.steps, (s, y)]
        self.at, self.loss, self.gradient = self.trial, loss, gradient
        if np.abs(gradient).max(initial=0) <= tolerance:
            return True
        q, used = gradient.copy(), []
        for s, y in reversed(self.steps):
            a = (s @ q) / (s @ y)
            used.append(a)
            q -= a * y
        if self.steps:
            s, y = self.steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(self.steps, reversed(used), strict=True):
            q += s * (a - (y @ q) / (s @ y))
        self.direction, self.slope = -q, -float(q @ gradient)
        self.length = 1.0 if self.steps else min(1.0, 1.0 / max(1e-30, float(np.abs(gradient).sum())))
        self.trial = self.at + self.length * self.direction
        return False


def summed(rows: DataFrame, parts) -> dict[int, np.ndarray]:
    """Sums of {number: vector} that `parts` makes of a task's batches, added by number on the executors: over TASKS tasks at a time, then over all. The driver receives a vector a
    number, however many tasks there are."""

    each = TASKS

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = parts(stream)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([TaskContext.get().partitionId() // each] * len(sums), pa.int64()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["probe", "slot", "v"])

    def add(t: pa.Table) -> pa.Table:
        total = np.frombuffer(t["v"][0].as_py()).copy()
        for x in t["v"][1:]:
            total += np.frombuffer(x.as_py())
        return pa.table({"probe": t["probe"][:1], "slot": t["slot"][:1], "v": pa.array([total.tobytes()], pa.binary())})

    shape = "probe long, slot long, v binary"
    found = rows.mapInArrow(task, shape).groupBy("probe", "slot").applyInArrow(add, shape).groupBy("probe").applyInArrow(add, shape)
    with small_batches(rows.sparkSession):
        return {r["probe"]: np.frombuffer(r["v"]) for r in found.collect()}


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    width = len(batch.column("features").flatten()) // max(1, batch.num_rows)
    each = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, width))))
    for at in range(0, batch.num_rows, each):
        yield batch.slice(at, each)


def _matrix(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(labels, features) of a batch in blocks of rows, of BLOCK_BYTES at most."""
    for part in _slices(batch):
        yield np.array(part.column("label").to_pylist(), dtype=object), np.asarray(part.column("features").flatten(), dtype=np.float64).reshape(part.num_rows, -1)


def flatten_samples(df: DataFrame, sample: str, label: str, at: Sequence[str], series: str = "series") -> DataFrame:
    """One row a sample: its label and its series one after the other (`features`), ordered by the columns `at` (feature, or layer and feature)."""
    parts = F.array_sort(F.collect_list(F.struct(*at, arrays.doubles(series).alias("_x"))))
    return df.groupBy(sample, label).agg(F.flatten(F.transform(parts, lambda p: p["_x"])).alias("features"))


def split_features(df: DataFrame, label: str, id_col: str, features: str, test_size: float = 0.2, seed: int = 42, group: str | None = None) -> DataFrame:
    """(label, features, is_test) with a stratified split, or one of whole groups; rows without label or features are left out."""
    some = df.where(F.col(label).isNotNull() & F.col(features).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(id_col).alias("id"), *([F.col(group).alias("group")] if group else []), arrays.doubles(features).alias("features"))
    split = group_split(some, "group", test_size, seed) if group else stratified_split(some, "label", "id", test_size, seed)
    return split.select("label", "features", "is_test")


def _scaling(train: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Means and population deviations of the features (two passes); constant features have deviation 1."""

    def first(stream: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = 0
        for batch in stream:
            for _, x in _matrix(batch):
                total = total + np.append(x.sum(axis=0), len(x))
        return {0: total} if np.ndim(total) else {}

    sums = summed(train, first).get(0, np.zeros(1))
    mean = sums[:-1] / max(1.0, sums[-1])

    def second(stream: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = 0
        for batch in stream:
            for _, x in _matrix(batch):
                total = total + ((x - mean) ** 2).sum(axis=0)
        return {0: total} if np.ndim(total) else {}

    dev = np.sqrt(summed(train, second).get(0, np.zeros(len(mean))) / max(1.0, sums[-1]))
    return mean, np.where(dev > 1e-12 * np.maximum(1, np.abs(mean)), dev, 1.0)


def _part(xs: np.ndarray, y: np.ndarray, s: np.ndarray, w: np.ndarray, hessian: bool) -> np.ndarray:
    """[loss, gradient, Hessian] of weighted rows: y is 0 or 1 for a row of w, or a one-hot table for one row of w a class."""
    if len(w) == 1:
        z = xs @ w[0]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        loss = (s * np.logaddexp(0, np.where(y > 0, -z, z))).sum()
        gradient = xs.T @ (s * (p - y))
        return np.concatenate([[loss], gradient, (xs.T @ (xs * (s * p * (1 - p))[:, None])).reshape(-1) if hessian else []])
    z = xs @ w.T
    z -= z.max(axis=1, keepdims=True)
    total = np.log(np.exp(z).sum(axis=1, keepdims=True))
    p = np.exp(z - total)
    loss = (s[:, None] * y * (total - z)).sum()
    gradient = (s[:, None] * (p - y)).T @ xs
    if not hessian:
        return np.concatenate([[loss], gradient.reshape(-1)])
    c, d = w.shape
    h = np.zeros((c, d, c, d))
    for a in range(c):
        for b in range(a, c):
            h[a, :, b] = xs.T @ (xs * (s * p[:, a] * ((a == b) - p[:, b]))[:, None])
            h[b, :, a] = h[a, :, b].T
    return np.concatenate([[loss], gradient.reshape(-1), h.reshape(-1)])


def fit_probes(data: DataFrame, probes: Sequence[Probe], scale: bool = True, balanced: bool = True, c: float = 1.0, steps: int = 200, tolerance: float = 1e-7, min_positives: int = MIN_POSITIVES, max_width: int = MAX_WIDTH) -> Fitted:
    """L2-regularised logistic regressions (the intercept is free) of any width, by steps that all probes share.

    Scaling uses population deviations of the training rows, constant features keep scale 1. Probes whose target has fewer
    than min_positives rows, or all rows, are skipped and named in the result; so are multinomial ones of fewer than two classes. Newton steps end when no coefficient moves by
    more than `tolerance`, quasi-Newton ones when no mean derivative is above it. Every step reads the rows, so they are held for the steps unless the caller holds them.
    """
    held = data.storageLevel.useMemory or data.storageLevel.useDisk
    data = data if held else data.persist()
    try:
        return _fit(data, probes, scale, balanced, c, steps, tolerance, min_positives, max_width)
    finally:
        if not held:
            data.unpersist()


def _fit(data: DataFrame, probes: Sequence[Probe], scale: bool, balanced: bool, c: float, steps: int, tolerance: float, min_positives: int, max_width: int) -> Fitted:
    train = data.where(~F.col("is_test")).select("label", "features")
    counts = {r["label"]: (r["n"], r["train"]) for r in data.groupBy("label").agg(F.count("*").alias("n"), F.sum((~F.col("is_test")).cast("int")).alias("train")).collect()}
    classes = sorted(k for k, (_, t) in counts.items() if t)
    total = sum(t for _, t in counts.values())
    fits = lambda p: len(classes) > 1 if p.target is None else counts.get(p.target, (0, 0))[0] >= min_positives and 0 < counts[p.target][1] < total
    fit = [p for p in probes if fits(p)]
    skipped = [p.name for p in probes if not fits(p)]
    mean, dev = _scaling(train)
    if not scale:
        mean, dev = np.zeros_like(mean), np.ones_like(dev)
    at = [p.positions() for p in fit]
    start = [np.zeros((1 if p.target is not None else len(classes), len(x) + 1)) for p, x in zip(fit, at, strict=True)]
    newton = [w.size <= max_width for w in start]
    state = [Descent(w.reshape(-1)) for w in start]
    share = []
    for p in fit:
        pos = counts[p.target][1] if p.target is not None else 0
        each = [total / (2 * pos), total / (2 * (total - pos))] if pos else [total / (len(classes) * counts[k][1]) for k in classes]
        share.append(each if balanced else [1.0] * len(each))
    ridge = [np.tile(np.append(np.full(w.shape[1] - 1, 1 / c), 1e-9 if len(w) == 1 else 1e-6), len(w)) for w in start]
    open_ = list(range(len(fit)))
    sc = data.sparkSession.sparkContext

    for _ in range(steps):
        if not open_:
            break
        now = [(i, fit[i].target, at[i], state[i].trial.reshape(start[i].shape), share[i], newton[i]) for i in open_]
        shared = sc.broadcast(pickle.dumps((mean, dev, classes, now)))

        def parts(stream: Iterator[pa.RecordBatch], shared=shared) -> dict[int, np.ndarray]:
            mean, dev, classes, now = pickle.loads(shared.value)
            sums: dict[int, np.ndarray] = {}
            for batch in stream:
                for label, x in _matrix(batch):
                    x = (x - mean) / dev
                    hot = (label[:, None] == np.array(classes, dtype=object)).astype(float)
                    for i, target, pos, w, each, hessian in now:
                        xs = np.concatenate([x[:, pos], np.ones((len(x), 1))], axis=1)
                        y = hot if target is None else (label == target).astype(float)
                        s = hot @ np.array(each) if target is None else np.where(y > 0, *each)
                        sums[i] = sums.get(i, 0) + _part(xs, y, s, w, hessian)
            return sums

        found = summed(train, parts)
        shared.destroy()
        still = []
        for i in open_:
            v, d, n = found[i], state[i], start[i].size
            loss, g = v[0] + 0.5 * float(ridge[i] @ d.trial**2), v[1 : n + 1] + ridge[i] * d.trial
            if newton[i]:
                step = np.linalg.solve(v[n + 1 :].reshape(n, n) + np.diag(ridge[i]), g)
                step *= min(1.0, 4.0 / (np.abs(step).max() + 1e-30))
                d.at = d.trial = d.trial - step
                done = np.abs(step).max() <= tolerance
            else:
                done = d.tell(loss / total, g / total, tolerance)
            if not done:
                still.append(i)
        open_ = still
    return Fitted(fit, [d.at.reshape(w.shape) for d, w in zip(state, start, strict=True)], mean, dev, skipped, classes)


def _decisions(fitted: Fitted, x: np.ndarray) -> Iterator[tuple[Probe, np.ndarray]]:
    """Each probe's decision on scaled rows: whether it is the target, or the class."""
    for p, w in zip(fitted.probes, fitted.weights, strict=True):
        z = x[:, p.positions()] @ w[:, :-1].T + w[:, -1]
        yield p, np.array(fitted.classes, dtype=object)[z.argmax(axis=1)] if p.target is None else z[:, 0] > 0


def evaluate(data: DataFrame, fitted: Fitted) -> DataFrame:
    """probe, target, accuracy, chance and n of the test rows, in one pass. The chance of a multinomial probe is one among its classes."""
    shared = data.sparkSession.sparkContext.broadcast(fitted)

    def parts(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        rows = {p.name: [p.target, 0, 0.0, 0] for p in fitted.probes}
        for batch in stream:
            for label, x in _matrix(batch):
                for p, said in _decisions(fitted, (x - fitted.mean) / fitted.scale):
                    row = rows[p.name]
                    y = label == p.target
                    row[1] += int((said == (label if p.target is None else y)).sum())
                    row[2] += len(label) / len(fitted.classes) if p.target is None else int(y.sum())
                    row[3] += len(label)
        yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.string()), pa.array([r[0] for r in rows.values()], pa.string()), *(pa.array([r[i] for r in rows.values()], t) for i, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64())))], ["probe", "target", "hits", "positives", "n"])

    found = data.where("is_test").select("label", "features").mapInArrow(parts, "probe string, target string, hits long, positives double, n long")
    added = found.groupBy("probe", "target").agg(*(F.sum(c).alias(c) for c in ("hits", "positives", "n")))
    return added.select("probe", "target", (F.col("hits") / F.col("n")).alias("accuracy"), (F.col("positives") / F.col("n")).alias("chance"), "n")


def predictions(data: DataFrame, fitted: Fitted, keep: Sequence[str] = (), only_test: bool = True) -> DataFrame:
    """probe, label, prediction (the class; of a one-vs-rest probe its target or 'rest') of the test rows, and the columns `keep`."""
    shared = data.sparkSession.sparkContext.broadcast(fitted)
    kept = [f for f in data.schema.fields if f.name in keep]

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in stream:
            for part in _slices(batch):
                for label, x in _matrix(part):
                    for p, said in _decisions(fitted, (x - fitted.mean) / fitted.scale):
                        said = said if p.target is None else np.where(said, p.target, "rest")
                        yield pa.RecordBatch.from_arrays([pa.array([p.name] * len(label)), pa.array(label, pa.string()), pa.array(said, pa.string()), *(part.column(f.name) for f in kept)], ["probe", "label", "prediction", *(f.name for f in kept)])

    shape = ", ".join(["probe string, label string, prediction string", *(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)])
    rows = data.where("is_test") if only_test else data
    return rows.select("label", "features", *(f.name for f in kept)).mapInArrow(task, shape)


def coefficients(data: DataFrame, fitted: Fitted, n_features: int = 1) -> DataFrame:
    """probe, feature_idx, k, weight: of features laid out feature by feature; multinomial probes' names are followed by | and the class."""
    width = len(fitted.mean) // n_features
    rows = []
    for p, ws in zip(fitted.probes, fitted.weights, strict=True):
        names = [p.name] if p.target is not None else [f"{p.name}|{k}" for k in fitted.classes]
        rows += [(name, int(i) // width, int(i) % width, float(v)) for name, w in zip(names, ws, strict=True) for i, v in zip(p.positions(), w, strict=False)]
    return data.sparkSession.createDataFrame(rows, "probe string, feature_idx int, k int, weight double")


def labels_of(data: DataFrame) -> list[str]:
    return sorted(r[0] for r in data.select("label").distinct().collect())


def _width(data: DataFrame) -> int:
    return data.select(F.max(F.size("features"))).first()[0] or 0


def band_layout_probes(targets: Sequence[str | None], width: int, layout: Sequence[tuple[int, int]], n_features: int = 1) -> list[Probe]:
    """For each target the full, single-band and cumulative probes; names are target|kind|number."""
    every = []
    for t in targets:
        shape = (width, n_features)
        every.append(Probe(f"{t}|full|0", t, ((0, width),), *shape))
        every += [Probe(f"{t}|band|{i}", t, (b,), *shape) for i, b in enumerate(layout)]
        every += [Probe(f"{t}|cumulative|{i}", t, ((0, b[1]),), *shape) for i, b in enumerate(layout)]
    return every


def probe_bands_of(data: DataFrame, width: int, layout: Sequence[tuple[int, int]], targets: Sequence[str | None], n_features: int = 1, **fit) -> DataFrame:
    """Accuracies of (label, features, is_test): the full spectrum, each band, cumulative bands and AUTO (the best cumulative one) for each target."""
    data = data.persist()
    try:
        found = evaluate(data, fit_probes(data, band_layout_probes(targets, width, layout, n_features), **fit)).collect()
    finally:
        data.unpersist()
    rows = [(r["probe"].rsplit("|", 2)[0], *r["probe"].rsplit("|", 2)[1:], r["accuracy"], r["chance"], r["n"]) for r in found]
    best: dict[str, tuple] = {}
    for r in rows:
        if r[1] == "cumulative" and (r[0] not in best or (r[3], -int(r[2])) > (best[r[0]][3], -int(best[r[0]][2]))):
            best[r[0]] = r
    rows += [(t, "auto", r[2], *r[3:]) for t, r in best.items()]
    out = data.sparkSession.createDataFrame(rows, "target string, kind string, band string, accuracy double, chance double, n long")
    return out.withColumn("band", F.col("band").cast("int"))


def band_probe(df: DataFrame, label: str, id_col: str, series: str = "series", transform: str = "fft", band_width: int = 4, targets: Sequence[str] | None = None, window: str | None = None, seed: int = 42, feature: str | None = None, min_positives: int = MIN_POSITIVES) -> DataFrame:
    """Accuracies of the full spectrum, of each band, of cumulative bands and AUTO (the best cumulative one) for each target.

    A sample is one series, or with `feature` all series of an id, whose coefficients are flattened: a band then holds its coefficients of every feature.
    """
    x = transforms.apply_transform(arrays.doubles(series), transform, window)
    if feature is None:
        spectra, n_features = df.select(label, id_col, x.alias("features")), 1
    else:
        spectra = flatten_samples(df.select(id_col, label, feature, x.alias("series")), id_col, label, [feature])
        n_features = df.select(feature).distinct().count()
    data = split_features(spectra, label, id_col, "features", seed=seed)
    width = _width(data) // max(1, n_features)
    return probe_bands_of(data, width, bands.equal_width(width, band_width), targets or labels_of(data), n_features, min_positives=min_positives)


def bin_profiles(df: DataFrame, label: str, id_col: str, series: str = "series", transform: str = "fft", targets: Sequence[str] | None = None, seed: int = 42, min_positives: int = MIN_POSITIVES) -> DataFrame:
    """Accuracy of a probe on each single coefficient, for each target: target, k, accuracy, chance, n."""
    data = split_features(df.select(label, id_col, transforms.apply_transform(arrays.doubles(series), transform).alias("features")), label, id_col, "features", seed=seed).persist()
    try:
        wanted = [Probe(f"{t}|{k}", t, ((k, k + 1),)) for t in targets or labels_of(data) for k in range(_width(data))]
        found = evaluate(data, fit_probes(data, wanted, min_positives=min_positives))
        parts = F.split("probe", r"\|")
        rows = found.select("target", F.element_at(parts, -1).cast("int").alias("k"), "accuracy", "chance", "n").collect()
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "target string, k int, accuracy double, chance double, n long")


def variant_probes(df: DataFrame, label: str, id_col: str, variants: dict[str, str], targets: Sequence[str | None] | None = None, scale: bool = True, seed: int = 42, min_positives: int = MIN_POSITIVES) -> DataFrame:
    """Full-width probes on several feature columns of one table (windows, lanes, layers, banks, with and without mean), on one split and in the
    same passes. targets of [None] make multinomial probes."""
    names = list(variants)
    some = df.where(" and ".join(f"`{variants[n]}` is not null" for n in names))
    sizes = some.agg(*(F.max(F.size(variants[n])).alias(n) for n in names)).first()
    data = split_features(some.select(label, id_col, F.concat(*(arrays.doubles(variants[n]) for n in names)).alias("_all")), label, id_col, "_all", seed=seed).persist()
    try:
        ends = np.cumsum([sizes[n] or 0 for n in names]).tolist()
        spans = dict(zip(names, zip([0, *ends[:-1]], ends, strict=True), strict=True))
        wanted = [Probe(f"{n}|{t}", t, (spans[n],)) for n in names for t in (targets or labels_of(data)) if spans[n][1] > spans[n][0]]
        rows = [(r["probe"].split("|", 1)[0], r["target"], r["accuracy"], r["chance"], r["n"]) for r in evaluate(data, fit_probes(data, wanted, scale=scale, min_positives=min_positives)).collect()]
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "variant string, target string, accuracy double, chance double, n long")


def feature_probes(df: DataFrame, label: str, id_col: str, series: str = "series", banks: int = 12, seed: int = 42) -> DataFrame:
    """Multinomial probes on the series, its cosine coefficients, and their mel, logarithmic and wavelet features: variant, accuracy, chance, n."""
    x = arrays.doubles(series)
    n = df.select(F.max(F.size(series))).first()[0] or 0
    c = F.col("dct")
    columns = {"mel": transforms.filter_bank(c, bands.mel_filter_bank(n, banks)), "log": transforms.filter_bank(c, bands.log_filter_bank(n, banks)), "haar": arrays.haar(c)}
    wide = df.select(label, id_col, x.alias("time"), transforms.dct(x).alias("dct")).select("*", *(v.alias(k) for k, v in columns.items()))
    columns = {"time": None, "dct": None} | columns
    return variant_probes(wide, label, id_col, {k: k for k in columns}, [None], seed=seed).drop("target")


def layer_probes(df: DataFrame, label: str, id_col: str, layer: str, at: Sequence[str] = (), series: str = "series", transform: str = "fft", targets: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """A full-spectrum probe of every layer and target, trained together: layer, target, accuracy, chance, n. Every sample has every layer."""
    x = transforms.apply_transform(arrays.doubles(series), transform)
    layers = sorted(r[0] for r in df.select(layer).distinct().collect())
    flat = flatten_samples(df.select(id_col, label, layer, *at, x.alias("series")), id_col, label, [layer, *at])
    data = split_features(flat, label, id_col, "features", seed=seed).persist()
    try:
        width = _width(data) // max(1, len(layers))
        wanted = [Probe(f"{i}|{t}", t, ((i * width, (i + 1) * width),)) for i in range(len(layers)) for t in targets or labels_of(data)]
        rows = [(layers[int(r["probe"].split("|", 1)[0])], r["target"], r["accuracy"], r["chance"], r["n"]) for r in evaluate(data, fit_probes(data, wanted)).collect()]
    finally:
        data.unpersist()
    return df.sparkSession.createDataFrame(rows, "layer int, target string, accuracy double, chance double, n long")


def resolve_layers(wanted: Sequence[int], n_layers: int) -> list[int]:
    """Layer numbers in order, each once; negative ones count from the last."""
    found = sorted({i + n_layers if i < 0 else i for i in wanted})
    if found and not 0 <= found[0] <= found[-1] < n_layers:
        raise ValueError(f"layers {wanted} of {n_layers}")
    return found


def multinomial_probe(data: DataFrame, positions: Sequence[tuple[int, int]] | None = None, scale: bool = True, balanced: bool = True) -> DataFrame:
    """label, prediction of the test rows of (label, features, is_test)."""
    ranges = tuple(positions) if positions is not None else ((0, _width(data)),)
    return predictions(data, fit_probes(data, [Probe("all", None, ranges)], scale=scale, balanced=balanced)).select("label", "prediction")


def group_probe(df: DataFrame, label: str, id_col: str, group: str, features: str, test_size: float = 0.2, seed: int = 42) -> DataFrame:
    """Predictions of an unscaled multinomial probe whose test rows are whole groups (tracks): label, prediction."""
    return multinomial_probe(split_features(df, label, id_col, features, test_size, seed, group), scale=False, balanced=False)


def pair_probes(data: DataFrame, layout: Sequence[tuple[int, int]]) -> DataFrame:
    """Accuracy of every band and pair of bands (multinomial, trained together), with the gain over the better of the two."""
    pairs = {f"{a}|{b}": Probe(f"{a}|{b}", None, tuple(sorted({layout[a], layout[b]}))) for a in range(len(layout)) for b in range(a, len(layout))}
    found = {tuple(map(int, r["probe"].split("|"))): r["accuracy"] for r in evaluate(data, fit_probes(data, list(pairs.values()))).collect()}
    rows = [(a, b, v, v - max(found[a, a], found[b, b])) for (a, b), v in found.items()]
    return data.sparkSession.createDataFrame(rows, "band_a int, band_b int, accuracy double, gain double")


def greedy_bands(data: DataFrame, layout: Sequence[tuple[int, int]], target: str) -> DataFrame:
    """Bands ranked by their own accuracy, then added in that order: step, band, accuracy of the set so far."""
    single = {int(r["probe"]): r["accuracy"] for r in evaluate(data, fit_probes(data, [Probe(str(i), target, (b,)) for i, b in enumerate(layout)])).collect()}
    order = sorted(single, key=lambda i: (-single[i], i))
    sets = [Probe(str(s), target, tuple(layout[i] for i in order[: s + 1])) for s in range(len(order))]
    found = {int(r["probe"]): r["accuracy"] for r in evaluate(data, fit_probes(data, sets)).collect()}
    return data.sparkSession.createDataFrame([(s, b, single[b], found[s]) for s, b in enumerate(order)], "step int, band int, own_accuracy double, accuracy double")


def band_confusions(data: DataFrame, layout: Sequence[tuple[int, int]]) -> DataFrame:
    """Confusion tables of the multinomial probes of each band, trained together: band, y_true, y_pred, n. A band on its own is the masked spectrum,
    as coefficients that are the same everywhere add nothing."""
    said = predictions(data, fit_probes(data, [Probe(str(i), None, (b,)) for i, b in enumerate(layout)])).persist()
    try:
        out = None
        for i in range(len(layout)):
            table = metrics.confusion(said.where(F.col("probe") == str(i)), "label", "prediction").withColumn("band", F.lit(i))
            out = table if out is None else out.unionByName(table)
        rows = out.collect()  # classes squared a band
    finally:
        said.unpersist()
    return data.sparkSession.createDataFrame(rows, out.schema)


def confusion_relations(df: DataFrame, label: str, id_col: str, series: str = "series", transform: str = "fft", n_bands: int = 8, feature: str | None = None, seed: int = 42) -> DataFrame:
    """Confusion tables of multinomial probes on the series over time, on their whole spectrum and on each of n_bands bands, trained together on one split: variant (time, spectrum,
    band), band, target, y_true, y_pred, n, row, column. Every table is there once for each class, which is put first."""
    x = arrays.doubles(series)
    both = F.concat(x, transforms.apply_transform(x, transform))
    if feature is None:
        flat, n_features = df.select(label, id_col, both.alias("features")), 1
    else:
        flat = flatten_samples(df.select(id_col, label, feature, both.alias("series")), id_col, label, [feature])
        n_features = df.select(feature).distinct().count()
    data = split_features(flat, label, id_col, "features", seed=seed).persist()
    try:
        steps = df.select(F.max(F.size(series))).first()[0] or 0
        width = _width(data) // max(1, n_features)
        spans = {"time|-1": (0, steps), "spectrum|-1": (steps, width)} | {f"band|{i}": (steps + lo, steps + hi) for i, (lo, hi) in enumerate(bands.equal_count(width - steps, n_bands))}
        fitted = fit_probes(data, [Probe(n, None, (s,), width, n_features) for n, s in spans.items() if s[1] > s[0]])
        said = predictions(data, fitted).groupBy("probe", "label", "prediction").agg(F.count("*").alias("n")).collect()  # classes squared a probe
    finally:
        data.unpersist()
    counts: dict[str, dict[tuple[str, str], int]] = {}
    for r in said:
        counts.setdefault(r["probe"], {})[r["label"], r["prediction"]] = r["n"]
    rows = []
    for name, table in counts.items():
        labels = sorted({x for pair in table for x in pair})
        rows += [(name.split("|")[0], int(name.split("|")[1]), a, b, table.get((a, b), 0)) for a in labels for b in labels]
    tables = df.sparkSession.createDataFrame(rows, "variant string, band int, y_true string, y_pred string, n long")
    return metrics.targets_first(tables, ["variant", "band"])


def band_mean_probes(df: DataFrame, label: str, id_col: str, series: str = "series", band_width: int = 4, feature: str | None = None, seed: int = 42, min_positives: int = MIN_POSITIVES) -> DataFrame:
    """For each class with min_positives samples, one-vs-rest probes on the mean magnitude of every band (of every feature): label, n, accuracy, band, magnitude (the class's mean over
    samples and features) and weight (the mean absolute weight over features, scaled to 0..1 within the class)."""
    n = df.select(F.max(F.size(series))).first()[0] or 0
    layout = bands.equal_width(n // 2 + 1, band_width)
    if not layout:
        raise ValueError(f"no whole band of {band_width} in {n // 2 + 1} coefficients")
    m = transforms.rfft_magnitude(arrays.doubles(series))
    some = df.where(F.col(label).isNotNull()).select(id_col, label, *([feature] if feature else []), m.alias("_m"))
    means = some.withColumn("series", F.array(*(arrays.mean(arrays.band_slice(F.col("_m"), lo, hi)) for lo, hi in layout)))
    flat = flatten_samples(means, id_col, label, [feature] if feature else [])
    data = split_features(flat, label, id_col, "features", seed=seed).persist()
    try:
        width = _width(data)
        fitted = fit_probes(data, [Probe(t, t, ((0, width),)) for t in labels_of(data)], min_positives=min_positives)
        found = {r["target"]: r["accuracy"] for r in evaluate(data, fitted).collect()}
        weights = coefficients(data, fitted, width // len(layout))
    finally:
        data.unpersist()
    per = weights.groupBy(F.col("probe").alias("label"), F.col("k").alias("band")).agg(F.avg(F.abs("weight")).alias("w"))
    ends = Window.partitionBy("label")
    lo, hi = F.min("w").over(ends), F.max("w").over(ends)
    per = per.withColumn("weight", F.when(hi > lo, (F.col("w") - lo) / (hi - lo)).otherwise(0.0)).drop("w")
    profile = means.select(F.col(label).cast("string").alias("label"), id_col, F.posexplode("series").alias("band", "v")).groupBy("label", "band").agg(F.avg("v").alias("magnitude"), F.countDistinct(id_col).alias("n"))
    scores = df.sparkSession.createDataFrame(list(found.items()), "label string, accuracy double")
    return profile.join(scores, "label").join(per, ["label", "band"]).select("label", "n", "accuracy", "band", "magnitude", "weight")


def run_pipeline(df: DataFrame, config: dict) -> DataFrame:
    """A probe described by a configuration, as rows metric, target, value.

    Keys: label, id; series, feature, transform, window, band_width, targets, seed; probe (bands, full or multiclass); min_samples (labels with fewer samples are left out).
    """
    known = {"label", "id", "series", "feature", "transform", "window", "band_width", "targets", "seed", "probe", "min_samples"}
    if unknown := sorted(set(config) - known):
        raise ValueError(f"unknown keys {unknown}: known are {sorted(known)}")
    label, id_col, probe = config["label"], config["id"], config.get("probe", "bands")
    if probe not in ("bands", "full", "multiclass"):
        raise ValueError(f"unknown probe {probe!r}")
    enough = df.groupBy(label).agg(F.countDistinct(id_col).alias("_n")).where(F.col("_n") >= config.get("min_samples", MIN_POSITIVES)).select(label)
    some = df.join(enough, label, "left_semi")
    series, transform, window = config.get("series", "series"), config.get("transform", "fft"), config.get("window")
    seed, targets, feature = config.get("seed", 42), config.get("targets"), config.get("feature")
    if probe == "multiclass":
        x = transforms.apply_transform(arrays.doubles(series), transform, window)
        flat = flatten_samples(some.select(id_col, label, *([feature] if feature else []), x.alias("series")), id_col, label, [feature] if feature else [])
        found = metrics.scores(metrics.confusion(multinomial_probe(split_features(flat, label, id_col, "features", seed=seed)), "label", "prediction"))
        return found.select(F.lit(None).cast("string").alias("target"), F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("accuracy", "macro_f1", "weighted_f1"))))).select("metric", "target", "value")
    found = band_probe(some, label, id_col, series, transform, config.get("band_width", 4), targets, window, seed, feature, config.get("min_samples", MIN_POSITIVES))
    if probe == "full":
        found = found.where("kind = 'full'")
    return found.select(F.concat_ws("_", "kind", "band").alias("metric"), "target", F.col("accuracy").alias("value"))


def cluster_positions(df: DataFrame, key: str, vector: str, k: int = 8, seed: int = 42) -> DataFrame:
    """k-means clusters of the rows' arrays: key, cluster."""
    ready = df.select(key, array_to_vector(vector).alias("features"))
    return KMeans(k=k, seed=seed).fit(ready).transform(ready).select(key, F.col("prediction").alias("cluster"), vector_to_array("features").alias("features"))
