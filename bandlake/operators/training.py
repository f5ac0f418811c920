"""Training loop of token classifiers, with a frequency filter learnt or none: mini-batches, Adam, halving on plateaus, early stop, stored states.

Rows are dealt to mini-batches by a hash and stored by batch, so a step reads its batch alone; tasks sum the gradient of their rows, and the driver, which holds
only the parameters and their moments, takes the step. A state is stored after every epoch, and a run can go on from the newest one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlake.functions import transforms
from bandlake.operators import encoding
from bandlake.operators.probes import Descent, summed
from bandlake.session import stored

BLOCK_BYTES = 16 << 20
#: Pieces of a file: of fewer a batch has fewer files than there are cores, and no file has more.
LEAST_PIECES, MOST_PIECES = 20_000, 1_000_000
#: The column that says of how many tokens pooled series are the mean.
POOLED = "pooled_from"
BETAS, EPSILON, THRESHOLD = (0.9, 0.999), 1e-8, 1e-4
HISTORY = "epoch int, train_loss double, train_accuracy double, valid_loss double, valid_accuracy double, rate double, best boolean"


@dataclass
class State:
    """All that a run needs to go on."""

    classes: list[str]
    dims: int
    filter_size: int
    seed: int
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    step: int = 0
    rate: float = 1e-3
    plateau: float = float("inf")
    history: list[dict] = field(default_factory=list)

    @property
    def filter(self) -> np.ndarray:
        return self.weights[: self.filter_size]

    @property
    def classifier(self) -> np.ndarray:
        """(classes, dimensions + 1), the last column is the intercept."""
        return self.weights[self.filter_size :].reshape(len(self.classes), self.dims + 1)

    @property
    def best_epoch(self) -> int | None:
        """The last of the epochs with the smallest validation loss."""
        losses = [h["valid_loss"] for h in self.history]
        return max(h["epoch"] for h in self.history if h["valid_loss"] == min(losses)) if losses else None


def fresh_state(classes: Sequence[str], dims: int, filter_size: int, seed: int, rate: float) -> State:
    """Weights uniform within 1 / sqrt(dims), a filter of ones."""
    bound = 1 / np.sqrt(max(1, dims))
    start = np.random.default_rng(seed).uniform(-bound, bound, len(classes) * (dims + 1))
    w = np.concatenate([np.ones(filter_size), start])
    return State(list(classes), dims, filter_size, seed, w, np.zeros_like(w), np.zeros_like(w), rate=rate)


def stacked(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[np.ndarray, np.ndarray, int | None]]:
    """(labels (m, n), features (m, dims, n), of how many tokens a series is the mean) of a batch's rows of one length, in blocks of bounded bytes; None for series that are not pooled."""
    inner = batch.column("x").flatten()
    flat = np.asarray(inner.flatten(), dtype=np.float64)
    y = np.asarray(batch.column("y").flatten())
    n = np.asarray(pa.compute.list_value_length(batch.column("y"))).astype(np.int64)
    at_y, at_x = np.cumsum(n) - n, (np.cumsum(n) - n) * dims
    tokens = np.asarray(batch.column(POOLED)).astype(np.int64) if POOLED in batch.schema.names else np.zeros(len(n), np.int64)
    for size, of in np.unique(np.stack([n, tokens], 1)[n > 0], axis=0).tolist():
        rows = np.flatnonzero((n == size) & (tokens == of))
        each = max(1, BLOCK_BYTES // (8 * dims * int(size)))
        for k in range(0, len(rows), each):
            some = rows[k : k + each]
            yield y[at_y[some][:, None] + np.arange(size)], flat[at_x[some][:, None] + np.arange(dims * size)].reshape(len(some), dims, size), of or None


def loss_and_gradient(y: np.ndarray, x: np.ndarray, filter_logits: np.ndarray, classifier: np.ndarray, gradient: bool = True, tokens: int | None = None) -> np.ndarray:
    """[loss, hits, labelled tokens, gradient by the filter, by the classifier] summed over rows of one length. The filter is pooled to the length, then its sigmoid
    taken; labels below 0 don't count. A mean of `tokens` tokens is what their lowest frequency leaves, so the filter of that length acts on it by its first value."""
    n, size = x.shape[2], len(filter_logits)
    if size:
        spectrum = transforms.dct_rows(x)
        open_ = transforms.openness(filter_logits, tokens or n, True)[:n]
        x = transforms.inverse_dct_rows(spectrum * open_)
    z = np.einsum("mdn,cd->mnc", x, classifier[:, :-1], optimize=True) + classifier[:, -1]
    z -= z.max(axis=2, keepdims=True)
    p = np.exp(z)
    p /= p.sum(axis=2, keepdims=True)
    known = y >= 0
    right = np.maximum(y, 0)
    loss = -np.log(np.maximum(np.take_along_axis(p, right[:, :, None], 2)[:, :, 0], 1e-300))[known].sum()
    hits = ((p.argmax(axis=2) == y) & known).sum()
    if not gradient:
        return np.array([loss, hits, known.sum()], np.float64)
    np.put_along_axis(p, right[:, :, None], np.take_along_axis(p, right[:, :, None], 2) - 1, 2)
    p *= known[:, :, None]
    by_classifier = np.concatenate([np.einsum("mnc,mdn->cd", p, x, optimize=True), p.sum(axis=(0, 1))[:, None]], axis=1)
    by_filter = np.zeros(0)
    if size:
        back = transforms.dct_rows(np.einsum("mnc,cd->mdn", p, classifier[:, :-1], optimize=True))
        by_open = (spectrum * back).sum(axis=(0, 1)) * open_ * (1 - open_)
        by_filter = transforms.unpooled_filter(np.pad(by_open, (0, (tokens or n) - n)), size)
    return np.concatenate([[loss, hits, known.sum()], by_filter, by_classifier.reshape(-1)])


def remade(batch: pa.RecordBatch, encoder: encoding.PieceEncoder) -> Iterator[tuple[np.ndarray, np.ndarray, None]]:
    """stacked() of a batch of pieces, whose hidden states are made here, in blocks of texts of like lengths."""
    ids, special = (pa.compute.struct_field(batch.column("pieces"), n) for n in ("ids", "special"))
    sizes = np.asarray(pa.compute.list_value_length(ids)).astype(np.int64)
    n = np.asarray(pa.compute.list_value_length(batch.column("y"))).astype(np.int64)
    flat, special, y = np.asarray(ids.flatten()).astype(np.int64), special.flatten().to_numpy(zero_copy_only=False).astype(bool), np.asarray(batch.column("y").flatten())
    at, at_y, dims = np.cumsum(sizes) - sizes, np.cumsum(n) - n, encoder.vectors.shape[1]
    order = np.lexsort((sizes, n))
    for first, count in encoding.blocks(sizes[order], 8 * dims):
        some = order[first : first + count]
        places = np.repeat(at[some] - np.cumsum(sizes[some]) + sizes[some], sizes[some]) + np.arange(sizes[some].sum())
        found, _ = encoder.content_states(flat[places], sizes[some], special[places])
        for size in np.unique(n[some]):
            here = n[some] == size
            if size:
                yield y[at_y[some[here]][:, None] + np.arange(size)], found[np.repeat(here, n[some])].reshape(-1, size, dims).transpose(0, 2, 1), None


def _passed(rows: DataFrame, state: State, gradient: bool, shared: Broadcast | None = None) -> np.ndarray:
    """Sums over all rows at the state's weights; with an encoder that is shared, of pieces."""
    dims, logits, classifier = state.dims, state.filter, state.classifier

    def parts(stream: Iterator[pa.RecordBatch]) -> dict[int, np.ndarray]:
        total = 0
        encoder = shared and encoding.PieceEncoder.received(shared)
        for batch in stream:
            for y, x, tokens in remade(batch, encoder) if encoder else stacked(batch, dims):
                total = total + loss_and_gradient(y, x, logits, classifier, gradient, tokens)
        return {0: total} if np.ndim(total) else {}

    return summed(rows, parts).get(0, np.zeros(3 + (len(state.weights) if gradient else 0)))


def ready(df: DataFrame, classes: Sequence[str], features: str = "features", labels: str = "labels", pieces: bool = False) -> DataFrame:
    """(y, x) of encoded rows: numbers of the labels, -1 for a null or unknown one, and the series (and of how many tokens they are means, if a learnt filter is to come first); (y, pieces) of rows of pieces. Rows whose numbers of labels and of tokens differ are an error."""
    n = encoding.kept(F.col("pieces")) if pieces else F.coalesce(F.size(F.get(features, 0)), F.lit(0))
    bad = df.where(~F.coalesce(F.size(labels) == n, F.lit(False)) & (F.coalesce(n, F.lit(0)) > 0)).count()
    if bad:
        raise ValueError(f"{bad} texts have other numbers of labels than of tokens")
    known = F.array(*(F.lit(c) for c in classes)) if classes else F.array().cast("array<string>")
    y = F.transform(labels, lambda v: F.coalesce(F.array_position(known, v.cast("string")), F.lit(0)).cast("int") - 1)
    more = [POOLED] if POOLED in df.columns and not pieces else []
    return df.where(n > 0).select(y.alias("y"), F.col("pieces") if pieces else F.col(features).cast("array<array<double>>").alias("x"), *more)


def dealt(rows: DataFrame, batches: int, seed: int, encoder: encoding.PieceEncoder | None = None) -> DataFrame:
    """Rows with their mini-batch, stored by it. Pieces are dealt as their series would be, which are neither stored nor shuffled."""
    batch = F.pmod(F.xxhash64("y", "x", F.lit(seed)), F.lit(batches)).cast("int")
    if encoder is None:
        return stored(rows.withColumn("batch", batch).hint("rebalance", "batch"), "mini-batches", by="batch")
    some = encoder.with_features(rows, specials=False).withColumnRenamed("features", "x").withColumn("batch", batch).select(*rows.columns, "batch")
    return stored(spread(some, parts_of(rows, batches), F.col("batch"), batches), "mini-batches", by="batch")


def parts_of(rows: DataFrame, shares: int = 1) -> int:
    """In how many parts to store each of equal shares of rows of pieces, which take few bytes but much work: as many as there are cores, if they are worth it, and more if they are large."""
    each = (rows.agg(F.sum(F.size("pieces.ids"))).first()[0] or 0) / shares
    return max(1, min(rows.sparkSession.sparkContext.defaultParallelism, ceil(each / LEAST_PIECES)), ceil(each / MOST_PIECES))


def spread(rows: DataFrame, parts: int, share: Column | None = None, shares: int = 1) -> DataFrame:
    """Rows in `parts` partitions a share, dealt in turn. Rows that come from files are in the same order when a lost task reads them again, and go where they went before."""
    place = F.pmod(F.monotonically_increasing_id(), F.lit(parts)).cast("int")
    return rows.withColumn("_place", place if share is None else share * parts + place).repartitionById(parts * shares, F.col("_place")).drop("_place")


def adam(state: State, gradient: np.ndarray) -> None:
    state.step += 1
    state.first = BETAS[0] * state.first + (1 - BETAS[0]) * gradient
    state.second = BETAS[1] * state.second + (1 - BETAS[1]) * gradient**2
    m, v = state.first / (1 - BETAS[0] ** state.step), state.second / (1 - BETAS[1] ** state.step)
    state.weights = state.weights - state.rate * m / (np.sqrt(v) + EPSILON)


def train(
    learn: DataFrame, check: DataFrame, filter_size: int = 0, epochs: int = 30, batches: int = 8, rate: float = 1e-3, decay: float = 0.5, early_stop: int = 1, seed: int = 42,
    path: str | None = None, resume: bool = False, features: str = "features", labels: str = "labels", classes: Sequence[str] | None = None, encoder: encoding.PieceEncoder | None = None,
) -> tuple[State, State]:
    """(newest state, best state) of a classifier of each token of encoded rows, learnt on `learn` and watched on `check`.

    features is an array of series, one a dimension; labels has one a token, of which null ones don't count. With filter_size, a frequency filter of that size is learnt with it. Each epoch
    takes a step for every mini-batch, in an order drawn by seed and epoch, and measures the validation loss (means over tokens). The rate is multiplied by `decay` after an epoch that
    didn't lower it by a ten-thousandth; training stops when more than `early_stop` epochs have passed since the best one. Starting weights and mini-batches depend on the seed.

    With an encoder, rows have `pieces` (ids and special) instead of features, as text_probe.piece_rows makes them, and labels for those that aren't special: a step makes its rows' hidden
    states, so that no table holds them, which take 8 bytes a dimension and piece.

    With a path the newest and the best state are stored there, and resume goes on from the newest: the result is that of a run that wasn't interrupted.
    """
    if classes is None:
        each = learn.select(F.explode(F.array_distinct(labels)).alias("l")).unionByName(check.select(F.explode(F.array_distinct(labels)).alias("l")))
        classes = sorted(r[0] for r in each.select(F.col("l").cast("string")).where("l is not null").distinct().collect())
    spark = learn.sparkSession
    dims = encoder.vectors.shape[1] if encoder else learn.select(F.max(F.size(features))).first()[0] or 0
    state = load_state(spark, path) if path and resume else None
    if state is None:
        state = fresh_state(classes, dims, filter_size, seed, rate)
    elif (state.classes, state.dims, state.filter_size, state.seed) != (list(classes), dims, filter_size, seed):
        raise ValueError("the stored state is of other classes, dimensions, filter or seed")
    rows = dealt(ready(learn, classes, features, labels, bool(encoder)), batches, seed, encoder)
    watched = ready(check, classes, features, labels, bool(encoder))
    watched = stored(spread(watched, parts_of(watched)) if encoder else watched, "validation")
    shared = encoder and encoder.share(spark)
    best = load_state(spark, path, "best") if path and state.history else None
    while len(state.history) < epochs and not _stopped(state, early_stop):
        epoch, seen = len(state.history) + 1, np.zeros(3)
        for b in np.random.default_rng([seed, epoch]).permutation(batches).tolist():
            v = _passed(rows.where(F.col("batch") == b).drop("batch"), state, True, shared)
            if v[2]:
                seen += v[:3]
                adam(state, v[3:] / v[2])
        v = _passed(watched, state, False, shared)
        loss = float(v[0] / max(1.0, v[2]))
        state.history.append({"epoch": epoch, "train_loss": float(seen[0] / max(1.0, seen[2])), "train_accuracy": float(seen[1] / max(1.0, seen[2])), "valid_loss": loss, "valid_accuracy": float(v[1] / max(1.0, v[2])), "rate": state.rate})
        if loss < state.plateau * (1 - THRESHOLD):
            state.plateau = loss
        elif decay < 1:
            state.rate *= decay
        if state.best_epoch == epoch:
            best = State(**_copied(state))
        if path:
            save_state(spark, state, path)
    return state, best or state


def _copied(state: State) -> dict:
    return {k: getattr(state, k).copy() if hasattr(getattr(state, k), "copy") else getattr(state, k) for k in asdict(state)}


def _stopped(state: State, early_stop: int) -> bool:
    losses = [h["valid_loss"] for h in state.history]
    return bool(losses) and len(losses) - 1 - losses.index(min(losses)) > early_stop


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _epochs(spark: SparkSession, path: str) -> list[int]:
    """Epochs with a whole state."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    found = [s.getPath() for s in fs.listStatus(p) if s.isDirectory() and s.getPath().getName().startswith("epoch=")]
    whole = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return sorted(int(d.getName()[6:]) for d in found if fs.exists(whole(d, "_SUCCESS")))


def save_state(spark: SparkSession, state: State, path: str) -> None:
    """Stores a state under its epoch, then deletes those that are neither the newest nor the best: at any time a whole one is there."""
    epoch = state.history[-1]["epoch"] if state.history else 0
    row = (state.classes, state.dims, state.filter_size, state.seed, state.weights.tolist(), state.first.tolist(), state.second.tolist(), state.step, state.rate, state.plateau, json.dumps(state.history))
    shape = "classes array<string>, dims int, filter_size int, seed long, weights array<double>, first array<double>, second array<double>, step long, rate double, plateau double, history string"
    spark.createDataFrame([row], shape).coalesce(1).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    for old in _epochs(spark, path):
        if old not in (epoch, state.best_epoch):
            fs, p = _folder(spark, f"{path}/epoch={old}")
            fs.delete(p, True)


def load_state(spark: SparkSession, path: str, which: str = "newest") -> State | None:
    """The newest or best stored state, None without any."""
    found = _epochs(spark, path)
    if not found:
        return None
    r = spark.read.parquet(f"{path}/epoch={found[-1]}").first()
    state = State(list(r["classes"]), r["dims"], r["filter_size"], r["seed"], *(np.array(r[c], dtype=np.float64) for c in ("weights", "first", "second")), r["step"], r["rate"], r["plateau"], json.loads(r["history"]))
    if which == "best" and state.best_epoch not in (None, found[-1]):
        r = spark.read.parquet(f"{path}/epoch={state.best_epoch}").first()
        return State(list(r["classes"]), r["dims"], r["filter_size"], r["seed"], *(np.array(r[c], dtype=np.float64) for c in ("weights", "first", "second")), r["step"], r["rate"], r["plateau"], json.loads(r["history"]))
    return state


def history_table(spark: SparkSession, state: State) -> DataFrame:
    rows = [(*(h[k] for k in ("epoch", "train_loss", "train_accuracy", "valid_loss", "valid_accuracy", "rate")), h["epoch"] == state.best_epoch) for h in state.history]
    return spark.createDataFrame(rows, HISTORY)


def log_lines(history: DataFrame) -> DataFrame:
    """The lines of a run's log: epoch, order, line."""
    losses = F.struct(F.lit(0).alias("order"), F.format_string("epoch %d: train loss %.4f, accuracy %.4f", "epoch", "train_loss", "train_accuracy").alias("line"))
    checks = F.struct(F.lit(1).alias("order"), F.format_string("epoch %d: validation loss %.4f, accuracy %.4f, rate %.2e", "epoch", "valid_loss", "valid_accuracy", "rate").alias("line"))
    best = F.struct(F.lit(2).alias("order"), F.when(F.col("best"), F.format_string("epoch %d: best so far", "epoch")).alias("line"))
    return history.select("epoch", F.inline(F.array(losses, checks, best))).where("line is not null")


def predict(df: DataFrame, state: State, features: str = "features") -> DataFrame:
    """df with `predicted`, a class for each token, instead of its features. Rows without tokens have an empty list."""
    dims, logits, classifier, classes = state.dims, state.filter, state.classifier, np.array(state.classes, dtype=object)
    kept = [f for f in df.schema.fields if f.name not in (features, "predicted")]
    names = [f.name for f in kept]

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            said: list[list[str]] = [[] for _ in range(batch.num_rows)]
            x = batch.column(features).cast(pa.list_(pa.list_(pa.float64())))
            has = np.asarray(pa.compute.list_value_length(x).fill_null(0)) > 0
            at = np.flatnonzero(has)
            lengths = np.asarray(pa.compute.list_value_length(x.filter(pa.array(has)).flatten()))[::dims] if len(at) else np.zeros(0, np.int64)
            y = pa.array([[i] * int(n) for i, n in zip(at, lengths, strict=True)], pa.list_(pa.int32()))
            more = {n: batch.column(n).filter(pa.array(has)) for n in names if n == POOLED}
            for number, values, tokens in stacked(pa.RecordBatch.from_arrays([y, x.filter(pa.array(has)), *more.values()], ["y", "x", *more]), dims):
                if len(logits):
                    open_ = transforms.openness(logits, tokens or values.shape[2], True)[: values.shape[2]]
                    values = transforms.inverse_dct_rows(transforms.dct_rows(values) * open_)
                best = (np.einsum("mdn,cd->mnc", values, classifier[:, :-1], optimize=True) + classifier[:, -1]).argmax(axis=2)
                for i, row in zip(number[:, 0].tolist(), classes[best].tolist(), strict=True):
                    said[i] = row
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(said, pa.list_(pa.string()))], [*names, "predicted"])

    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "predicted array<string>"])
    return df.select(*names, features).mapInArrow(task, shape)


def learn_filter(df: DataFrame, n_frequencies: int, features: str = "features", labels: str = "labels", steps: int = 60, l2: float = 1e-3, tolerance: float = 1e-5) -> tuple[np.ndarray, np.ndarray, list[str], list[float]]:
    """A frequency filter and a token classifier learnt together by quasi-Newton steps over all rows: (filter logits, class weights, classes, losses)."""
    classes = sorted(r[0] for r in df.select(F.explode(labels).alias("l")).where("l is not null").select(F.col("l").cast("string")).distinct().collect())
    dims = df.select(F.max(F.size(features))).first()[0] or 0
    rows = ready(df, classes, features, labels)
    n = n_frequencies + len(classes) * (dims + 1)
    state = State(classes, dims, n_frequencies, 0, np.zeros(n), np.zeros(0), np.zeros(0))
    descent, losses = Descent(state.weights), []
    for _ in range(steps):
        state.weights = descent.trial
        v = _passed(rows, state, True)
        known = max(1.0, v[2])
        losses.append(float(v[0] / known))
        if descent.tell(v[0] / known + 0.5 * l2 * float(descent.trial @ descent.trial), v[3:] / known + l2 * descent.trial, tolerance):
            break
    state.weights = descent.at
    return state.filter, state.classifier, classes, losses


def label_tokens(df: DataFrame, logits: np.ndarray, weights: np.ndarray, classes: Sequence[str], features: str = "features") -> DataFrame:
    """df with `predicted`, a label for each token, by a learnt filter and classifier."""
    w = np.concatenate([logits, np.asarray(weights).reshape(-1)])
    return predict(df, State(list(classes), np.asarray(weights).shape[1] - 1, len(logits), 0, w, np.zeros(0), np.zeros(0)), features)
