"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios.

Features are the distinct n-grams of characters (ASCII letters lower-cased, white space as blanks) of a whole text, hashed to a fixed
width. The model, a weight per hash, is fitted on at most `max_train` labelled texts of `max_bytes` in all, those with the smallest
hash of their id, by one task, and has a fixed size whatever the corpus; the driver gets its weights only. Scoring is one pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandlake.llm.wordbytes import _LOWER, _SEPARATOR, batches, mix64, weights

BITS = 20
MAX_TRAIN, MAX_BYTES = 6000, 64 << 20
_FOLDED = np.where(_SEPARATOR, np.uint8(0x20), _LOWER)[:128].astype(np.uint32)


@dataclass
class NgramModel:
    sizes: tuple[int, ...]
    weight: np.ndarray  # of each hash, log-count ratio times coefficient
    bias: float


def features(t: pa.Table, sizes: tuple[int, ...]) -> Iterator[np.ndarray]:
    """The distinct hashes of each row's n-grams."""
    texts = t["text"].fill_null("").to_pylist()
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    data = np.where(data < 128, _FOLDED[np.minimum(data, 127)], data)
    offsets = np.cumsum([0, *map(len, texts)])
    hashed = []
    for n in sizes:
        w = weights(n, 40 + n)
        h = np.zeros(max(0, len(data) - n + 1), np.uint64)
        for j in range(n):
            h += data[j : len(data) - n + 1 + j] * w[j] if len(h) else 0
        hashed.append((mix64(h) >> np.uint64(64 - BITS)).astype(np.int32))
    stamp = np.zeros(1 << BITS, np.int32)
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        h = np.concatenate([x[s : max(s, e - n + 1)] for x, n in zip(hashed, sizes, strict=True)])
        order = np.arange(len(h), dtype=np.int32)
        stamp[h] = order
        yield h[stamp[h] == order]


def fit(texts: list[str] | pa.ChunkedArray, labels: np.ndarray, sizes: tuple[int, ...] = (6, 8), smooth: float = 1.0, l2: float = 0.05, least: int = 3, faint: float = 1.2, steps: int = 80) -> NgramModel:
    """Logistic regression on log-count ratios, by accelerated gradient descent. Ratios below `faint` count as
    none. Every fifth text is left out of the fit and calibrates the scale and bias of the scores. Texts of one class
    only: a score near that class for every text."""
    y = labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        return NgramModel(sizes, np.zeros(1 << BITS, np.float32), 0.0 if not len(y) else 8.0 * (2 * y[0] - 1))
    learn = np.arange(len(y)) % 5 != 0
    if min(y[learn].sum(), (1 - y[learn]).sum()) < 10 or min(y[~learn].sum(), (1 - y[~learn]).sum()) < 5:
        learn[:] = True  # too few of a class to leave any out
    known, ratio = _ratios(zip(_features_of(texts, sizes), labels, learn, strict=True), smooth, least, faint)
    place = np.full(1 << BITS, -1, np.int32)
    place[known] = np.arange(len(known), dtype=np.int32)
    lists = [at[at >= 0] for at in (place[x] for x in _features_of(texts, sizes))]
    flat, row, value = _matrix([x for x, use in zip(lists, learn, strict=True) if use], ratio)
    t = y[learn]
    n = len(t)
    w, bias = np.zeros(len(known)), 0.0
    norm = float(np.bincount(row, weights=value.astype(np.float64) ** 2, minlength=n).max()) or 1.0
    rate, last, last_bias = 4.0 / (norm + 1.0), w, bias
    share = np.where(t > 0, 0.5 / t.mean(), 0.5 / (1 - t.mean()))
    for k in range(steps):
        m = k / (k + 3)
        v, vb = w + m * (w - last), bias + m * (bias - last_bias)
        z = np.bincount(row, weights=v[flat] * value, minlength=n) + vb
        g = share * (_sigmoid(z) - t) / n
        last, last_bias = w, bias
        w = v - rate * (np.bincount(flat, weights=value * g[row], minlength=len(known)) + l2 / n * v)
        bias = vb - rate * g.sum()
    check = ~learn if (~learn).any() else learn
    flat, row, value = _matrix([x for x, use in zip(lists, check, strict=True) if use], ratio)
    scale, shift = _calibrate(np.bincount(row, weights=w[flat] * value, minlength=int(check.sum())) + bias, y[check])
    weight = np.zeros(1 << BITS, np.float32)
    weight[known] = w * ratio * scale
    return NgramModel(sizes, weight, float(bias * scale + shift))


def _ratios(rows: Iterator[tuple[np.ndarray, int, bool]], smooth: float, least: int, faint: float) -> tuple[np.ndarray, np.ndarray]:
    """The hashes whose log-count ratio isn't taken for none, and their ratios."""
    count = np.zeros((2, 1 << BITS), np.int32)
    for x, label, use in rows:
        if use:
            count[int(label)][x] += 1
    p, q = smooth + count[1], smooth + count[0]
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    known = np.flatnonzero((count.sum(axis=0) >= least) & (np.abs(ratio) >= faint))
    return known, ratio[known]


def _features_of(texts: list[str] | pa.ChunkedArray, sizes: tuple[int, ...]) -> Iterator[np.ndarray]:
    column = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    for t in batches(iter(pa.table({"text": column}).to_batches()), "text", 1 << 20):
        yield from features(t, sizes)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _matrix(lists: list[np.ndarray], ratio: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, row, value) of the cells that aren't 0; a row's values are divided by the root of their number."""
    size = np.array([len(x) for x in lists])
    flat, row = np.concatenate(lists), np.repeat(np.arange(len(lists)), size)
    return flat, row, (ratio[flat] / np.sqrt(np.repeat(np.maximum(1, size), size))).astype(np.float32)


def _calibrate(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and shift that make scores probabilities (Platt), by Newton steps on smoothed targets."""
    p, n = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (p + 1) / (p + 2), 1 / (n + 2))
    spread = z.std() or 1.0
    x = np.stack([(z - z.mean()) / spread, np.ones_like(z)], axis=1)
    a = np.array([1.0, 0.0])
    for _ in range(steps):
        s = _sigmoid(x @ a)
        h = x.T @ (x * (s * (1 - s))[:, None]) + 1e-3 * np.eye(2)
        a -= np.clip(np.linalg.solve(h, x.T @ (s - t) + 1e-3 * a * [1, 0]), -2, 2)
    a[0] = max(a[0], 1e-6)
    return float(a[0] / spread), float(a[1] - a[0] * z.mean() / spread)


def score(model: NgramModel, t: pa.Table) -> np.ndarray:
    known = model.weight != 0
    z = np.empty(t.num_rows)
    for i, x in enumerate(features(t, model.sizes)):
        x = x[known[x]]
        z[i] = model.bias + model.weight[x].sum() / np.sqrt(max(1, len(x)))
    return _sigmoid(z)


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.crc32(F.col(id_col).cast("string")) % 5 == 0


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, max_train: int, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(doc_id, text, label) of at most max_train labelled texts, the same for any layout of the tables. Rows of one id and text count once;
    a text that would bring the sample over max_bytes is left out of it, so that the sample fits a task whatever the ids and lengths."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    ids = ids.groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "h", F.octet_length("text").alias("size")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(max_train)
    chosen, total = [], 0
    for r in found.collect():
        if total + r["size"] <= max_bytes:
            total += r["size"]
            chosen.append((r["doc_id"], r["h"]))
    picked = docs.sparkSession.createDataFrame(chosen, "doc_id long, h long").join(F.broadcast(ids), "doc_id")
    return rows.join(F.broadcast(picked), ["doc_id", "h"]).dropDuplicates(["doc_id", "h"]).select("doc_id", "text", "label")


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, max_train: int, max_bytes: int = MAX_BYTES) -> tuple[list[str], np.ndarray]:
    """The training sample's texts and labels, ordered by id and text."""
    sample = training_sample(docs, labels, label_col, id_col, text_col, max_train, max_bytes).orderBy("doc_id", "text").select("text", "label").toArrow()
    return sample["text"].to_pylist(), sample["label"].to_numpy()


def _fit_task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model's sizes, its weights that aren't 0 and its bias, of all rows of the task."""
    if parts := list(stream):
        t = pa.Table.from_batches(parts)
        model = fit(t["text"], t["label"].to_numpy())
        known = np.flatnonzero(model.weight).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in ((list(model.sizes), pa.list_(pa.int32())), (known.tobytes(), pa.binary()), (model.weight[known].tobytes(), pa.binary()), (model.bias, pa.float64()))], ["sizes", "known", "weight", "bias"])


def fitted(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, max_train: int) -> NgramModel:
    """The model of the training sample, fitted by one task: neither the texts nor what the fit makes of them reach the driver."""
    sample = training_sample(docs, labels, label_col, id_col, text_col, max_train).repartition(1).sortWithinPartitions("doc_id", "text").select("text", "label")
    found = sample.mapInArrow(_fit_task, "sizes array<int>, known binary, weight binary, bias double").collect()
    if not found:
        return fit([], np.zeros(0))
    weight = np.zeros(1 << BITS, np.float32)
    weight[np.frombuffer(found[0]["known"], np.int32)] = np.frombuffer(found[0]["weight"], np.float32)
    return NgramModel(tuple(found[0]["sizes"]), weight, found[0]["bias"])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (score >= threshold) of every row.

    A null or empty text is scored by the model's bias alone. Null labels and ids are not learnt from, a label
    given twice counts as its largest; a null id is not held out. Without labels every score is 0.5, with
    labels of one class it is near that class. Repeated rows get equal scores. Other columns are not read.
    """
    model = fitted(docs, labels, label_col, id_col, text_col, max_train)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches(stream, "text"):
            yield from t.drop_columns("text").append_column("score", pa.array(score(shared.value, t))).combine_chunks().to_batches()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(task, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of docs that `toxicity` doesn't predict toxic, in one pass without a shuffle of the texts."""
    model = fitted(docs, labels, label_col, id_col, text_col, max_train)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches(stream, text_col):
            texts = pa.table({"text": t[text_col]})
            yield from t.filter(pa.array(score(shared.value, texts) < threshold)).combine_chunks().to_batches()

    return docs.mapInArrow(task, docs.schema)
