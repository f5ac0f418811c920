"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text's terms are its words, its pairs of neighbouring words, its runs of punctuation, and marks for a word that follows itself and for a
word in capitals. Counts are damped and weighted by inverse document frequency; a truncated SVD of labelled texts gives
the latent space. Labelled vectors, at most `max_train`, are broadcast; every document's cosine with all of them is computed
exactly, in blocks, and its nearest neighbours vote by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandlake.llm.toxicity import held_out, training_rows
from bandlake.llm.wordbytes import Words, batches, mix64, text_bytes

MAX_TRAIN = 4000
VOCABULARY, LEAST_TEXTS = 4096, 4
_BYTE = np.arange(256)
_WORD = (_BYTE >= 0x80) | ((_BYTE >= 0x30) & (_BYTE < 0x3A)) | ((_BYTE >= 0x41) & (_BYTE < 0x5B)) | ((_BYTE >= 0x61) & (_BYTE < 0x7B))
_MARK = ~_WORD & (_BYTE > 0x20) & (_BYTE != 0x7F)
_UPPER = (_BYTE >= 0x41) & (_BYTE < 0x5B)
AGAIN, CAPITALS = np.uint64(1), np.uint64(2)


@dataclass
class LatentModel:
    vocabulary: np.ndarray  # term hashes, ascending
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray  # of the labelled texts, ordered by id
    votes: np.ndarray
    prior: float
    k: int


def terms(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term hash, damped count) of each row's distinct terms, by row and hash."""
    data, offsets = text_bytes(t["text"])
    words, marks = Words(data, offsets, ~_WORD), Words(data, offsets, ~_MARK)
    h = words.hashes(lower=True)
    follows = words.doc[1:] == words.doc[:-1] if len(h) else np.zeros(0, bool)
    pair = mix64(h[:-1] * np.uint64(3) + h[1:])[follows] if len(h) else h
    again = words.doc[1:][follows & (h[1:] == h[:-1])] if len(h) else words.doc
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    loud = words.doc[(words.end - words.start > 1) & (upper[words.end] - upper[words.start] == words.end - words.start)]
    row = np.concatenate([words.doc, words.doc[1:][follows] if len(h) else words.doc, marks.doc, again, loud])
    term = np.concatenate([h, pair, marks.hashes(seed=3), np.full(len(again), AGAIN), np.full(len(loud), CAPITALS)])
    order = np.lexsort((term, row))
    row, term = row[order], term[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return row[at], term[at], np.sqrt(np.diff(np.append(at, len(row))))


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(length > 0, length, 1)


def weighted(t: pa.Table, vocabulary: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in the vocabulary, weight) of each row's known terms; a row's weights have length 1."""
    row, term, count = terms(t)
    at = np.minimum(np.searchsorted(vocabulary, term), max(0, len(vocabulary) - 1))
    known = vocabulary[at] == term if len(vocabulary) else np.zeros(len(term), bool)
    row, at = row[known], at[known]
    value = count[known] * idf[at]
    length = np.sqrt(np.bincount(row, value**2, t.num_rows))
    return row, at, value / length[row]


def project(model: LatentModel, t: pa.Table) -> np.ndarray:
    """Unit vectors of the texts in the latent space; zero for a text without known terms."""
    row, at, value = weighted(t, model.vocabulary, model.idf)
    out = np.zeros((t.num_rows, model.basis.shape[1]))
    if len(row):
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        out[row[first]] = np.add.reduceat(model.basis[at] * value[:, None], first, axis=0)
    return _unit(out)


def fit(texts: list[str], labels: np.ndarray, rank: int = 32, k: int = 15, vocabulary: int = VOCABULARY, least: int = LEAST_TEXTS) -> LatentModel:
    """The vocabulary is the terms of the most labelled texts, at least `least` of them (smaller hashes first among equals)."""
    parts = list(batches(iter(pa.table({"text": pa.array(texts, pa.string())}).to_batches(max_chunksize=500)), "text", 1 << 20))
    hashes = np.concatenate([np.zeros(0, np.uint64), *(terms(t)[1] for t in parts)])
    every, texts_of = np.unique(hashes, return_counts=True)
    top = np.lexsort((every, -texts_of))[:vocabulary]
    top = np.sort(top[texts_of[top] >= min(least, max(1, len(texts)))])
    idf = np.log((1 + len(texts)) / (1 + texts_of[top])) + 1
    x = np.zeros((len(texts), len(top)), np.float32)
    at = 0
    for t in parts:
        row, place, value = weighted(t, every[top], idf)
        x[at + row, place] = value
        at += t.num_rows
    prior = float(labels.mean()) if len(labels) else 0.5
    if not x.size:
        return LatentModel(every[top], idf, np.zeros((len(top), 1)), np.zeros((0, 1)), np.zeros(0), prior, 0)
    rnd = np.random.default_rng(11)
    rank = max(1, min(rank, *x.shape))
    y = x @ rnd.standard_normal((x.shape[1], min(x.shape[1], rank + 16))).astype(np.float32)
    for _ in range(3):  # power iterations of a randomised SVD
        y = x @ (x.T @ np.linalg.qr(y)[0])
    q = np.linalg.qr(y)[0]
    _, _, v = np.linalg.svd(q.T @ x, full_matrices=False)
    basis = np.ascontiguousarray(v[:rank].T).astype(np.float64)
    return LatentModel(every[top], idf, basis, _unit(x @ basis), labels.astype(np.float64), prior, min(k, len(x)))


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, equal ones by their place."""
    least = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    over, ties = cosine > least, cosine == least
    ties &= np.cumsum(ties, axis=1) <= k - over.sum(axis=1, keepdims=True)
    return np.nonzero(over | ties)[1].reshape(-1, k)


def score(model: LatentModel, t: pa.Table, block: int = 512) -> np.ndarray:
    out = np.full(t.num_rows, model.prior)
    if not model.k:
        return out
    for at in range(0, t.num_rows, block):
        cosine = project(model, t.slice(at, block)) @ model.vectors.T
        near = nearest(cosine, model.k)
        w = np.maximum(0, np.take_along_axis(cosine, near, axis=1)) ** 8
        total = w.sum(axis=1)
        some = total > 1e-9
        out[at : at + block][some] = ((w * model.votes[near]).sum(axis=1)[some] / total[some]).clip(0, 1)
    return out


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold) of every row.

    A null or empty text, or one without a known term, has no direction and gets the labels' mean, or 0.5 without labels. Null
    labels and ids are not learnt from, a label given twice counts as its largest; a null id is not held out.
    Equal similarities are ordered by the labelled rows' ids. Repeated rows get equal scores. Other columns are not read.
    """
    model = fit(*training_rows(docs, labels, label_col, id_col, text_col, max_train))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches(stream, "text", 2 << 20):
            yield from t.drop_columns("text").append_column("score", pa.array(score(shared.value, t))).combine_chunks().to_batches()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scored = rows.mapInArrow(task, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
