"""Vectorised work on the UTF-8 bytes of an Arrow string column: words, their hashes, n-gram hashes.

Used inside tasks by the operators that must look at every word of every text. A batch holds whole
texts, so no text is ever cut; memory is bounded by the batch limit or by the longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BATCH_BYTES = 6 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def weights(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit multipliers; a longer call begins with the shorter call's values."""
    return mix64((np.arange(n, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def batches(stream: Iterator[pa.RecordBatch], text: str, limit: int = BATCH_BYTES) -> Iterator[pa.Table]:
    """Regroups a task's rows into tables whose texts hold about `limit` bytes, or one longer text."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in stream:
        offsets = _offsets(batch.column(batch.schema.get_field_index(text)))
        start = 0
        for i in range(batch.num_rows):
            size += int(offsets[i + 1] - offsets[i]) + 64
            if size >= limit:
                held.append(batch.slice(start, i + 1 - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, i + 1
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()[1]
    if raw is None or not len(column):
        return np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(raw, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, offset of each text); a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        parts = [text_bytes(c) for c in column.chunks]
        sizes = [0, *np.cumsum([len(d) for d, _ in parts])]
        return np.concatenate([d for d, _ in parts]), np.concatenate([np.zeros(1, np.int64), *(o[1:] + s for (_, o), s in zip(parts, sizes, strict=False))])
    if column.null_count:
        column = column.fill_null("")
    offsets = _offsets(column)
    if not len(column) or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a batch: byte ranges `start`, `end`, the row `doc` of each, and where each row's words begin (`first`, n + 1 long)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = _SEPARATOR):
        self.data, self.offsets, self.n_docs = data, offsets, len(offsets) - 1
        inside = ~separator[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        begins[edges] = inside[edges]
        ends[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(self.n_docs), np.diff(self.first))
        self.inside = inside

    def hashes(self, seed: int = 1, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes (multilinear over positions)."""
        n = len(self.start)
        if not n:
            return np.zeros(0, np.uint64)
        length = self.end - self.start
        at = np.zeros(n, np.int64)
        np.cumsum(length[:-1], out=at[1:])
        raw = self.data[self.inside]
        if lower:
            raw = _LOWER[raw]
        position = np.arange(len(raw)) - np.repeat(at, length)
        value = raw.astype(np.uint64)
        value += np.uint64(1)
        value *= weights(int(length.max()), seed)[position]
        total = np.add.reduceat(value, at)
        return mix64(total + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, hashes: np.ndarray, n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the n consecutive words from each start, start word): only starts whose n words lie in one text."""
        starts = np.flatnonzero(np.arange(len(hashes)) + n <= self.first[self.doc + 1]) if len(hashes) else np.zeros(0, np.int64)
        w = weights(n, seed)
        total = np.zeros(len(starts), np.uint64)
        for j in range(n):
            total += hashes[starts + j] * w[j]
        return mix64(total), starts

    def joined(self, keep: np.ndarray) -> pa.Array:
        """Per text, the kept words joined by one space."""
        start, length, doc = self.start[keep], (self.end - self.start)[keep], self.doc[keep]
        counts = np.bincount(doc, minlength=self.n_docs)
        last = np.ones(len(doc), bool)
        last[:-1] = doc[1:] != doc[:-1]
        width = length + ~last
        at = np.zeros(len(width) + 1, np.int64)
        np.cumsum(width, out=at[1:])
        source = np.arange(at[-1]) + np.repeat(start - at[:-1], width)
        out = self.data[np.minimum(source, max(0, len(self.data) - 1))]
        out[(at[1:] - 1)[~last]] = 0x20
        bounds = at[np.concatenate([[0], np.cumsum(counts)])]
        return pa.Array.from_buffers(pa.large_string(), self.n_docs, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])
