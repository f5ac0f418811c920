"""Compact binary columns for shuffles of many small integers.

Sorted 64-bit keys are sent as differences, values as their lowest bytes, both as byte planes that
zstd then shortens; a suffix or shingle so costs about seven bytes instead of a row of its own.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_HEAD = struct.Struct("<IBB")


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _join(raw: np.ndarray, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = raw.reshape(width, n).T
    return out.view("<u8").reshape(-1).astype(np.uint64, copy=False)


def _width(x: np.ndarray) -> int:
    return max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1


def pack(keys: np.ndarray, values: np.ndarray | None = None) -> bytes:
    """keys: ascending uint64; values: uint64 of the same length, or None."""
    steps = keys.copy()
    steps[1:] -= keys[:-1]
    first, steps = (int(keys[0]), steps[1:]) if len(keys) else (0, steps)
    kw = _width(steps)
    vw = 0 if values is None else _width(values)
    body = _planes(steps, kw) + (_planes(values, vw) if vw else b"")
    return _HEAD.pack(len(keys), kw, vw) + struct.pack("<Q", first) + zstandard.ZstdCompressor(level=1).compress(body)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray | None]:
    n, kw, vw = _HEAD.unpack_from(blob)
    (first,) = struct.unpack_from("<Q", blob, _HEAD.size)
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[_HEAD.size + 8 :]), np.uint8)
    m = max(0, n - 1)
    keys = np.zeros(n, np.uint64)
    if n:
        keys[0] = first
        keys[1:] = _join(body[: m * kw], m, kw)
        np.cumsum(keys, out=keys)
    return keys, _join(body[m * kw : m * kw + n * vw], n, vw) if vw else None


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def expand(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)
