"""Periodic runs of words by block matching.

A run of period q that is repeated three times or more holds, for the power of two B with B <= q < 2 B, a block of B words at a multiple of B that occurs again q words later
within the run. So for every scale B the aligned blocks of a text are the keys of an Aho-Corasick automaton over word numbers, the text is searched once for
all of them, and an occurrence at a distance of B to 2 B - 1 from its block is a seed, which is extended word by word in both directions. What can't hold a run
at a scale, as its words don't come again within 2 B, isn't searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandlake.llm.wordbytes import Words, batches, text_bytes

GRAM = 4
SECTION = 1 << 16
RUN = "struct<start:long,length:long,period:long>"
RESULT = f"doc_id long, n_words long, runs array<{RUN}>, best {RUN}, collapsed_text string"


def word_numbers(texts: list[bytes]) -> np.ndarray:
    """Numbers of the words of all texts, one after the other: equal for equal words of one text, never equal in two texts."""
    out: list[int] = []
    base = 0
    for text in texts:
        known: dict[bytes, int] = {}
        out += [known.setdefault(w, base + len(known)) for w in text.split()]
        base += len(known)
    return np.array(out, np.int64)


def _last_seen(codes: np.ndarray) -> np.ndarray:
    """How far back each code was last seen; a large number where it wasn't."""
    back = np.full(len(codes), np.iinfo(np.int64).max)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    back[order[1:][same]] = order[1:][same] - order[:-1][same]
    return back


def _stretches(mask: np.ndarray, least: int) -> np.ndarray:
    """(start, end) of the stretches of at least `least` that are true."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8)))
    edge = edge.reshape(-1, 2)
    return edge[edge[:, 1] - edge[:, 0] >= least]


def _block_seeds(ids: np.ndarray, lo: int, hi: int, scale: int, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(block start, distance) of the aligned blocks within ids[lo:hi] that occur again there at a distance of scale to 2 scale - 1. dense: where a
    run goes on whose blocks are left out, up to the end of that run."""
    first = -(-lo // scale) * scale
    local = np.unique(ids[lo:hi], return_inverse=True)[1].tolist()  # small numbers keep the automaton's edges few
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    keys: dict[tuple[int, ...], int] = {}
    block = []
    for at in range(first, hi - scale + 1, scale):
        if dense[at] >= at + scale:
            block.append(-1)
            continue
        key = tuple(local[at - lo : at - lo + scale])
        if key not in keys:
            keys[key] = len(keys)
            machine.add_word(key, keys[key])
        block.append(keys[key])
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    machine.make_automaton()
    found = np.array(list(machine.iter(tuple(local))), np.int64).reshape(-1, 2)
    at = found[:, 0] + lo - scale + 1
    number = (at - scale) // scale - first // scale  # of the one aligned block that ends up to scale - 1 words before the occurrence
    ok = (number >= 0) & (number < len(block))
    at, number, key = at[ok], number[ok], found[ok, 1]
    ok = np.array(block, np.int64)[number] == key
    start = first + number[ok] * scale
    return start, at[ok] - start


def _end_seeds(runs: list[tuple[int, int, int]], scale: int) -> Iterator[tuple[int, int]]:
    """(place, distance) that map a run's start or end on that of a later run of its period, at a distance of scale to 2 scale - 1."""
    by_period: dict[int, list[tuple[int, int]]] = {}
    for s, e, q in runs:
        by_period.setdefault(q, []).append((s, e))
    for each in by_period.values():
        each.sort()
        for k, (s, e) in enumerate(each):
            for s2, e2 in each[k + 1 :]:
                if s2 - s >= 2 * scale and e2 - e >= 2 * scale:
                    break
                if scale <= s2 - s < 2 * scale:
                    yield s, s2 - s
                if scale <= e2 - e < 2 * scale:
                    yield e - 1, e2 - e


def _agree(ids: np.ndarray, i: int, j: int, step: int) -> int:
    """How many words from i and j on, forwards (step 1) or backwards (step -1), are equal; j > i."""
    most = len(ids) - j if step > 0 else i + 1
    done, size = 0, 32
    while done < most:
        n = min(size, most - done)
        a, b = (ids[i + done : i + done + n], ids[j + done : j + done + n]) if step > 0 else (ids[i - done - n + 1 : i - done + 1][::-1], ids[j - done - n + 1 : j - done + 1][::-1])
        differ = a != b
        if differ.any():
            return done + int(differ.argmax())
        done, size = done + n, min(2 * size, 1 << 20)
    return done


def find_runs(ids: np.ndarray, least: int = 6, exponent: int = 4) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every maximal run of at least max(least, exponent * period) numbers, by start, then period."""
    if exponent < 3:
        raise ValueError("exponent is at least 3")
    n = len(ids)
    runs: dict[tuple[int, int], int] = {}
    gram, back, scale = ids, None, 1
    size = 1
    while scale * exponent <= n:
        if back is None or size < min(scale, GRAM):
            if size < min(scale, GRAM):
                gram = gram[: len(gram) - size] * np.int64(max(1, int(ids.max()) + 1) ** size & 0x7FFFFFFF | 1) + gram[size:]  # codes may wrap: equal n-grams stay equal
                size *= 2
            back = _last_seen(gram)
        # behind its first period every n-gram of a run was last seen less than 2 * scale before
        hot = _stretches(back < 2 * scale, max(1, (exponent - 1) * scale - size + 1, (least - scale - size + 1) if scale == 1 else 1))
        if len(hot):
            _search(ids, [(max(0, a - 2 * scale + 1), b + size - 1) for a, b in hot.tolist()], scale, least, exponent, runs)
        scale *= 2
    return sorted((s, e - s, q) for (s, e), q in runs.items())


def _search(ids: np.ndarray, regions: list[tuple[int, int]], scale: int, least: int, exponent: int, runs: dict[tuple[int, int], int]) -> None:
    """Adds the runs with periods of scale to 2 scale - 1."""
    section = max(SECTION, 16 * scale)
    merged: list[list[int]] = []
    for lo, hi in regions:
        if merged and lo <= merged[-1][1]:
            merged[-1][1] = max(hi, merged[-1][1])
        else:
            merged.append([lo, hi])
    # Blocks within a run that holds enough periods in a block alone occur in runs of that period only. In the same run their distances give that run again; two runs
    # can only be parts of a longer run if their starts or ends map on each other.
    dense = [(s, e, q) for (s, e), q in runs.items() if e - s >= scale >= max(least, exponent * q)]
    until = np.zeros(len(ids), np.int64)
    for s, e, _ in dense:
        until[s:e] = np.maximum(until[s:e], e)
    found = [_block_seeds(ids, a, min(hi, a + section), scale, until) for lo, hi in merged for a in range(lo, max(lo + 1, hi - 3 * scale), section - 3 * scale)]
    ends = np.array([x for x in _end_seeds(dense, scale) if ids[x[0]] == ids[x[0] + x[1]]], np.int64).reshape(-1, 2)
    start, distance = (np.concatenate(x) for x in zip(*found, (ends[:, 0], ends[:, 1]), strict=True))
    order = np.lexsort((start, distance))
    q, end = 0, 0
    for j, d in zip(start[order].tolist(), distance[order].tolist(), strict=True):
        if d == q and j < end:
            continue  # within the stretch extended last
        q = d
        lo = j - _agree(ids, j - 1, j - 1 + d, -1) if j else 0
        end = j + _agree(ids, j, j + d, 1)
        if end - lo + d >= max(least, exponent * d):
            # a stretch that has a smaller period was found with it
            runs.setdefault((lo, end + d), d)


def _results(t: pa.Table, least: int, exponent: int) -> pa.Table:
    data, offsets = text_bytes(t["text"])
    words = Words(data, offsets)
    raw = data.tobytes()
    ids = word_numbers([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
    found = find_runs(ids, least, exponent)
    start, length, period = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    doc = words.doc[start] if len(start) else start
    runs: list[list[tuple[int, int, int]]] = [[] for _ in range(t.num_rows)]
    for k, s, n, q in zip(doc.tolist(), (start - words.first[doc]).tolist(), length.tolist(), period.tolist(), strict=True):
        runs[k].append((s, n, q))
    # quotients of numbers below 2^31 that differ do so by more than 2^-62
    best = [min(x, key=lambda r: (-((r[1] << 64) // r[2]), r[0], r[2])) if x else None for x in runs]
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    told = lambda r: dict(zip(("start", "length", "period"), r, strict=True))
    return pa.table({
        "doc_id": t["doc_id"], "n_words": np.diff(words.first), "runs": pa.array([[told(r) for r in x] for x in runs], pa.list_(kind)),
        "best": pa.array([told(r) if r else None for r in best], kind), "collapsed_text": words.joined(np.cumsum(edge[:-1]) == 0).cast(pa.string()),
    })


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs, best and collapsed_text of every row, in one pass without a shuffle.

    Words are runs without ASCII white space, numbered from 0. A run is a stretch of words with smallest period q, of at least max(least, exponent * q) words, that no
    neighbouring word extends keeping the period: start, length and period, ordered by start, then period. best is the run of the greatest length / period, compared
    exactly (ties: the smallest start, then period), null without runs. collapsed_text keeps the words that no run holds after its first period, joined by one space.
    exponent is at least 3.

    A null, empty or blank text has no words, no runs and an empty collapsed_text. Repeated rows give equal rows, null ids stay. A text is a task's work as a whole, in time about
    in proportion to its length times the logarithm; other columns are not read.
    """

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches(stream, "text"):
            yield from _results(t, least, exponent).combine_chunks().to_batches()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, RESULT)
