"""Substring dedup: prefix-partitioned suffix trees over words.

Every word position starts a suffix. Suffixes are split by a trie of word symbols whose prefixes are
lengthened until each holds a memory-sized group; a task builds the subtrees of its groups down to depth
`min_words` by sorting, so that equal neighbours are the deep internal nodes. A node that spans several
documents is a repeat, and runs of repeated suffixes in a document are its maximal repeats.

Before the shuffle a batch of documents keeps one suffix of each node (the one of the smallest document):
its other occurrences are already decided, so a passage that a third of all documents share sends one
suffix a batch. Suffixes travel as sorted 64-bit node hashes, about seven bytes each.
"""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandlake.llm.components import sizes_for
from bandlake.llm.packing import pack, unpack
from bandlake.llm.wordbytes import Words, batches, text_bytes

SYMBOLS = 256
GROUP_SUFFIXES, BUCKET_SUFFIXES = 2_000_000, 4_000_000
LEAST_GROUP = 25_000

RESULT = "doc_id long, n_words long, n_removed long, span_start array<int>, span_words array<int>, kept_text string"


def _symbols(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(56)).astype(np.int64)


def _leaf(trie: np.ndarray, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Walks each suffix down the trie; a leaf is stored as -(number + 1)."""
    at = np.zeros(len(starts), np.int64)
    depth = 0
    while (inner := np.flatnonzero(at >= 0)).size:
        at[inner] = trie[at[inner], symbols[starts[inner] + depth]]
        depth += 1
    return -at - 1


def plan_prefixes(docs: DataFrame, min_words: int, n_buckets: int, group_suffixes: int = GROUP_SUFFIXES, bucket_suffixes: int = BUCKET_SUFFIXES) -> tuple[np.ndarray, np.ndarray]:
    """(trie, bucket of each leaf). There are n_buckets, or as many as leave a bucket bucket_suffixes suffixes. The driver sees counts of symbols only: 65,536 at first, then 256 for each
    prefix that is still too large, which are at most suffixes / group size many."""

    def count(trie: np.ndarray | None, depth: int) -> dict[tuple[int, int], int]:
        def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for t in batches(stream, "text"):
                words = Words(*text_bytes(t["text"]))
                sym = _symbols(words.hashes())
                starts = np.flatnonzero(np.arange(len(sym)) + min_words <= words.first[words.doc + 1]) if len(sym) else np.zeros(0, np.int64)
                if trie is None:
                    node, code = sym[starts] * 0, sym[starts] * SYMBOLS + sym[starts + 1] if min_words > 1 else sym[starts] * SYMBOLS
                else:
                    leaf = _leaf(trie, sym, starts)
                    starts = starts[leaf >= trie_open]
                    node, code = leaf[leaf >= trie_open], sym[starts + depth]
                for k in np.unique(node):
                    total[int(k)] = total.get(int(k), 0) + np.bincount(code[node == k], minlength=SYMBOLS * SYMBOLS if trie is None else SYMBOLS)
            for k, v in total.items():
                some = np.flatnonzero(v)
                yield pa.RecordBatch.from_pydict({"node": np.full(len(some), k), "code": some, "n": v[some]})

        rows = docs.mapInArrow(task, "node long, code long, n long").groupBy("node", "code").agg(F.sum("n").alias("n")).toPandas()
        return {(int(a), int(b)): int(c) for a, b, c in zip(rows["node"], rows["code"], rows["n"], strict=True)}

    trie_open = 0
    pairs = np.zeros((SYMBOLS, SYMBOLS), np.int64)
    for (_, code), n in count(None, 0).items():
        pairs[code // SYMBOLS, code % SYMBOLS] = n
    n_buckets = max(n_buckets, -(-int(pairs.sum()) // BUCKET_SUFFIXES))
    capacity = min(group_suffixes, max(LEAST_GROUP, int(pairs.sum()) // (2 * n_buckets)))
    nodes: list[np.ndarray] = [np.zeros(SYMBOLS, np.int64)]
    sizes: list[int] = []
    large: list[tuple[int, int, int]] = []  # node, symbol, size of prefixes to be lengthened

    def leaf(n: int) -> int:
        sizes.append(n)
        return -len(sizes)

    for a in range(SYMBOLS):
        if (n := int(pairs[a].sum())) <= capacity or min_words == 1:
            nodes[0][a] = leaf(n)
            continue
        nodes.append(np.zeros(SYMBOLS, np.int64))
        nodes[0][a] = len(nodes) - 1
        for b in range(SYMBOLS):
            if (m := int(pairs[a, b])) <= capacity or min_words == 2:
                nodes[-1][b] = leaf(m)
            else:
                large.append((len(nodes) - 1, b, m))
    depth = 2
    while large:
        trie_open = len(sizes)
        for i, (node, b, _) in enumerate(large):
            nodes[node][b] = -(trie_open + i + 1)
        counts = count(np.array(nodes), depth)
        still: list[tuple[int, int, int]] = []
        opened = trie_open
        for i, (node, b, _) in enumerate(large):
            nodes.append(np.zeros(SYMBOLS, np.int64))
            nodes[node][b] = len(nodes) - 1
            for c in range(SYMBOLS):
                m = counts.get((opened + i, c), 0)
                if m <= capacity or depth + 1 >= min_words:
                    nodes[-1][c] = leaf(m)
                else:
                    still.append((len(nodes) - 1, c, m))
        large, depth = still, depth + 1
    heap = [(0, k) for k in range(n_buckets)]
    bucket = np.zeros(len(sizes), np.int64)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, k = heapq.heappop(heap)
        bucket[i] = k
        heapq.heappush(heap, (load + sizes[i], k))
    return np.array(nodes), bucket


class _Nodes:
    """The nodes of one batch of documents, which are ordered by doc_id."""

    def __init__(self, table: pa.Table, min_words: int, trie: np.ndarray, buckets: np.ndarray):
        ids = table["doc_id"].combine_chunks()
        self.known = np.asarray(ids.is_valid())
        self.ids = np.asarray(ids.fill_null(0), dtype=np.int64)
        self.words = Words(*text_bytes(table["text"]))
        hashes = self.words.hashes()
        grams, starts = self.words.grams(hashes, min_words)
        known = self.known[self.words.doc[starts]] if len(starts) else np.zeros(0, bool)
        grams, starts = grams[known], starts[known]
        order = np.argsort(grams, kind="stable")
        self.starts, grams = starts[order], grams[order]
        new = np.ones(len(grams), bool)
        new[1:] = grams[1:] != grams[:-1]
        self.node = np.cumsum(new) - 1
        self.hash, first = grams[new], self.starts[new]
        self.owner = self.ids[self.words.doc[first]]
        bucket = buckets[_leaf(trie, _symbols(hashes), first)]
        by = np.argsort(bucket, kind="stable")
        cut = np.flatnonzero(np.diff(bucket[by])) + 1
        self.parts = {int(bucket[p[0]]): p for p in np.split(by, cut) if len(p)}


def _sorted(table: pa.Table) -> pa.Table:
    return table.take(pa.compute.sort_indices(table["doc_id"], null_placement="at_end"))


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13) -> DataFrame:
    """Removes every word covered by a window of `min_words` words that also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed, span_start and span_words (the removed maximal repeats, in words) and
    kept_text (kept words joined by one space), one row per input row. Words are maximal runs without ASCII white
    space, compared byte for byte. A null or empty text has no words and an empty kept_text. Rows that share an
    id do not remove each other's words; a null id has no rank: its words stay and remove nothing. Ties do not
    arise, as only smaller ids remove. Other columns are not read. The input must give the same rows in the same
    order when a lost partition is computed again, as files do.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    _, group_bytes, batch_bytes = sizes_for(docs)
    n_buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    trie, buckets = plan_prefixes(docs, min_words, n_buckets, bucket_suffixes=max(BUCKET_SUFFIXES, group_bytes // 6))

    def suffixes(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, t in enumerate(batches(stream, "text", batch_bytes)):
            t = _sorted(t)
            nodes = _Nodes(t, min_words, trie, buckets)
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                w.write_table(t)
            name = f"{part}-{seq}"
            yield _rows([-1 - (part * 1009 + seq)], [name], [0], [sink.getvalue()])
            base = int(nodes.ids[nodes.known].min()) if nodes.known.any() else 0
            some = list(nodes.parts.items())
            yield _rows([k for k, _ in some], [name] * len(some), [base] * len(some), [pack(nodes.hash[p], (nodes.owner[p] - base).astype(np.uint64)) for _, p in some])

    def subtree(t: pa.Table) -> pa.Table:
        """Of each batch's nodes, those that a smaller document has as well."""
        if t["bucket"][0].as_py() < 0:
            return t
        parts = [unpack(x.as_py()) for x in t["blob"]]
        sizes = [len(k) for k, _ in parts]
        keys = np.concatenate([k for k, _ in parts])
        owner = np.concatenate([v.astype(np.int64) + b.as_py() for (_, v), b in zip(parts, t["base"], strict=True)])
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[1:] = keys[order][1:] != keys[order][:-1]
        smallest = np.minimum.reduceat(owner[order], np.flatnonzero(new))
        repeat = np.zeros(len(keys), bool)
        repeat[order] = owner[order] > smallest[np.cumsum(new) - 1]
        flags = np.split(repeat, np.cumsum(sizes)[:-1])
        told = [i for i, f in enumerate(flags) if f.any()]
        return pa.Table.from_batches([_rows([t["bucket"][i].as_py() for i in told], [t["batch"][i].as_py() for i in told], [0] * len(told), [np.packbits(flags[i]).tobytes() for i in told])])

    def spans(t: pa.Table) -> pa.Table:
        rows = {b.as_py(): x for b, x in zip(t["bucket"], t["blob"], strict=True)}
        docs = pa.ipc.open_stream(rows.pop(min(rows)).as_py()).read_all()
        nodes = _Nodes(docs, min_words, trie, buckets)
        words, repeat = nodes.words, np.zeros(len(nodes.hash), bool)
        for k, x in rows.items():
            p = nodes.parts[k]
            repeat[p] = np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(p)).astype(bool)
        hit = nodes.starts[repeat[nodes.node] | (nodes.ids[words.doc[nodes.starts]] > nodes.owner[nodes.node])] if len(nodes.hash) else nodes.starts
        edge = np.zeros(len(words.start) + 1, np.int64)
        edge[hit] += 1
        edge[hit + min_words] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        first = words.first
        opens = gone.copy()
        opens[1:] &= ~gone[:-1] | (words.doc[1:] != words.doc[:-1])
        closes = gone.copy()
        closes[:-1] &= ~gone[1:] | (words.doc[1:] != words.doc[:-1])
        at, to = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        ends = pa.array(np.searchsorted(at, first).astype(np.int32))
        total = np.concatenate([[0], np.cumsum(gone)])
        return pa.table({
            "doc_id": docs["doc_id"], "n_words": np.diff(first), "n_removed": total[first[1:]] - total[first[:-1]],
            "span_start": pa.ListArray.from_arrays(ends, pa.array((at - first[words.doc[at]]).astype(np.int32))), "span_words": pa.ListArray.from_arrays(ends, pa.array((to - at).astype(np.int32))),
            "kept_text": words.joined(~gone).cast(pa.string()),
        })

    rows = docs.mapInArrow(suffixes, "bucket long, batch string, base long, blob binary")
    return rows.groupBy("bucket").applyInArrow(subtree, rows.schema).groupBy("batch").applyInArrow(spans, RESULT)


def _rows(bucket: list, batch: list, base: list, blob: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(batch, pa.string()), pa.array(base, pa.int64()), pa.array(blob, pa.binary())], ["bucket", "batch", "base", "blob"])
