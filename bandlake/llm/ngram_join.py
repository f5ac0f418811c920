"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams (their 64-bit hashes) is cut into fragments. A first pass over the fragments finds
the n-grams that several documents have; a document that shares fewer than the threshold's part of its set
can't link and leaves. Copies of one set become one node. A second pass counts each n-gram's nodes and orders
a set by rarity; by the prefix principle, linked sets share an n-gram among the first n - ceil(t n) + 1.
Candidate pairs meet in the fragment of such an n-gram. Their overlaps are counted for each
fragment on its own and summed per pair.

Nodes that are connected already are not compared again, so a large group of near copies costs rows in
proportion to its size: groups emit pairs in rings of growing distance, components are formed in between,
and the rounds end when every candidate pair is compared or lies within one component. Documents' n-grams
travel as packed arrays, and replies return to the batch of documents they came from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandlake.llm.components import connected_components, sizes_for, written
from bandlake.llm.packing import expand, pack, squeeze, unpack
from bandlake.llm.wordbytes import Words, batches, mix64, text_bytes

ROWS = "fragment long, batch string, blob binary"
SEGMENTS = 2
OFTEN = 32
RINGS = (0, 64, 1 << 40)
_BITS = np.uint64(24)


def _ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def _rows(fragment: list, batch: list, blob: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(fragment, pa.int64()), pa.array(batch, pa.string()), pa.array(blob, pa.binary())], ["fragment", "batch", "blob"])


def _cuts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of the n equal ranges of the 64-bit order begins in ascending keys."""
    bounds = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])


def shingles(t: pa.Table, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hash, row) of each row's distinct n-grams of lower-cased words, by ascending hash. A text
    of fewer words has its whole sequence as its one n-gram."""
    words = Words(*text_bytes(t["text"]))
    hashes = words.hashes(lower=True)
    gram, start = words.grams(hashes, n)
    row = words.doc[start]
    count = np.diff(words.first)
    for k in range(1, n):
        at = words.first[:-1][count == k]
        g = np.zeros(len(at), np.uint64)
        for j in range(k):
            g += hashes[at + j] * np.uint64(2 * j + 3)
        gram, row = np.concatenate([gram, mix64(g + np.uint64(k))]), np.concatenate([row, np.flatnonzero(count == k)])
    order = np.lexsort((row, gram)) if n > 1 else np.argsort(gram, kind="stable")
    gram, row = gram[order], row[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (row[1:] != row[:-1])
    return gram[new], row[new]


def _scatter(name: str, header: pa.Table, gram: np.ndarray, row: np.ndarray, n_fragments: int, number: int) -> Iterator[pa.RecordBatch]:
    yield _rows([-1 - number], [name], [_ipc(header)])
    cuts = _cuts(gram, n_fragments)
    some = [k for k in range(n_fragments) if cuts[k + 1] > cuts[k]]
    yield _rows(some, [name] * len(some), [pack(gram[cuts[k] : cuts[k + 1]], row[cuts[k] : cuts[k + 1]].astype(np.uint64)) for k in some])


def _count_fragment(t: pa.Table) -> pa.Table:
    """Replies to each batch with its n-grams that two rows or more have: the row and the count."""
    if t["fragment"][0].as_py() < 0:
        return t
    parts = [unpack(x.as_py()) for x in t["blob"]]
    keys = np.concatenate([k for k, _ in parts])
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    group = np.cumsum(new) - 1
    count = np.zeros(len(keys), np.uint64)
    count[order] = np.bincount(group)[group] if len(group) else 0
    replies, at = [], 0
    for i, (k, row) in enumerate(parts):
        n = count[at : at + len(k)]
        at += len(k)
        if (some := n > 1).any():
            replies.append((t["fragment"][i].as_py(), t["batch"][i].as_py(), pack(k[some], row[some] | n[some] << _BITS)))
    return pa.Table.from_batches([_rows([r[0] for r in replies], [r[1] for r in replies], [r[2] for r in replies])])


def _gather(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """(header, n-gram, row, count) of a batch, ordered by row, then rarity."""
    rows = dict(zip(t["fragment"].to_pylist(), t["blob"], strict=True))
    header = pa.ipc.open_stream(rows.pop(min(rows)).as_py()).read_all()
    parts = [unpack(x.as_py()) for x in rows.values()]
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, np.uint64)
    value = np.concatenate([v for _, v in parts]) if parts else np.zeros(0, np.uint64)
    row, count = (value & np.uint64((1 << 24) - 1)).astype(np.int64), value >> _BITS
    order = np.lexsort((keys, count, row))
    return header, keys[order], row[order], count[order]


def _lists(keys: np.ndarray, row: np.ndarray, keep: np.ndarray) -> pa.Array:
    """The keys of each row that is kept, as lists."""
    some = keep[row]
    ends = np.concatenate([[0], np.cumsum(np.bincount(row[some], minlength=len(keep))[keep])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[some].view(np.int64)))


def _shared_sets(docs: DataFrame, n: int, percent: int, n_fragments: int, batch_bytes: int) -> DataFrame:
    """Every document's set size, and the shared n-grams of those that can link."""

    def scatter(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for seq, t in enumerate(batches(stream, "text", batch_bytes)):
            gram, row = shingles(t, n)
            digest = [np.zeros(t.num_rows, np.uint64) for _ in range(2)]
            for i, d in enumerate(digest):
                np.add.at(d, row, mix64(gram + np.uint64(i * 7919 + 1)))
            header = pa.table({"doc_id": t["doc_id"], "n": np.bincount(row, minlength=t.num_rows), "sid": digest[0].view(np.int64), "check": digest[1].view(np.int64)})
            yield from _scatter(f"{part}-{seq}", header, gram, row, n_fragments, part * 1009 + seq)

    def gather(t: pa.Table) -> pa.Table:
        header, keys, row, _ = _gather(t)
        size = np.asarray(header["n"])
        own = np.bincount(row, minlength=len(size))
        keep = (own * 100 >= size * percent) & (size > 0)
        at = np.cumsum(keep) - 1
        grams = _lists(keys, row, keep).take(pa.array(np.where(keep, at, 0), mask=~keep)) if keep.any() else pa.nulls(len(size), pa.list_(pa.int64()))
        return header.append_column("grams", grams)

    return docs.mapInArrow(scatter, ROWS).groupBy("fragment").applyInArrow(_count_fragment, ROWS).groupBy("batch").applyInArrow(gather, "doc_id long, n long, sid long, check long, grams array<long>")


def _ordered_sets(nodes: DataFrame, percent: int, n_fragments: int) -> DataFrame:
    """Nodes that share enough n-grams with other nodes: the set by rarity, and the prefix's length."""

    def scatter(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in stream:
            for at in range(0, batch.num_rows, 4096):
                t = pa.Table.from_batches([batch.slice(at, 4096)])
                lists = t["grams"].combine_chunks()
                gram, row = np.asarray(lists.flatten()).view(np.uint64), np.asarray(pa.compute.list_parent_indices(lists)).astype(np.int64)
                order = np.argsort(gram, kind="stable")
                yield from _scatter(f"{part}-{seq}", t.select(["sid", "n"]), gram[order], row[order], n_fragments, part * 1009 + seq)
                seq += 1

    def gather(t: pa.Table) -> pa.Table:
        header, keys, row, count = _gather(t)
        size = np.asarray(header["n"])
        own = np.bincount(row, minlength=len(size))
        least = -(-size * percent // 100)
        prefix, keep = own - least + 1, own >= least
        bits = np.zeros((len(size), 4), np.uint64)
        place = mix64(keys) >> np.uint64(56)
        np.bitwise_or.at(bits, (row, (place >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (place & np.uint64(63)))
        sketch = pa.ListArray.from_arrays(pa.array(np.arange(int(keep.sum()) + 1, dtype=np.int32) * 4), pa.array(bits[keep].view(np.int64).reshape(-1)))
        # the first two n-grams of the prefix that OFTEN nodes or more have, 0 for none
        often = np.flatnonzero((count >= OFTEN) & (np.arange(len(row)) - (np.cumsum(own) - own)[row] < prefix[row]))
        leads = np.zeros((2, len(size)), np.int64)
        if len(often):
            rank = np.arange(len(often)) - np.searchsorted(row[often], row[often])
            for k in range(2):
                leads[k, row[often[rank == k]]] = keys[often[rank == k]].view(np.int64)
        found = header.filter(pa.array(keep)).append_column("grams", _lists(keys, row, keep)).append_column("prefix", pa.array(prefix[keep].astype(np.int32)))
        found = found.append_column("alone", pa.array((size - own)[keep])).append_column("bits", sketch)
        return found.append_column("lead", pa.array(leads[0][keep])).append_column("next", pa.array(leads[1][keep]))

    return nodes.mapInArrow(scatter, ROWS).groupBy("fragment").applyInArrow(_count_fragment, ROWS).groupBy("batch").applyInArrow(gather, "sid long, n long, grams array<long>, prefix int, alone long, bits array<long>, lead long, next long")


def _candidates(nodes: DataFrame, percent: int, n_fragments: int, ring: int) -> DataFrame:
    """Pairs (a, b) of nodes in different components that share a prefix n-gram: all of them for groups with
    at most four times as many pairs as nodes, else those up to `ring` apart. Nodes are ordered by the n-grams that only
    they have; ring 0 pairs each with its neighbour and with the first, the likeliest origin of its copies. A pair 0, 0
    says that more are left.
    Pairs are left out if they can't link: n-grams that no other node has, and bits that differ in the sketches
    of the shared n-grams, are a lower bound of the sets' difference."""

    def scatter(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            lists = batch.column("head")
            gram, row = np.asarray(lists.flatten()).view(np.uint64), np.asarray(pa.compute.list_parent_indices(lists)).astype(np.int64)
            order = np.argsort(gram, kind="stable")
            gram, row = gram[order], row[order]
            cuts = _cuts(gram, n_fragments)
            bits = np.asarray(batch.column("bits").flatten()).reshape(-1, 4)
            columns = [*(np.asarray(batch.column(c)) for c in ("sid", "component", "n", "alone", "lead", "next")), *bits.T]
            some = [k for k in range(n_fragments) if cuts[k + 1] > cuts[k]]
            yield _rows(some, [""] * len(some), [squeeze(b"".join([gram[cuts[k] : cuts[k + 1]].tobytes(), *(c[row[cuts[k] : cuts[k + 1]]].tobytes() for c in columns)])) for k in some])

    def pairs(t: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(expand(x.as_py()), np.int64).reshape(11, -1) for x in t["blob"]]
        gram, sid, component, n, alone, lead, next_, *bits = np.concatenate(blocks, axis=1)
        order = np.lexsort((mix64(sid.view(np.uint64)), alone, gram))
        gram, sid, component, n, alone = gram[order], sid[order], component[order], n[order], alone[order]
        lead, next_, bits = lead[order], next_[order], [x[order].view(np.uint64) for x in bits]
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(gram)))
        group = np.repeat(np.arange(len(starts)), sizes)
        by = np.lexsort((component, group))
        same = np.concatenate([[True], (component[by][1:] != component[by][:-1]) | (group[by][1:] != group[by][:-1])]) if len(by) else np.zeros(0, bool)
        run = np.diff(np.append(np.flatnonzero(same), len(by)))
        within = np.bincount(group[by][same], weights=(run.astype(float) ** 2), minlength=len(starts))
        across = (sizes.astype(float) ** 2 - within) / 2
        reach = np.where(across <= np.maximum(8, 4 * sizes * (ring > 0)), sizes - 1, np.minimum(max(1, ring), sizes - 1))
        reach[across == 0] = 0
        left = bool(((reach < sizes - 1) & (across > 0)).any())
        found, active = [np.zeros((2, 0), np.int64)], np.arange(len(gram))
        reach_of, at = reach[group], np.arange(len(gram)) - starts[group]
        for o in range(int(ring > 0), int(reach.max()) + 1 if len(reach) else 1):
            if o:
                active = active[(reach_of[active] >= o) & (at[active] + o < sizes[group[active]])]
                i, j = active, active + o
            else:
                j = np.flatnonzero(at > 1)
                i = starts[group[j]]
            most = (100 - percent) * (n[i] + n[j])
            ok = (component[i] != component[j]) & ((alone[i] + alone[j]) * (100 + percent) <= most)
            # a pair that shares a lead is found there, once
            none = np.iinfo(np.int64).max
            both = [np.where((x[i] != 0) & ((x[i] == lead[j]) | (x[i] == next_[j])), x[i], none) for x in (lead, next_)]
            home = np.minimum(*both)
            ok &= (home == none) | (home == gram[i])
            i, j, most = i[ok], j[ok], most[ok]
            differ = alone[i] + alone[j] + sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int64) for x in bits)
            ok = differ * (100 + percent) <= most
            a, b = sid[i[ok]], sid[j[ok]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            if len(found) > 256:
                found = [np.unique(np.concatenate(found, axis=1), axis=1)]
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"a": np.append(a, 0) if left else a, "b": np.append(b, 0) if left else b})

    n_fragments = max(1, n_fragments // 4)
    heads = nodes.select("sid", "component", "n", "alone", "lead", "next", "bits", F.slice("grams", 1, F.col("prefix")).alias("head"))
    return heads.mapInArrow(scatter, ROWS).groupBy("fragment").applyInArrow(pairs, "a long, b long").distinct()


def _links(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that reach the threshold: overlaps counted segment by segment of the n-gram order, summed per pair."""
    parts = F.expr(f"transform(sequence(0, {SEGMENTS - 1}), i -> filter(grams, g -> shiftrightunsigned(g, {65 - SEGMENTS.bit_length()}) = i))")
    segments = nodes.select("sid", "n", F.posexplode(parts).alias("segment", "part"))
    one = segments.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), "segment", F.col("part").alias("x"))
    two = segments.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), "segment", F.col("part").alias("y"))
    every = pairs.select("a", "b", F.explode(F.array(*(F.lit(i) for i in range(SEGMENTS)))).alias("segment"))
    met = every.join(one, ["a", "segment"]).join(two, ["b", "segment"])
    summed = met.groupBy("a", "b").agg(F.sum(F.size(F.array_intersect("x", "y"))).alias("overlap"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    return summed.where(f"100 * overlap >= {percent} * (n_a + n_b - overlap)")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """(documents, links): documents has doc_id, n_shingles and component_id, one row per input row; links has the
    node pairs (a, b) found to reach the threshold, with overlap and sizes, enough of them to connect every component.

    Two texts link when 100 * intersection >= percent * union of their sets of n consecutive words (ASCII letters
    lower-cased, words are runs without ASCII white space). Fewer than n words make one n-gram; a null, empty or
    blank text has an empty set and links with nothing, its component is its own id. Repeated rows and texts with
    equal sets share a component. Rows with a null id take part; component_id is the smallest id that isn't null.
    Other columns are not read. Links between sets that are already connected need not be listed. The input must
    give the same rows in the same order when a lost partition is computed again, as files do.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    n_fragments, _, batch_bytes = sizes_for(docs)
    sets = written(_shared_sets(docs, n, percent, n_fragments, batch_bytes), "sets")
    shared = sets.where("grams is not null")
    nodes = written(_ordered_sets(shared.dropDuplicates(["sid", "check"]).select("sid", "n", "grams"), percent, n_fragments), "nodes")
    links, compared, component = None, None, None
    for ring in RINGS:
        current = nodes.withColumn("component", F.col("sid")) if component is None else nodes.join(component.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        pairs = written(_candidates(current, percent, n_fragments, ring), "pairs")
        fresh = pairs.where("a <> b")
        more = bool(pairs.where("a = 0 and b = 0").take(1))
        if compared is not None:
            fresh = written(fresh.join(compared, ["a", "b"], "left_anti"), "fresh")
        if fresh.take(1):
            found = written(_links(fresh, nodes, percent), "links")
            links = found if links is None else links.unionByName(found)
            compared = fresh if compared is None else compared.unionByName(fresh)
            component = written(connected_components(links.select("a", "b")), "components")
        if not more:
            break
    base = sets.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid"))
    if component is None:
        component = spark.createDataFrame([], "node long, component long")
        links = spark.createDataFrame([], "a long, b long, overlap long, n_a long, n_b long")
    ids = sets.where("grams is not null").groupBy("sid").agg(F.min("doc_id").alias("low"))
    joined = ids.join(component.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    classes = joined.join(joined.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("sid", "component_id")
    named = base.join(classes, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return named, links
