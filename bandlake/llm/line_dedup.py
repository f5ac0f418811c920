"""Line dedup: segment-partition edit join.

Lines within `edits` edits of each other are repeats. A line is split into edits + 1 segments, of which one at least
survives in any line that near; segments are indexed by line length and number, and a line probes the
indexes of the lengths it can match with the substrings that the multi-match-aware rule leaves. Candidates whose
sketches of characters and character pairs differ too much are dropped, the others are verified by banded bit-parallel
edit distance. Linked lines form components, and the first line of a component, by document and place, stays.

Exactly equal lines are one node. Nodes that are connected already are not compared again: groups of candidates
are compared in rings of growing distance with components in between, as in the n-gram join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandlake.llm.components import connected_components, sizes_for, written
from bandlake.llm.packing import expand, squeeze
from bandlake.llm.wordbytes import batches, mix64

EDITS, LEAST_LENGTH = 2, 20
RINGS = (0, 64, 1 << 40)
BROADCAST_LINES = 1_000_000
CHARACTER_BITS, PAIR_BITS = 15, 47
_BLANK = r" \t\r\u000b\u000c"  # in a SQL literal; \f would be the letter f there
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _padded(texts: list[str], before: int, after: int) -> tuple[np.ndarray, np.ndarray]:
    """(code points, lengths): a row per text between `before` and `after` columns that equal no character."""
    length = np.array([len(x) for x in texts], np.int64)
    out = np.full((len(texts), before + int(length.max(initial=0)) + after), 0xFFFFFFFF, np.uint32)
    row = np.repeat(np.arange(len(texts)), length)
    out[row, before + np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out, length


def edits_within(left: list[str], right: list[str], k: int, cells: int = 1 << 20) -> np.ndarray:
    """Which pairs have a Levenshtein distance of at most k: bit-parallel columns of a band 2k + 1 wide around the diagonal, of many pairs at once."""
    out = np.zeros(len(left), bool)
    short = np.array([min(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64)
    long = np.array([max(len(x), len(y)) for x, y in zip(left, right, strict=True)], np.int64)
    near = np.flatnonzero(long - short <= k)
    near = near[np.argsort(-short[near], kind="stable")]
    at = 0
    while at < len(near):
        block = near[at : at + max(1, cells // (int(short[near[at]]) + 1))]
        at += len(block)
        a, n = _padded([max(left[i], right[i], key=len) for i in block], k, k + 1)
        b, m = _padded([left[i] if len(left[i]) < len(right[i]) else right[i] for i in block], 0, 1)
        width = 2 * k + 1
        full, top = (1 << width) - 1, 1 << (width - 1)
        # bit r of column c stands for row c - k + r of the pattern; positive and negative vertical steps
        up, down = np.full(len(block), (full << k) & full), np.zeros(len(block), np.int64)
        distance = np.where(m > 0, k, n)
        for c in range(int(m.max(initial=0))):
            live = int(np.searchsorted(-m, -c))  # texts are sorted by length: these have a character here
            match = np.zeros(live, np.int64)
            for r in range(width):
                match |= (a[:live, c + r] == b[:live, c]).astype(np.int64) << r
            u, d = up[:live], down[:live]
            zero = ((((match & u) + u) ^ u) | match | d) & full
            plus, minus = d | (full & ~(zero | u)), zero & u
            # the band's last row; once it is below the pattern, follow the pattern's last row instead
            below = c + k - n[:live]
            last = np.left_shift(1, np.maximum(0, width - 2 - below))
            distance[:live] += np.where(below < 0, (zero & top) == 0, ((plus & last) > 0).astype(np.int64) - ((minus & last) > 0))
            shifted = zero >> 1
            up[:live], down[:live] = minus | (full & ~(shifted | plus)), shifted & plus
        out[block] = distance <= k
    return out


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, row, place, h and line (blanks at its ends cut off) of every line that isn't blank."""
    lines = docs.where("text is not null").select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    return lines.withColumn("line", F.expr(f"btrim(line, '{_BLANK}')")).where("line <> ''").withColumn("h", F.xxhash64("line"))


def _segments(length: np.ndarray, i: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, size) of segment i of lines of these lengths; the later segments are the longer ones."""
    n = edits + 1
    size, extra = length // n, length % n
    return i * size + np.maximum(0, i - (n - extra)), size + (i >= n - extra)


def _keys(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, line, kind: 0 indexed or 1 probed) of all entries, and each line's sketch: parities of its characters in the
    low bits, of its pairs of neighbouring characters above."""
    length = np.array([len(x) for x in lines], np.int64)
    start = np.cumsum(length) - length
    c = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    power = np.ones(len(c) + 1, np.uint64)
    power[1:] = _BASE
    np.cumprod(power, out=power)
    back = np.ones(len(c) + 1, np.uint64)
    back[1:] = _INVERSE
    np.cumprod(back, out=back)
    total = np.zeros(len(c) + 1, np.uint64)
    np.cumsum((c + np.uint64(1)) * power[:-1], out=total[1:])
    one = np.uint64(1)
    bit = one << ((mix64(c) >> np.uint64(32)) * np.uint64(CHARACTER_BITS) >> np.uint64(32))
    pair = mix64(c[:-1] * np.uint64(0x10FFFF1) + c[1:])
    pair = np.append(one << ((pair >> np.uint64(32)) * np.uint64(PAIR_BITS) >> np.uint64(32)) + np.uint64(CHARACTER_BITS), np.zeros(1, np.uint64))
    pair[(start + length - 1)[length > 0]] = 0  # the pair would reach into the next line
    parity = np.bitwise_xor.reduceat(bit ^ pair[: len(c)], start).astype(np.int64) if len(lines) else np.zeros(0, np.int64)

    def key(row: np.ndarray, at: np.ndarray, size: np.ndarray, of: np.ndarray, i: int) -> np.ndarray:
        s = start[row] + at
        value = (total[s + size] - total[s]) * back[s]
        return mix64(value + of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(i + 1) * np.uint64(0xA24BAED4963EE407))

    keys, rows, kinds = [], [], []
    every = np.arange(len(lines))
    for i in range(edits + 1):
        at, size = _segments(length, i, edits)
        keys.append(key(every, at, size, length, i))
        rows.append(every)
        kinds.append(np.zeros(len(every), np.int64))
        for gap in range(edits + 1):
            of = length - gap
            at, size = _segments(of, i, edits)
            low = np.maximum(at - i, at + gap - (edits - i))
            high = np.minimum(at + i, at + gap + (edits - i))
            for step in range(2 * edits + 1):
                p = low + step
                ok = (p <= high) & (p >= 0) & (p + size <= length)
                keys.append(key(every[ok], p[ok], size[ok], of[ok], i))
                rows.append(every[ok])
                kinds.append(np.ones(int(ok.sum()), np.int64))
    return np.concatenate(keys), np.concatenate(rows), np.concatenate(kinds), parity


def _entries(lines: DataFrame, edits: int, n_fragments: int, batch_bytes: int) -> DataFrame:
    """Index entries and probes (key, h, sketch, kind) whose key several lines have."""

    def scatter(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches(stream, "line", batch_bytes):
            h = np.asarray(t["h"])
            _, first = np.unique(h, return_index=True)
            t = t.take(pa.array(first))
            h = h[first]
            key, row, kind, sketch = _keys(t["line"].to_pylist(), edits)
            fragment = ((key >> np.uint64(32)) * np.uint64(n_fragments) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((key, fragment))
            cut = np.flatnonzero(np.diff(fragment[order])) + 1
            parts = [p for p in np.split(order, cut) if len(p)]
            yield pa.RecordBatch.from_arrays([
                pa.array([int(fragment[p[0]]) for p in parts], pa.int64()),
                pa.array([squeeze(key[p].tobytes() + h[row[p]].tobytes() + (sketch[row[p]] << 1 | kind[p]).tobytes()) for p in parts], pa.binary()),
            ], ["fragment", "blob"])

    def shared(t: pa.Table) -> pa.Table:
        parts = [expand(x.as_py()) for x in t["blob"]]
        key, h, rest = np.concatenate([np.frombuffer(p, np.int64).reshape(3, -1) for p in parts], axis=1)
        key = key.view(np.uint64)
        order = np.lexsort((rest, h, key))
        key, h, rest = key[order], h[order], rest[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (h[1:] != h[:-1]) | (rest[1:] != rest[:-1])
        key, h, rest = key[new], h[new], rest[new]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        ends = np.append(starts[1:], len(key))
        probes = np.add.reduceat(rest & 1, starts)
        live = (h[starts] != h[ends - 1]) & (probes > 0) & (probes < ends - starts)
        keep = np.repeat(live, ends - starts)
        return pa.table({"key": key[keep].view(np.int64), "h": h[keep], "sketch": rest[keep] >> 1, "kind": rest[keep] & 1})

    blobs = lines.select("h", "line").mapInArrow(scatter, "fragment long, blob binary")
    return blobs.groupBy("fragment").applyInArrow(shared, "key long, h long, sketch long, kind long")


def _pairs(entries: DataFrame, edits: int, n_fragments: int, ring: int) -> DataFrame:
    """Pairs of lines in different components, one indexed and one probed under a key, up to `ring` apart in the key's
    group, whose sketches differ in at most 2 bits of characters and 4 of pairs for each edit. Ring 0 pairs each line of a large group with its neighbour and with
    the group's likeliest origin. A pair 0, 0 says that more are left."""

    low_bits = np.int64((1 << CHARACTER_BITS) - 1)

    def near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        differ = x ^ y
        return (np.bitwise_count(differ & low_bits) <= 2 * edits) & (np.bitwise_count(differ >> CHARACTER_BITS) <= 4 * edits)

    def scatter(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            a = np.stack([np.asarray(batch.column(c)) for c in ("key", "h", "sketch", "kind", "component")])
            fragment = (mix64(a[0].view(np.uint64)) >> np.uint64(32)).astype(np.int64) * n_fragments >> 32
            order = np.argsort(fragment, kind="stable")
            cut = np.flatnonzero(np.diff(fragment[order])) + 1
            parts = [p for p in np.split(order, cut) if len(p)]
            yield pa.RecordBatch.from_arrays([pa.array([int(fragment[p[0]]) for p in parts], pa.int64()), pa.array([squeeze(a[:, p].tobytes()) for p in parts], pa.binary())], ["fragment", "blob"])

    def pairs(t: pa.Table) -> pa.Table:
        key, h, sketch, kind, component = np.concatenate([np.frombuffer(expand(x.as_py()), np.int64).reshape(5, -1) for x in t["blob"]], axis=1)
        order = np.lexsort((mix64(h.view(np.uint64)), key))
        key, h, sketch, kind, component = key[order], h[order], sketch[order], kind[order], component[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(starts, len(key)))
        group = np.repeat(np.arange(len(starts)), size)
        at, end = np.arange(len(key)) - starts[group], size[group]
        low, high = np.minimum.reduceat(component, starts), np.maximum.reduceat(component, starts)
        several = (low != high)[group]
        reach = np.minimum(np.where(end <= (64 if ring else 8), 64, max(1, ring)), end - 1)
        left = bool((several & (reach < end - 1)).any())
        found, active = [np.zeros((2, 0), np.int64)], np.flatnonzero(several)
        if not ring and len(key):  # each with the line that is nearest to the group's common sketch, the likeliest origin
            common = sum((np.add.reduceat(sketch >> b & 1, starts) * 2 > size).astype(np.int64) << b for b in range(CHARACTER_BITS + PAIR_BITS))
            far = np.bitwise_count(sketch ^ common[group]).astype(np.int64)
            origin = np.minimum.reduceat(far << 40 | np.arange(len(key)), starts) & ((1 << 40) - 1)
            j = np.flatnonzero(several & (reach < end - 1))
            i = origin[group[j]]
            ok = (component[i] != component[j]) & near(sketch[i], sketch[j])
            a, b = h[i[ok]], h[j[ok]]
            found.append(np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1))
        o = 0
        while len(active):
            o += 1
            active = active[(at[active] + o < end[active]) & (reach[active] >= o)]
            i, j = active, active + o
            ok = (component[i] != component[j]) & (kind[i] != kind[j]) & near(sketch[i], sketch[j])
            a, b = h[i[ok]], h[j[ok]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            if len(found) > 256:
                found = [np.unique(np.concatenate(found, axis=1), axis=1)]
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"a": np.append(a, 0) if left else a, "b": np.append(b, 0) if left else b})

    return entries.mapInArrow(scatter, "fragment long, blob binary").groupBy("fragment").applyInArrow(pairs, "a long, b long").distinct()


def _texts(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """(h, line) of every line with an entry, once, so that the rings don't go through the documents again."""
    nodes = written(entries.select("h").distinct(), "nodes")
    nodes = F.broadcast(nodes) if nodes.count() <= BROADCAST_LINES else nodes
    return written(lines.select("h", "line").join(nodes, "h", "left_semi").dropDuplicates(["h"]), "lines")


def _verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y")), "b")

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in stream:
            ok = edits_within(t.column("x").to_pylist(), t.column("y").to_pylist(), edits)
            yield t.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "x", "y").mapInArrow(task, "a long, b long")


def line_classes(docs: DataFrame, edits: int = EDITS, least_length: int = LEAST_LENGTH) -> tuple[DataFrame, DataFrame]:
    """(lines, classes): every line's doc_id, row, place and h, and (h, component) of the lines that have near lines."""
    spark = docs.sparkSession
    n_fragments, _, batch_bytes = sizes_for(docs)
    lines = _lines(docs)
    long = lines.where(f"length(line) >= {least_length}")
    entries = written(_entries(long, edits, n_fragments, batch_bytes // 2), "entries")
    texts = _texts(entries, long)
    component = links = compared = None
    for ring in RINGS:
        current = entries.withColumn("component", F.col("h")) if component is None else entries.join(component.withColumnRenamed("node", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
        pairs = written(_pairs(current, edits, n_fragments, ring), "pairs")
        fresh, more = pairs.where("a <> b"), bool(pairs.where("a = 0 and b = 0").take(1))
        if compared is not None:
            fresh = written(fresh.join(compared, ["a", "b"], "left_anti"), "fresh")
        if fresh.take(1):
            found = written(_verified(fresh, texts, edits), "links")
            links = found if links is None else links.unionByName(found)
            compared = fresh if compared is None else compared.unionByName(fresh)
            component = written(connected_components(links), "components")
        if not more:
            break
    return lines, component if component is not None else spark.createDataFrame([], "node long, component long")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least_length: int = LEAST_LENGTH) -> DataFrame:
    """The input's columns, text without its repeated lines, and n_lines, n_removed, removed_places.

    A line is what stands between newlines; blanks at its ends don't count, blank lines are never removed. Lines of
    at least least_length characters are repeats within `edits` edits of characters, directly or through other
    lines; shorter ones if equal. Of all repeats the first by id and place stays. A null or empty text stays as it
    is. Rows of equal ids don't remove each other's lines at the same place; a null id comes before all others, and rows without an id are told apart by their texts. n_lines counts lines that are
    not blank. Input columns named like a result are replaced.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed", "removed_places")]
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    row = F.when(F.col(id_col).cast("long").isNull(), F.xxhash64(F.col(text_col).cast("string"))).otherwise(F.lit(0).cast("long"))
    rows = docs.select(key.alias("doc_id"), row.alias("row"), F.col(text_col).cast("string").alias("text"))
    lines, near = line_classes(rows, edits, least_length)
    near = near.withColumnRenamed("node", "h")
    places = written(lines.select("doc_id", "row", "place", "h"), "places")
    first = places.groupBy("h").agg(F.min(F.struct("doc_id", "place")).alias("own"), F.count("*").alias("n"))
    named = first.join(near, "h", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "h"))
    low = named.groupBy("component").agg(F.min("own").alias("low"))
    classes = written(named.join(low, "component").select("h", "n", "low"), "classes")
    # lines with over a thousandth of all places, a thousand at most, are broadcast; the others' rows are few each
    often = places.count() // 1000
    marked = places.join(F.broadcast(classes.where(F.col("n") > often).select("h", F.col("low").alias("top"))), "h", "left")
    rest = marked.where("top is null").join(classes.where(F.col("n") <= often).select("h", "low"), "h")
    repeats = marked.where("top is not null").select("doc_id", "row", "place", "h", F.col("top").alias("low")).unionByName(rest.select("doc_id", "row", "place", "h", "low"))
    repeats = repeats.where("struct(doc_id, place) > low").groupBy("doc_id", "row").agg(F.collect_set(F.struct("place", "h")).alias("_gone"))
    joined = docs.select(*columns).withColumn("_id", key).withColumn("_text", row).join(repeats.withColumnsRenamed({"doc_id": "_id", "row": "_text"}), ["_id", "_text"], "left")
    split = joined.withColumn("_lines", F.split(F.col(text_col), "\n"))
    blank = f"btrim(x, '{_BLANK}')"
    # of a row's lines those whose place and content repeat; keys are strings, which Spark's array functions look up by hash
    own = f"transform(filter(array_distinct(transform(array_sort(_gone), g -> g.place)), p -> p < size(_lines)), p -> concat(p, ':', xxhash64({blank.replace('x', '_lines[p]')})))"
    gone = f"transform(array_intersect({own}, transform(_gone, g -> concat(g.place, ':', g.h))), k -> cast(substring_index(k, ':', 1) as int))"
    split = split.withColumn("removed_places", F.when(F.col("_gone").isNotNull(), F.expr(gone)).otherwise(F.array().cast("array<int>")))
    text = F.when(F.size("removed_places") > 0, F.expr("array_join(transform(array_except(sequence(0, size(_lines) - 1), removed_places), i -> _lines[i]), '\n')")).otherwise(F.col(text_col))
    n_lines = F.coalesce(F.expr(f"size(filter(_lines, x -> {blank} <> ''))"), F.lit(0))
    kept = split.withColumn("n_lines", F.greatest(n_lines, F.lit(0)).cast("long")).withColumn("n_removed", F.size("removed_places").cast("long")).withColumn(text_col, text)
    return kept.select(*columns, "n_lines", "n_removed", "removed_places")
