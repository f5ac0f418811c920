"""Source divergence audit by systolic rotation.

Terms are counted by (language, source) group; a language keeps the terms of enough of its documents. Its terms are dealt
to shards of bounded size and its groups to blocks of bounded bytes, so a vector, however large its group, travels in pieces. Blocks of
compressed vectors stay in the partition of their place, while a copy of each circulates: in every round of a round-robin
tournament a block receives one peer, and the meeting yields the divergences of all pairs of their groups in both directions. Distances add over
shards. What each group says more often than its language is ranked by a heap in the block, then among its shards' heaps.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandlake.llm.components import written
from bandlake.llm.packing import pack, unpack
from bandlake.llm.wordbytes import batches

FLUSH_TERMS = 400_000
SHARD_TERMS, BLOCK_BYTES, LEAST_BLOCKS = 1 << 18, 8 << 20, 6

#: ASCII letters lower-cased, other ASCII as blanks, bytes of other characters as they are.
_TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents) of (lang, source, text) without nulls. Every group also has a row of the term '' and 0 occurrences."""

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> pa.RecordBatch:
            rows = [(lang, source, b"", 0, 0) for lang, source in seen]
            rows += [(*g, w, n, has[w]) for g, (count, has) in seen.items() for w, n in count.items()]
            seen.clear()
            lang, source, term, n, has = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(lang), pa.array(source), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(has, pa.int64())], ["lang", "source", "term", "n", "docs"])

        for t in batches(stream, "text"):
            for lang, source, text in zip(t["lang"].to_pylist(), t["source"].to_pylist(), t["text"], strict=True):
                count, has = seen.setdefault((lang, source), (Counter(), Counter()))
                own = Counter(text.as_buffer().to_pybytes().translate(_TERM_BYTES).split())
                count.update(own)
                has.update(own.keys())
            if sum(len(c) for c, _ in seen.values()) > FLUSH_TERMS:
                yield flush()
        if seen:
            yield flush()

    found = docs.select("lang", "source", "text").mapInArrow(task, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(count: np.ndarray, total: int, scale_digits: int) -> np.ndarray:
    """1 + floor(10^scale_digits * count / total), exact: long division three digits at a time, for totals below 9.2e15."""
    whole, rest = count // total, count % total
    for at in range(0, scale_digits, 3):
        step = 10 ** min(3, scale_digits - at)
        rest = rest * step
        whole, rest = whole * step + rest // total, rest % total
    return whole + 1


def opponent(block: Column, round_: int, blocks: Column) -> Column:
    """The block that `block` meets in a round (circle method): the last place of an even number stays, the others rotate. With an odd number
    the last place is empty, and a number beyond the language's blocks is a bye."""
    m = (blocks + blocks % 2 - 1).cast("long")  # rounds
    other = F.pmod(F.lit(round_) - block, m)
    fixed = F.pmod(F.lit(round_) * ((m + 1) / 2).cast("long"), m)
    return F.when(F.lit(round_) >= m, None).when(block == m, fixed).when(other == block, m).otherwise(other)


def _vectors(counts: DataFrame, groups: DataFrame, shards: DataFrame) -> DataFrame:
    """lang, shard, source, total, vector of every group in every shard of its language: places and counts of its terms, packed. The
    language's own counts have source null."""

    def task(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        blob = pack(t["place"].to_numpy().astype(np.uint64), t["n"].to_numpy().astype(np.uint64))
        return pa.table({"lang": t["lang"][:1], "shard": t["shard"][:1], "source": t["source"][:1], "vector": pa.array([blob], pa.binary())})

    packed = counts.select("lang", "shard", "source", "place", "n").groupBy("lang", "shard", "source").applyInArrow(task, "lang string, shard long, source string, vector binary")
    every = groups.join(shards, "lang")
    on = (every["lang"] == packed["lang"]) & (every["shard"] == packed["shard"]) & every["source"].eqNullSafe(packed["source"])
    return every.join(packed, on, "left").select(every["lang"], every["shard"], every["source"], "total", "terms", "in_shard", F.coalesce("vector", F.lit(pack(np.zeros(0, np.uint64), np.zeros(0, np.uint64)))).alias("vector"))


class _Block:
    """The groups of a block in one shard: names, shares of their terms and of a term that they don't have."""

    def __init__(self, t: pa.Table, smooth: int, digits: int):
        t = t.sort_by("source")
        self.sources, self.vectors, self.absent = t["source"].to_pylist(), [], []
        self.size = t["in_shard"][0].as_py()
        for blob, total, terms in zip(t["vector"], t["total"].to_pylist(), t["terms"].to_pylist(), strict=True):
            place, n = unpack(blob.as_py())
            whole = max(1, total + smooth * terms)
            n = np.zeros(len(place), np.int64) if n is None else n.astype(np.int64)
            self.vectors.append((place.astype(np.int64), shares(n + smooth, whole, digits)))
            self.absent.append(int(shares(np.array([smooth]), whole, digits)[0]))

    def distances(self, other: _Block, same: bool) -> Iterator[tuple[str, str, int]]:
        """Sums of abs(p - q) over the shard's terms for each pair of the two blocks' groups (or of this block's)."""
        for j, (at, q) in enumerate(other.vectors):
            dense = np.full(self.size, other.absent[j], np.int64)
            dense[at] = q
            for i in range(j if same else len(self.vectors)):
                place, p = self.vectors[i]
                zero = self.absent[i]
                rest = int(np.abs(zero - q).sum()) + (self.size - len(q)) * abs(zero - other.absent[j])
                met = dense[place]
                yield self.sources[i], other.sources[j], rest + int((np.abs(p - met) - np.abs(zero - met)).sum())


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 30, smooth: int = 5, scale_digits: int = 9, top: int = 50, shard_terms: int = SHARD_TERMS, block_bytes: int = BLOCK_BYTES, least_blocks: int = LEAST_BLOCKS) -> tuple[DataFrame, DataFrame]:
    """(pairs, terms). pairs: lang, source, item (each other source of the language), value, rank. terms: lang, source, item (a term), value,
    rank of the `top` terms that a source uses more than its language.

    A term is a run of letters and characters beyond ASCII, with A-Z lower-cased; a language keeps those of at least `least_docs` of its documents. A kept term has
    the share 1 + floor(10^scale_digits * (n + smooth) / (N + smooth * V)) of a group or language; value is the difference of two shares, of pairs summed over all
    kept terms. All arithmetic is on integers. Ranks go by value descending, then item in UTF-8 order, so ties have a defined order.

    A null text, language or source counts as ''. Every group that occurs has its pairs, also one without terms; a language that keeps no term has
    distances of 0, one of a single source no pairs. Repeated rows count as documents each. An empty table gives empty results. Other columns are not read.
    """
    if shard_terms < 1 or block_bytes < 1 or least_blocks < 1:
        raise ValueError("shard_terms, block_bytes and least_blocks are at least 1")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = term_counts(docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text")))
    by_term = Window.partitionBy("lang", "term")
    found = found.withColumn("lang_docs", F.sum("docs").over(by_term)).withColumn("lang_n", F.sum("n").over(by_term))
    kept = written(found.where(F.col("term").eqNullSafe("") | (F.col("lang_docs") >= least_docs)).drop("docs", "lang_docs"), "divergence-counts")

    real = kept.where("term <> ''")
    names = real.groupBy("lang", "term").agg(F.max("lang_n").alias("n"))
    sizes = names.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n").alias("lang_total"))
    langs = kept.groupBy("lang").agg(F.countDistinct("source").alias("sources")).join(sizes, "lang", "left").fillna(0, ["terms", "lang_total"])
    langs = written(langs.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("terms") / shard_terms))), "divergence-languages")
    of = F.pmod(F.xxhash64("term"), F.col("shards")).alias("shard")
    in_shard = Window.partitionBy("lang", "shard")
    # a shard's terms are numbered in UTF-8 order, so places break ties as terms do
    names = names.join(langs.select("lang", "shards"), "lang").select("lang", of, "term", "n").withColumn("place", F.row_number().over(in_shard.orderBy("term")) - 1)
    names = written(names, "divergence-terms")
    shards = langs.select("lang", "terms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    shards = shards.join(names.groupBy("lang", "shard").agg(F.count("*").alias("in_shard")), ["lang", "shard"], "left").fillna(0, ["in_shard"])

    counts = real.select("lang", "term", "source", "n").join(names.select("lang", "shard", "term", "place"), ["lang", "term"])
    counts = counts.select("lang", "shard", "source", "place", "n").unionByName(names.select("lang", "shard", F.lit(None).cast("string").alias("source"), "place", "n"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("total")).unionByName(langs.select("lang", F.lit(None).cast("string").alias("source"), F.col("lang_total").alias("total")))
    vectors = written(_vectors(counts, groups, shards), "divergence-vectors")

    heavy = vectors.where("source is not null").groupBy("lang", "shard").agg(F.sum(F.length("vector")).alias("bytes")).groupBy("lang").agg(F.max("bytes").alias("bytes"))
    plan = langs.join(heavy, "lang").select("lang", F.least("sources", F.greatest(F.ceil(F.col("bytes") / block_bytes), F.lit(least_blocks))).cast("long").alias("blocks"))
    # sources are dealt to the blocks in turn
    place = kept.select("lang", "source").distinct().withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("source"), "source")) - 1)
    place = place.join(plan, "lang").select("lang", "source", "blocks", (F.col("i") % F.col("blocks")).alias("block"))
    resident = written(vectors.where("source is not null").join(place, ["lang", "source"]), "divergence-blocks").repartition("lang", "shard", "block").persist()
    whole = vectors.where("source is null").join(plan, "lang").select("lang", "shard", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), "total", "terms", "in_shard", "vector")

    def rows(lang: str, found: list[tuple[str, str, int]]) -> pa.Table:
        both = found + [(b, a, v) for a, b, v in found]
        a, b, v = zip(*both, strict=True) if both else ((), (), ())
        return pa.table({"lang": pa.array([lang] * len(both), pa.string()), "source": pa.array(a, pa.string()), "item": pa.array(b, pa.string()), "value": pa.array(v, pa.int64())})

    def at_home(t: pa.Table) -> pa.Table:
        own = _Block(t, smooth, scale_digits)
        return rows(t["lang"][0].as_py(), list(own.distances(own, True)))

    def meet(own: pa.Table, peer: pa.Table) -> pa.Table:
        if not own.num_rows or not peer.num_rows:
            return rows("", [])
        return rows(own["lang"][0].as_py(), list(_Block(own, smooth, scale_digits).distances(_Block(peer, smooth, scale_digits), False)))

    def heaps(own: pa.Table, lang: pa.Table) -> pa.Table:
        out: list[tuple[str, int, int]] = []
        if own.num_rows and lang.num_rows:
            block = _Block(own, smooth, scale_digits)
            ((at, q),) = _Block(lang.append_column("source", pa.nulls(lang.num_rows, pa.string())), smooth, scale_digits).vectors
            dense = np.zeros(block.size, np.int64)
            dense[at] = q
            for source, (where, p) in zip(block.sources, block.vectors, strict=True):
                f = p - dense[where]
                some = np.flatnonzero(f > 0)
                best = heapq.nsmallest(top, zip((-f[some]).tolist(), where[some].tolist(), strict=True))
                out += [(source, w, -v) for v, w in best]
        source, where, v = zip(*out, strict=True) if out else ((), (), ())
        n = len(out)
        lang_, shard = (own["lang"][0], own["shard"][0]) if own.num_rows else (pa.scalar(""), pa.scalar(0))
        return pa.table({"lang": pa.array([lang_.as_py()] * n, pa.string()), "shard": pa.array([shard.as_py()] * n, pa.int64()), "source": pa.array(source, pa.string()), "place": pa.array(where, pa.int64()), "value": pa.array(v, pa.int64())})

    key, shape = ["lang", "shard", "block"], "lang string, source string, item string, value long"
    try:
        parts = [written(resident.groupBy(*key).applyInArrow(at_home, shape), "divergence-round")]
        best = written(resident.groupBy(*key).cogroup(whole.groupBy(*key)).applyInArrow(heaps, "lang string, shard long, source string, place long, value long"), "divergence-heaps")
        most = plan.agg(F.max("blocks")).first()[0] or 0
        for r in range(most + most % 2 - 1 if most > 1 else 0):
            # a block travels to its opponent's place if that is the smaller one
            visitors = resident.withColumn("host", opponent(F.col("block"), r, F.col("blocks"))).where("host < block").drop("block").withColumnRenamed("host", "block")
            parts.append(written(resident.groupBy(*key).cogroup(visitors.groupBy(*key)).applyInArrow(meet, shape), "divergence-round"))
    finally:
        resident.unpersist()
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = every.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(ranked))
    said = best.join(names.select("lang", "shard", "place", F.col("term").alias("item")), ["lang", "shard", "place"]).select("lang", "source", "item", "value")
    return pairs, said.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
