"""Text encoders: sub-word pieces, trained piece vectors mixed over their surroundings, and a stored cache of encodings.

`train_vectors` learns a vector a piece from a corpus: positive pointwise mutual information with the pieces around it, projected on random signs, which Spark sums
by piece. A PieceEncoder makes hidden states of them; any language model can stand in its place by the same two members (`name`, `rows`).
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlake.functions.subwords import PIECES, Vocabulary, pieces
from bandlake.session import stored

#: Bytes of hidden states that a task makes and hands on at a time.
BLOCK_BYTES = 4 << 20

#: What an encoder adds: pieces and `features`, an array of series (one a dimension, over the pieces).
ENCODED = f"pieces {PIECES}, features array<array<double>>"


def neighbours(ids: Column, window: int) -> Column:
    """Pairs (a, b) of an array's elements that stand at most `window` places apart, a first."""
    n = F.size(ids)
    each = [F.when(n > k, F.arrays_zip(F.slice(ids, 1, F.greatest(n - k, F.lit(1))).alias("a"), F.slice(ids, k + 1, F.greatest(n - k, F.lit(1))).alias("b"))) for k in range(1, window + 1)]
    return F.concat(*(F.coalesce(p, F.array().cast("array<struct<a:int,b:int>>")) for p in each))


def train_vectors(texts: DataFrame, vocabulary: Vocabulary, dims: int = 32, window: int = 2, seed: int = 42) -> np.ndarray:
    """A unit vector for each piece of the vocabulary, learnt from the column `texts` (arrays of texts): sums of random signs of the pieces around it, weighted by
    positive pointwise mutual information. Pieces that don't occur have signs of their own. The driver receives one vector a piece that occurs."""
    if not 0 < dims <= 64:
        raise ValueError("dims is from 1 to 64")
    rows = texts.select(pieces(F.col("texts"), vocabulary)["ids"].alias("ids"))
    pairs = rows.select(F.explode(neighbours(F.col("ids"), window)).alias("p")).select("p.a", "p.b").groupBy("a", "b").agg(F.count("*").alias("n"))
    pairs = stored(pairs, "pairs")  # read eight times below: the texts are split once
    both = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "n").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "n"))
    both = both.groupBy("x", "y").agg(F.sum("n").alias("n"))
    single = both.groupBy("x").agg(F.sum("n").alias("m"))
    total = single.agg(F.sum("m").cast("double").alias("total"))
    joined = both.join(single, "x").join(single.select(F.col("x").alias("y"), F.col("m").alias("my")), "y").crossJoin(F.broadcast(total))
    weight = F.greatest(F.lit(0.0), F.log(F.col("n") * F.col("total") / (F.col("m").cast("double") * F.col("my"))))
    bits = F.xxhash64("y", F.lit(seed))
    sign = lambda d: F.shiftright(bits, d).bitwiseAND(1) * 2 - 1
    summed = joined.withColumn("w", weight).where("w > 0").groupBy("x").agg(*(F.sum(F.col("w") * sign(d)).alias(f"v{d}") for d in range(dims)))
    found = summed.toArrow()
    out = np.where(np.random.default_rng(seed).random((len(vocabulary), dims)) < 0.5, -1.0, 1.0)
    at = found["x"].to_numpy()
    if len(at):
        learnt = np.stack([found[f"v{d}"].to_numpy() for d in range(dims)], axis=1)
        some = np.abs(learnt).max(axis=1) > 0
        out[at[some]] = learnt[some]
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def blocks(sizes: np.ndarray, width: int) -> Iterator[tuple[int, int]]:
    """(first, number) of neighbouring rows that take BLOCK_BYTES at most when each is as long as the longest of them; a longer row is on its own."""
    first, longest = 0, 0
    for i, size in enumerate(sizes.tolist()):
        longest = max(longest, size)
        if i > first and (i + 1 - first) * longest * width > BLOCK_BYTES:
            yield first, i - first
            first, longest = i, size
    if len(sizes) > first:
        yield first, len(sizes) - first


@dataclass
class PieceEncoder:
    """Hidden states of pieces: each its own vector, with what stands before and after it, fading by `fade` a place."""

    vocabulary: Vocabulary
    vectors: np.ndarray
    fade: float = 0.5
    mix: float = 0.5

    @property
    def name(self) -> str:
        content = hashlib.md5(np.ascontiguousarray(self.vectors).tobytes())
        for piece, k in sorted(self.vocabulary.pieces.items()):
            content.update(f"{piece}\x00{k}\n".encode())
        return f"pieces-{content.hexdigest()[:12]}-{self.fade:g}-{self.mix:g}"

    def hidden(self, ids: np.ndarray) -> np.ndarray:
        """(dimensions, pieces) of a text."""
        return self.states(ids, np.array([len(ids)])).T

    def states(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(pieces, dimensions) of texts one after the other, `sizes` pieces each; a step goes through all of them together."""
        longest = int(sizes.max(initial=0))
        inside = np.arange(longest) < sizes[:, None]
        x = np.zeros((len(sizes), longest, self.vectors.shape[1]))
        x[inside] = self.vectors[ids]
        around = np.zeros_like(x)
        for places in (range(longest), range(longest - 1, -1, -1)):
            state = np.zeros((len(sizes), x.shape[2]))
            for i in places:
                around[:, i] += state
                state = self.fade * (state + x[:, i])
        return np.tanh(x[inside] + self.mix * around[inside])

    def share(self, spark: SparkSession) -> Broadcast:
        """What tasks need to make states, a vector a piece of the vocabulary: received() takes it there."""
        return spark.sparkContext.broadcast((self.vectors, self.fade, self.mix))

    @staticmethod
    def received(shared: Broadcast) -> PieceEncoder:
        own = PieceEncoder.__new__(PieceEncoder)
        own.vectors, own.fade, own.mix = shared.value
        return own

    def content_states(self, ids: np.ndarray, sizes: np.ndarray, special: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """states() without those of special pieces, and how many each text has left."""
        keep = ~special
        before, ends = np.concatenate([[0], np.cumsum(keep)]), np.cumsum(sizes)
        return self.states(ids, sizes)[keep], before[ends] - before[ends - sizes]

    def _features(self, ids: pa.Array, special: pa.Array | None = None) -> pa.Array:
        """Hidden states of an array of lists of pieces: an array of series, one a dimension, for each. With `special`, those pieces have none."""
        sizes = np.asarray(pa.compute.list_value_length(ids).fill_null(0)).astype(np.int64)
        valid, dims = np.asarray(ids.is_valid()), self.vectors.shape[1]
        flat_ids = np.asarray(ids.flatten()).astype(np.int64)
        if special is None:
            found = self.states(flat_ids, sizes)
        else:
            found, sizes = self.content_states(flat_ids, sizes, special.flatten().to_numpy(zero_copy_only=False).astype(bool))
        flat = [s.T.reshape(-1) for s in np.split(found, np.cumsum(sizes)[:-1])] if len(sizes) else [found.reshape(-1)]
        inner = np.concatenate([[0], np.cumsum(np.repeat(sizes[valid], dims))]).astype(np.int32)
        outer = np.concatenate([[0], np.cumsum(valid * dims)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(outer), pa.ListArray.from_arrays(pa.array(inner), pa.array(np.concatenate(flat))), mask=pa.array(~valid))

    def rows(self, df: DataFrame, limit: int | None = None) -> DataFrame:
        """df with `pieces` and `features` of its column `texts`."""
        return self.with_features(df.withColumn("pieces", pieces(F.col("texts"), self.vocabulary, limit)))

    def with_features(self, df: DataFrame, specials: bool = True) -> DataFrame:
        """df with `features` of its column `pieces` (ids and special), of begins and ends too or not."""
        shared = self.share(df.sparkSession)
        names = [*df.columns, "features"]

        def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = PieceEncoder.received(shared)
            for batch in stream:
                ids, special = (pa.compute.struct_field(batch.column("pieces"), n) for n in ("ids", "special"))
                for at, n in blocks(np.asarray(pa.compute.list_value_length(ids).fill_null(0)), 8 * own.vectors.shape[1]):
                    part = batch.slice(at, n)
                    yield pa.RecordBatch.from_arrays([*part.columns, own._features(ids.slice(at, n), None if specials else special.slice(at, n))], names)

        shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), "features array<array<double>>"])
        return df.mapInArrow(task, shape)


def kept(encoded: Column) -> Column:
    """The number of pieces that are neither begins nor ends; 0 for null."""
    return F.coalesce(F.size(F.filter(encoded["special"], lambda s: ~s)), F.lit(0))


def text_key(texts: Column) -> Column:
    """md5 of an array of texts; arrays that differ in any text, also in how texts are cut, have different keys."""
    return F.md5(F.to_json(F.struct(texts.alias("t"))))


class EncodingCache:
    """Encodings kept as a table, a folder an encoder (and limit): texts that were encoded before, by any run, are read instead."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.added = spark, path, 0
        self._schema = f"key string, {ENCODED}, run string, encoder string"
        spark.createDataFrame([], self._schema).write.mode("append").partitionBy("encoder").parquet(path)

    def stored(self, encoder, limit: int | None = None) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.path).where(F.col("encoder") == self._folder(encoder, limit))

    @staticmethod
    def _folder(encoder, limit: int | None) -> str:
        return f"{encoder.name}-{limit or 'whole'}"

    def encode(self, df: DataFrame, encoder, limit: int | None = None) -> DataFrame:
        """encoder.rows(df, limit), of which only new texts are encoded; `added` says how many. Each distinct text is encoded once. Runs at the same
        time may both add a text; one of its rows is then read."""
        keyed = df.withColumn("_key", text_key(F.col("texts")))
        known = self.stored(encoder, limit).select(F.col("key").alias("_key"))
        fresh = keyed.select("_key", "texts").where("texts is not null").dropDuplicates(["_key"]).join(known, "_key", "left_anti")
        run = uuid.uuid4().hex
        made = encoder.rows(fresh, limit).select(F.col("_key").alias("key"), "pieces", "features", F.lit(run).alias("run"), F.lit(self._folder(encoder, limit)).alias("encoder"))
        made.write.mode("append").partitionBy("encoder").parquet(self.path)
        self.added = self.stored(encoder, limit).where(F.col("run") == run).count()
        kept = self.stored(encoder, limit).select(F.col("key").alias("_key"), "pieces", "features").dropDuplicates(["_key"])
        return keyed.join(kept, "_key", "left").drop("_key")


def content(encoded: DataFrame, specials: bool = False) -> DataFrame:
    """Encoded rows without the begins and ends: of features and of every list of `pieces`."""
    if specials:
        return encoded
    keep = F.transform("pieces.special", lambda s: ~s)
    take = lambda a: F.transform(F.filter(F.arrays_zip(a.alias("v"), keep.alias("k")), lambda x: x["k"]), lambda x: x["v"])
    names = ("ids", "text", "word", "start", "end", "special")
    parts = F.struct(*(take(F.col(f"pieces.{n}")).alias(n) for n in names))
    return encoded.withColumn("features", F.transform("features", take)).withColumn("pieces", parts)


def piece_labels(labels: Column, word: Column, text: Column) -> Column:
    """The label of each piece: that of its word. Words are numbered on over the texts of a row, which all together have as many as there are labels."""
    before = lambda t: F.aggregate(F.sequence(F.lit(0), t), F.lit(0), lambda a, i: a + F.when(i < t, F.coalesce(F.array_max(F.filter(F.transform(F.arrays_zip(text.alias("t"), word.alias("w")), lambda x: F.when(x["t"] == i, x["w"] + 1)), lambda v: v.isNotNull())), F.lit(0))).otherwise(0))
    return F.transform(F.arrays_zip(word.alias("w"), text.alias("t")), lambda x: F.get(labels, before(x["t"]) + x["w"]))
