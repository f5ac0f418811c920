"""Connected components of a distributed edge table, and tables written between steps."""

from __future__ import annotations

import math
import threading
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandlake.llm.wordbytes import BATCH_BYTES
from bandlake.session import shared_folder

BLOCK_EDGES = 500_000
GROUP_BYTES = 24 << 20
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LOCK = threading.Lock()
_WRITTEN: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    to_be_deleted(path)
    with _LOCK:  # the setting is the session's
        before = spark.conf.get(_CLEAN, "false")
        spark.conf.set(_CLEAN, "true")  # once written, the plan's shuffle files are of no use
        try:
            df.write.parquet(path)
        finally:
            spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def to_be_deleted(path: str) -> str:
    """A folder that delete_written deletes too."""
    _WRITTEN.append(path)
    return path


def delete_written(spark) -> int:
    """Deletes the tables that `written` has made in this process and returns their number; results that still read them must be stored first."""
    n = 0
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n


def sizes_for(docs: DataFrame, text: str = "text") -> tuple[int, int, int]:
    """(groups, bytes of a group, bytes of a batch) to deal the texts' windows, lines or n-grams by: twice the shuffle partitions, or as many as give a group GROUP_BYTES of text. Above a terabyte groups and
    batches grow as the root of the input, so that a batch, a quarter of a group, sends every group about 16 entries or more in a packed row."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long") + 8), F.lit(0))).first()[0]
    group = max(GROUP_BYTES, math.isqrt(560 * size))
    return max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // group)), group, max(BATCH_BYTES, group // 4)


def _forest(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a block as stars around the smallest node of each tree (union-find)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root[y]
        return x

    for t in stream:
        for a, b in zip(t.column("u").to_pylist(), t.column("v").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame, limit: int = 60) -> DataFrame:
    """(node, component) of every node of edges(a, b): the smallest node that it reaches.

    Blocks of BLOCK_EDGES edges are reduced to forests first. If there are several, the large-star and
    small-star steps follow until all edges are stars, which takes about the logarithm of the largest component's
    size. Minima are pre-aggregated before each shuffle.
    """
    e = edges.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    blocks = e.count() // BLOCK_EDGES + 1
    e = written(e.coalesce(blocks).mapInArrow(_forest, "u long, v long"), "edges")
    if blocks == 1:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    for _ in range(limit):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.expr("inline(if(v = m, array(struct(u as x, m as y)), array(struct(v as x, m as y), struct(u as x, m as y))))").alias("u", "v"))
        last, e = e, written(small.distinct(), "edges")
        # both tables hold distinct edges: they are equal if neither has an edge that the other lacks
        if not e.join(last, ["u", "v"], "left_anti").take(1) and not last.join(e, ["u", "v"], "left_anti").take(1):
            break
    else:
        raise RuntimeError("components did not converge")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).groupBy("node").agg(F.min("component").alias("component"))
