"""A corpus of documents from raw to mixed: each stage applies one operator of bandlake.llm to all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandlake.llm.components import written
from bandlake.llm.decontaminate import decontaminate
from bandlake.llm.line_dedup import line_dedup
from bandlake.llm.mixing import mix_sources
from bandlake.llm.ngram_join import ngram_join
from bandlake.llm.toxicity import drop_toxic


def drop_toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which no line is left; n_chars follows the text. Documents without any line stay."""
    found = line_dedup(docs).where("n_lines = 0 or n_removed < n_lines")
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays, once: rows of equal ids or without an id are told apart by a
    hash of the whole row, and one without an id stays if the group has no other. Texts without words are copies of nothing: equal rows of them stay once."""
    keyed = docs.withColumn("_row", F.xxhash64(*(F.col(c) for c in docs.columns)))
    classes = ngram_join(keyed, id_col="_row")[0].select(F.col("doc_id").alias("_row"), "component_id").distinct()
    members = keyed.select("_row", "doc_id").distinct().join(classes, "_row")
    kept = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row")).select("_row")
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or a re-parameterised one, go."""
    leaks = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), by_text=True).where("contaminated").select(F.col("doc_id").alias("_id"), "doc_row").distinct()
    # rows of equal ids, or without one, are told apart by their texts
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["_id"]) & (F.xxhash64(docs["text"]) == leaks["doc_row"]), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document gets its block and place in the mix of sources."""
    return mix_sources(docs)


STAGES = [("toxicity", drop_toxic_documents), ("line_dedup", drop_repeated_lines), ("ngram_jaccard_join", drop_near_copies), ("decontaminate", drop_benchmark_leaks), ("mix_sources", mix)]

#: Classifiers and edit distances are beyond SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
