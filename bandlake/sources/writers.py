"""Sinks: partitioned series, corpora, metrics and reports."""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_series(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_corpus(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    """CSV with every value quoted; arrays of labels are joined by spaces."""
    flat = df.select(*(F.array_join(c, " ").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes))
    flat.write.mode(mode).partitionBy(*partition_by).option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_metrics(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def report_lines(df: DataFrame, template: str, *columns: str) -> DataFrame:
    """One formatted line a row (printf style), for write.text."""
    return df.select(F.format_string(template, *columns).alias("value"))


def _mounted(folder: str) -> str:
    """A folder as the workers' own file path: archives are written by file calls, so all workers must have it mounted."""
    path = folder.removeprefix("file://")
    if "://" in path or path.startswith(("hdfs:", "s3:")):
        raise ValueError(f"not a mounted folder: {folder}")
    return path


def write_files(files: DataFrame, folder: str) -> int:
    """Writes (name, content) rows as files of a mounted folder, each at once under its name, and returns their number. A task that runs again writes the same files. Files that
    aren't there afterwards as the driver sees the folder (it is not mounted everywhere) are an error."""
    root = _mounted(folder)

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                path = os.path.join(root, name)
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with open(part, "wb") as f:
                    f.write(content.as_buffer())
                os.replace(part, path)
            yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])

    written = files.select("name", F.col("content").cast("binary").alias("content")).mapInArrow(task, "name string")
    found = written.agg(F.count("*").alias("n"), F.countDistinct("name").alias("names")).first()
    there = sum(not name.endswith(".part") for _, _, names in os.walk(root) for name in names)
    if there < found["names"]:
        raise OSError(f"{found['names']} files were written, but {there} are in {folder}: mount it for the driver and all executors")
    return found["n"]


def npz_archives(samples: DataFrame, rows: int = 1024, label_key: str = "genres") -> DataFrame:
    """(name, content) of compressed archives of `rows` samples: (label, features), features an array of series of one shape, as embeddings (B, F, T) and labels."""

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in stream:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                sink = io.BytesIO()
                np.savez_compressed(sink, **{"embeddings": np.array(some.column("features").to_pylist(), dtype=float), label_key: np.array(some.column("label").to_pylist(), dtype=str)})
                yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{seq:05d}.npz"]), pa.array([sink.getvalue()], pa.binary())], ["name", "content"])
                seq += 1

    return samples.select(F.col("label").cast("string").alias("label"), F.col("features").cast("array<array<double>>").alias("features")).mapInArrow(task, "name string, content binary")


def spectra_archive(spectra: DataFrame) -> bytes:
    """Zero-padded mean spectra (factor, k, frequency, mean: a few thousand rows) as an archive of arrays factor_<f> and freq_<f>."""
    rows = spectra.select("factor", "k", "frequency", "mean").orderBy("factor", "k").collect()
    arrays: dict[str, list[float]] = {}
    for r in rows:
        arrays.setdefault(f"factor_{r['factor']}", []).append(r["mean"])
        arrays.setdefault(f"freq_{r['factor']}", []).append(r["frequency"])
    sink = io.BytesIO()
    np.savez(sink, **arrays)
    return sink.getvalue()


def curve_file(curve: DataFrame, at: str, value: str) -> bytes:
    """A short curve (a value a lag or frequency) as an NPY file, in order of `at`."""
    sink = io.BytesIO()
    np.save(sink, np.array([r[1] for r in curve.select(at, value).orderBy(at).collect()], dtype=float))
    return sink.getvalue()
