"""Readers of the supported inputs, as series tables or corpora. Everything is read by Spark's own readers."""

from __future__ import annotations

import io
import wave
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bandlake.functions.audio import resampled

SERIES = "sample_id long, label string, feature_idx int, series array<double>"
LABEL_KEYS = ("genres", "composers", "labels")


@dataclass(frozen=True)
class EmbeddingConfig:
    """What an embedding set must look like."""

    name: str
    path: str
    channels: int
    segments: int
    steps: int
    label_key: str | None = None

    @property
    def features(self) -> int:
        return self.channels * self.segments

    @property
    def coefficients(self) -> int:
        return self.steps // 2 + 1


_CONFIGS: dict[str, EmbeddingConfig] = {}
_EMBEDDERS: dict[str, Callable[[str], Callable[[bytes], np.ndarray]]] = {}


def register_config(config: EmbeddingConfig) -> None:
    _CONFIGS[config.name] = config


def get_config(name: str) -> EmbeddingConfig:
    if name not in _CONFIGS:
        raise KeyError(f"unknown configuration {name!r}: one of {sorted(_CONFIGS)}")
    return _CONFIGS[name]


def read_npz(spark: SparkSession, path: str, label_key: str | None = None, layout: str = "channel_major", config: EmbeddingConfig | None = None, data_key: str = "embeddings") -> DataFrame:
    """NPZ archives of embeddings (B,F,T), (B,C,S,T) or (B,L,C,S,T) and labels as a series table (with `layer` in the last case, and `source_path`, the archive's file_paths).
    data_key names another array, as dct_coeffs of a coefficient cache. Archives of over 2 GiB are read by read_large_npz.

    feature = channel * segments + segment, or segment * channels + channel with layout="segment_major". sample_id is the row's number, with
    a checksum of the file's name in the high bits. A file is one task's work, as it is one archive; many files spread over the cluster.
    """
    if layout not in ("channel_major", "segment_major"):
        raise ValueError(f"unknown layout {layout!r}")

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                data = np.load(io.BytesIO(content), allow_pickle=False)
                keys = [label_key] if label_key else [k for k in LABEL_KEYS if k in data]
                if data_key not in data or not keys or keys[0] not in data:
                    raise ValueError(f"{name}: needs {data_key} and labels ({label_key or ', '.join(LABEL_KEYS)}), has {sorted(data.files)}")
                x, labels = data[data_key], data[keys[0]].astype(str)
                if x.ndim not in (3, 4, 5) or len(x) != len(labels):
                    raise ValueError(f"{name}: embeddings of shape {x.shape} with {len(labels)} labels")
                if config and x.ndim == 4 and x.shape[1:] != (config.channels, config.segments, config.steps):
                    raise ValueError(f"{name}: shape {x.shape[1:]} is not that of {config.name}")
                if config and x.ndim == 3 and x.shape[1] != config.features:
                    raise ValueError(f"{name}: {x.shape[1]} features are not {config.channels} x {config.segments} of {config.name}")
                paths = data["file_paths"].astype(str) if "file_paths" in data else [None] * len(x)
                layers = data["layers"] if x.ndim == 5 and "layers" in data else np.arange(x.shape[1] if x.ndim == 5 else 1)
                x = x if x.ndim == 5 else x[:, None]
                if x.ndim == 5:
                    x = x if layout == "channel_major" else x.transpose(0, 1, 3, 2, 4)
                    x = x.reshape(*x.shape[:2], -1, x.shape[-1])
                base = zlib.crc32(name.encode()) << 31
                for b in range(len(x)):
                    n = x.shape[1] * x.shape[2]
                    series = x[b].reshape(n, -1).astype(np.float64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(n, base + b)), pa.array([labels[b]] * n), pa.array(np.tile(np.arange(x.shape[2], dtype=np.int32), x.shape[1])),
                        pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * series.shape[1]), pa.array(series.reshape(-1))), pa.array(np.repeat(np.asarray(layers, np.int32), x.shape[2])), pa.array([paths[b]] * n, pa.string()),
                    ], ["sample_id", "label", "feature_idx", "series", "layer", "source_path"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(task, SERIES + ", layer int, source_path string")


def _npy_head(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    version = np.lib.format.read_magic(f)
    return np.lib.format.read_array_header_1_0(f) if version == (1, 0) else np.lib.format.read_array_header_2_0(f)


def read_large_npz(spark: SparkSession, path: str, label_key: str | None = None, data_key: str = "embeddings", rows: int = 256) -> DataFrame:
    """One NPZ archive (B, ...) of any size on a folder that all workers have mounted, as a series table: sample_id is the row's number.

    Tasks take `rows` samples each and stream their part of the member, so memory doesn't depend on the archive; a compressed member is read from its start by every task.
    """
    path = path.removeprefix("file://")
    with zipfile.ZipFile(path) as z, z.open(f"{data_key}.npy") as f:
        shape, fortran, kind = _npy_head(f)
        names = [n.removesuffix(".npy") for n in z.namelist()]
    label_key = label_key or next((k for k in LABEL_KEYS if k in names), None)
    if fortran or len(shape) < 3 or not label_key:
        raise ValueError(f"{path}: needs {data_key} (B, ..., T) in C order and labels, has {names}")
    width, per_row = shape[-1], int(np.prod(shape[1:]))

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for first in batch.column("id").to_pylist():
                labels = np.load(path, allow_pickle=False)[label_key].astype(str)
                with zipfile.ZipFile(path) as z, z.open(f"{data_key}.npy") as f:
                    _npy_head(f)
                    f.seek(f.tell() + first * per_row * kind.itemsize)
                    for b in range(first, min(shape[0], first + rows)):
                        series = np.frombuffer(f.read(per_row * kind.itemsize), kind).astype(np.float64)
                        n = per_row // width
                        yield pa.RecordBatch.from_arrays([pa.array([b] * n, pa.int64()), pa.array([labels[b]] * n), pa.array(np.arange(n, dtype=np.int32)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(series))], ["sample_id", "label", "feature_idx", "series"])

    return spark.range(0, shape[0], rows, numPartitions=max(1, -(-shape[0] // rows))).mapInArrow(task, SERIES)


def read_hierarchical_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with two header lines and an id column: columns named upper_lower."""
    raw = spark.read.csv(path, header=False)
    top, low = raw.limit(2).collect()
    names, last = ["track_id"], ""
    for a, b in zip(top[1:], low[1:], strict=True):
        last = a or last
        names.append(f"{last}_{b}" if b else last)
    rows = raw.toDF(*names).where(F.col("track_id").rlike(r"^\d+$"))
    return rows.withColumn("track_id", F.col("track_id").cast("long"))


def read_corpus_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def read_pairs_tsv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """label, premise, hypothesis of a file of tab-separated lines. Lines that lack one are left out, or with strict are an error that tells their number."""
    rows = spark.read.csv(path, sep="\t", schema="label string, premise string, hypothesis string", quote="")
    if strict and (bad := rows.where("label is null or premise is null or hypothesis is null").count()):
        raise ValueError(f"{bad} lines of {path} lack a label, premise or hypothesis")
    return rows.where("premise is not null and hypothesis is not null")


def read_inference_folder(spark: SparkSession, folder: str) -> DataFrame:
    """split, label, premise, hypothesis of a folder of train_w_filtering.tsv and dev.tsv."""
    parts = [read_pairs_tsv(spark, f"{folder}/{name}.tsv", strict=True).withColumn("split", F.lit(split)) for split, name in (("train", "train_w_filtering"), ("dev", "dev"))]
    return parts[0].unionByName(parts[1])


def read_files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "content")


def pair_annotations(audio: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs of audio and annotation paths by name, audio without annotation)."""
    from bandlake.functions.text import annotation_path

    left = audio.select(F.col("path").alias("audio_path"), F.substring_index(annotation_path(F.col("path")), "/", -1).alias("name"))
    right = annotations.select(F.col("path").alias("annotation_path"), F.substring_index("path", "/", -1).alias("name"))
    return left.join(right, "name"), left.join(right, "name", "left_anti")


def read_jams(spark: SparkSession, path: str) -> DataFrame:
    """path, time, duration, value of each file's first chord annotation."""
    schema = "annotations array<struct<namespace: string, data: array<struct<time: double, duration: double, value: string>>>>"
    raw = spark.read.schema(schema).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("path"), "annotations")
    chords = F.filter("annotations", lambda a: a["namespace"] == "chord")
    return raw.select("path", F.inline(F.get(chords, F.lit(0))["data"]))


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """path, sentence, words, tags, relations of CoNLL-U treebanks; ranges and empty nodes are left out.

    Files with any line ends are read; those with carriage returns as one record each, others split wherever a block begins. `sentence` numbers a file's sentences by content and, among equal ones, by
    count, so it is the same however files are split.
    """
    raw = spark.read.text(path, lineSep="\n\n").select(F.col("_metadata.file_path").alias("path"), F.explode(F.split("value", r"(?:\r?\n){2,}|\r{2,}")).alias("value"))
    rows = F.filter(F.transform(F.split("value", r"\r?\n|\r"), lambda line: F.split(line, "\t")), lambda c: F.get(c, F.lit(0)).rlike(r"^\d+$") & (F.size(c) >= 8))
    at = lambda i: F.transform("rows", lambda c: F.get(c, F.lit(i)))
    found = raw.withColumn("rows", rows).where(F.size("rows") > 0).withColumn("own", F.xxhash64("rows"))
    equal = F.row_number().over(Window.partitionBy("path", "own").orderBy("own"))
    found = found.withColumn("sentence", F.xxhash64("path", "own", equal))
    return found.select("path", "sentence", at(1).alias("words"), at(3).alias("tags"), at(7).alias("relations"))


def treebank_name(path: F.Column) -> F.Column:
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.conllu$", "")
    return F.replace(F.replace(name, F.lit("-ud-"), F.lit("-")), F.lit("_"), F.lit("-"))


def random_series(spark: SparkSession, rows: int, length: int, seed: int = 42) -> DataFrame:
    """Series of standard normal values."""
    values = F.array(*(F.randn(seed + i) for i in range(length)))
    return spark.range(rows).select(F.col("id").alias("sample_id"), values.alias("series"))


def decode_wav(content: bytes) -> np.ndarray:
    """Mono samples in [-1, 1] of a PCM file of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as f:
        raw, width = f.readframes(f.getnframes()), f.getsampwidth()
        if width == 1:
            x = np.frombuffer(raw, np.uint8).astype(float) / 128 - 1
        elif width == 3:
            low = np.zeros((len(raw) // 3, 4), np.uint8)
            low[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)  # the highest bytes of a 32-bit number
            x = low.view("<i4").reshape(-1).astype(float) / 2**31
        elif width in (2, 4):
            x = np.frombuffer(raw, f"<i{width}").astype(float) / 2 ** (8 * width - 1)
        else:
            raise ValueError(f"samples of {8 * width} bits")
        return x.reshape(-1, f.getnchannels()).mean(axis=1)


def wav_rate(content: bytes) -> int:
    with wave.open(io.BytesIO(content)) as f:
        return f.getframerate()


def loaded_wav(content: bytes, rate: int | None = None, seconds: float | None = None) -> np.ndarray:
    """Mono samples of a PCM file at another rate, of which the middle `seconds` stay."""
    x = decode_wav(content)
    own = wav_rate(content)
    if rate and rate != own:
        x = resampled(x[None], own, rate)[0]
    if seconds is not None and len(x) > (n := round(seconds * (rate or own))):
        x = x[(len(x) - n) // 2 :][:n]
    return x


def register_embedder(name: str, load: Callable[[str], Callable[[bytes], np.ndarray]]) -> None:
    """load(argument) runs once a task and returns a function from a file's bytes to a (features, steps) array."""
    _EMBEDDERS[name] = load


def embed_files(files: DataFrame, model: str, argument: str = "") -> DataFrame:
    """Series of every file by a registered embedder: path, feature_idx, series. Files that fail give one row with a null series."""
    if model not in _EMBEDDERS:
        raise ValueError(f"unknown model {model!r}: one of {sorted(_EMBEDDERS)}")
    load = _EMBEDDERS[model]

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embed = load(argument)
        for batch in stream:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    x = np.atleast_2d(embed(content)).astype(float).tolist()
                except (ValueError, EOFError, wave.Error):
                    x = [None]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(x)), pa.array(range(len(x)), pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["path", "feature_idx", "series"])

    return files.select("path", "content").mapInArrow(task, "path string, feature_idx int, series array<double>")


def long_series(df: DataFrame, sample: str, at: str, value: str, length: int, by: tuple[str, ...] = ()) -> DataFrame:
    """A series of `length` sums per sample from (sample, position, value) rows; positions without rows are 0."""
    sums = df.where((F.col(at) >= 0) & (F.col(at) < length)).groupBy(sample, *by, at).agg(F.sum(value).alias("_v"))
    held = sums.groupBy(sample, *by).agg(F.map_from_entries(F.collect_list(F.struct(F.col(at).cast("int"), F.col("_v").cast("double")))).alias("_m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return held.select(sample, *by, filled.alias("series"))


def _load_waveform(argument: str) -> Callable[[bytes], np.ndarray]:
    """`argument` is a rate and seconds, as in '16000,30'; either may be left out."""
    rate, _, seconds = argument.partition(",")
    return lambda content: loaded_wav(content, int(rate) if rate else None, float(seconds) if seconds else None)


register_embedder("waveform", _load_waveform)


def read_chords(spark: SparkSession, csv_path: str, npy_path: str) -> DataFrame:
    """Chord segments (one CSV file, read as a whole, so that its rows are numbered in order) beside their embeddings (NPY, one row a segment in the same order), joined by row number."""
    segments = spark.read.csv(csv_path, header=True, inferSchema=True, multiLine=True)
    if len(segments.inputFiles()) != 1:
        raise ValueError(f"rows of several files have no common order: {csv_path}")
    rows = segments.withColumn("row", F.monotonically_increasing_id())

    def task(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for content in batch.column("content").to_pylist():
                x = np.load(io.BytesIO(content), allow_pickle=False).astype(np.float64)
                for at in range(0, len(x), 1024):
                    part = x[at : at + 1024]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part.tolist(), pa.list_(pa.float64()))], ["row", "features"])

    vectors = spark.read.format("binaryFile").load(npy_path).select("content").mapInArrow(task, "row long, features array<double>")
    return rows.join(vectors, "row")


def read_chord_folder(spark: SparkSession, folder: str) -> DataFrame:
    """A folder's embeddings.npy beside segments_aligned.csv or, where there is none, segments.csv."""
    names = {r.path.rsplit("/", 1)[-1] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path").collect()}
    name = next((n for n in ("segments_aligned.csv", "segments.csv") if n in names), None)
    if not name:
        raise ValueError(f"no segments below {folder}")
    return read_chords(spark, f"{folder}/{name}", f"{folder}/embeddings.npy")
