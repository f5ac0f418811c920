"""Session defaults used by tests and benchmarks; clusters bring their own settings."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Bytes of rows that Python in a task gets at a time, where rows can be long; Spark counts 10,000 rows, however long.
BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_open, _lock = Counter(), threading.Lock()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is planned within hands BATCH_BYTES at a time to Python, unless the session has a limit of its own. Threads may be within at the same time; the last one to leave takes the limit away."""
    key = spark._jsparkSession.hashCode()
    with _lock:
        if _open[key] or spark.conf.get(_LIMIT, None) is None:
            if not _open[key]:
                spark.conf.set(_LIMIT, str(BATCH_BYTES))
            _open[key] += 1
            mine = True
        else:
            mine = False
    try:
        yield
    finally:
        with _lock:
            if mine:
                _open[key] -= 1
                if not _open[key]:
                    spark.conf.unset(_LIMIT)


def build_session(master: str = "local[8]", app: str = "bandlake", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "6g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(master).appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, set to a new folder only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = current.get() if current.isDefined() else "file://" + tempfile.mkdtemp(prefix="bandlake-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Writes df to the shared folder, by a column if asked for, and reads it back: what follows starts from the files, also when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
