"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import re
import tempfile
import uuid
from contextlib import contextmanager, suppress
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, so that a Python worker's memory does not follow the length of texts.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20


@contextmanager
def settings(spark: SparkSession, **values: object):
    """Session settings (dots as __) for the actions within; afterwards they are as before."""
    own = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Bound what one Arrow batch brings to a Python worker while the actions within run; long texts would make 10,000 rows too much. Frames that run later take the session's own batches, which have a bound in bytes, and cut them into blocks themselves."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=rows, spark__sql__execution__arrow__maxBytesPerBatch=BATCH_BYTES)


def lean(task):
    """A function over Arrow batches that gives back, when it ends, the memory that its worker freed: workers are used again by later stages."""

    @functools.wraps(task)
    def run(batches):
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return run


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir. Where it is unset, only a local session has a folder that all tasks share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = Path(tempfile.gettempdir(), "checkpoints").as_uri()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that lost executors cost no recomputation. It stays as long as the application, as frames that read it may run at any time."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so any store works."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


def parts_of(size: int, least: int = 16 << 20, most: int = 256 << 20) -> int:
    """Partitions for so many bytes: of `least` each, and of up to `most` where that would make over some thousand."""
    return max(1, min(-(-size // least), max(4096, -(-size // most))))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and its n + 1 offsets from 0, without copying."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(ends) else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def pieces(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lengths)
