"""Tables that jobs write for themselves, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path below the folder that the cluster names in spark.checkpoint.dir. Where it is unset, only a local session has a folder that all tasks share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = Path(tempfile.gettempdir(), "checkpoints").as_uri()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """A table written once and read back: the classified items of papers, from which several things are derived. It goes when the application ends."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _set(spark: SparkSession, name: str, value: int) -> Iterator[None]:
    was = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, was)


def unsized_batches(spark: SparkSession):
    """Inside, Arrow batches of short rows are bounded by their number alone: to bound them by bytes too, Spark sums up all columns anew for each row."""
    return _set(spark, "spark.sql.execution.arrow.maxBytesPerBatch", 2**31 - 1)


def small_methods(spark: SparkSession):
    """Inside, stages whose code would be one method beyond 8,000 bytes, which the JVM interprets and never compiles, run operator by operator, each in small methods."""
    return _set(spark, "spark.sql.codegen.hugeMethodLimit", 8000)


def _drop(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
