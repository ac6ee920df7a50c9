"""The inbox as a stream: each file is taken once, whatever happens in between.

The file source's log and the checkpoint remember what was read; each batch is merged by key into a table of
results, so a batch that is run again after a failure changes nothing. No state store is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def poll(spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_batch: int = 100, kind: str = "parquet") -> None:
    """STR-01: process what is new below path (a folder or pattern) since the last call, in bounded batches, then stop."""
    stream = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_once(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """STR-02: a batch handler that adds only keys which the results lack; a batch goes to its own folder, overwritten if it runs again."""

    def handle(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key])
        done = spark.read.schema(batch.schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path) if _exists(spark, path) else None
        if done is not None:
            earlier = done.where(~F.col("_metadata.file_path").contains(f"/batch={number}/"))
            rows = rows.join(earlier.select(key), key, "left_anti")
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def _exists(spark: SparkSession, path: str) -> bool:
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hpath)
