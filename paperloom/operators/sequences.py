"""Ordered rows: groups that hang on their first row, rows of a group in order, and numbers that are free beside others that are held."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grouped(rows: DataFrame, by: list[str], order: list[str], values: list[str], step: Callable, name: str) -> DataFrame:
    """rows with `name`, the number of their group from 0 within `by`. step(state, *values) gives the next state and whether the row begins a group; the state is None at first. Rows pass by once, in order."""
    names, schema = [*rows.columns, name], T.StructType([*rows.schema.fields, T.StructField(name, T.IntegerType())])

    def run(batches):
        last, state, n = None, None, -1
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            out = []
            for key, own in zip(keys, zip(*(batch.column(c).to_pylist() for c in values), strict=True), strict=True):
                if key != last:
                    last, state, n = key, None, -1
                state, new = step(state, *own)
                n += new
                out.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], names)

    return rows.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def in_order(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """(key, its rows) of sorted batches, one group after the other; what a group's reader leaves is passed over."""
    rows = (r for batch in batches for r in batch.to_pylist())
    for key, own in groupby(rows, lambda r: tuple(r[c] for c in by)):
        yield key, own


def nth_free(rows: DataFrame, held: DataFrame, by: list[str], rank: str, number: str) -> DataFrame:
    """rows with `number`: the rank-th positive integer that held (by, number) lacks in the group of `by`.

    The j-th held number h has h - j free ones below it, so the n-th free number is n and as many as there are held ones
    with h - j < n. Both sides stand together in that order, and a running maximum of j gives each rank its count: one
    sort of the group, linear in its rows. Repeated and non-positive held numbers count once and not at all.
    """
    before = F.col(number) - F.row_number().over(Window.partitionBy(*by).orderBy(number))
    gaps = held.where(F.col(number) > 0).select(*by, F.col(number).cast("long").alias(number)).distinct()
    gaps = gaps.select(*by, before.alias("__at"), (F.col(number) - before).alias("__held"))
    both = rows.withColumn("__at", F.col(rank).cast("long")).withColumn("__held", F.lit(None).cast("long")).unionByName(gaps, allowMissingColumns=True)
    # a held number at n has n free ones below it, so it comes behind the rank n
    passed = F.coalesce(F.max("__held").over(Window.partitionBy(*by).orderBy("__at", F.asc_nulls_first("__held")).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return both.withColumn("__passed", passed).where("__held is null").withColumn(number, F.col("__at") + F.col("__passed")).drop("__at", "__held", "__passed")
