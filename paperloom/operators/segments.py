"""Ordered sequences: islands, carrying forward, gaps, look-ahead. Every window is partitioned by its sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(keys: list[str], order: list[str]):
    return Window.partitionBy(*keys).orderBy(*order)


def islands(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "island") -> DataFrame:
    """WN-01: numbers runs of equal neighbouring values from 1."""
    w = _w(keys, order)
    starts = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1), F.lit(True))
    return rows.withColumn("__s", starts.cast("int")).withColumn(name, F.sum("__s").over(w)).drop("__s")


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str, least: int = 1) -> DataFrame:
    """WN-08, WN-15: a row per island of at least so many rows."""
    return islands(rows, keys, order, value).groupBy(*keys, "island").agg(F.first(value).alias(value), F.count("*").alias("n")).where(F.col("n") >= least)


def carry_forward(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """WN-12, WN-19: the last value that is not null, this row's included."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(_w(keys, order)))


def choice_units(rows: DataFrame, keys: list[str], order: list[str], note: Column, group: Column) -> DataFrame:
    """WN-02: a note opens a unit with its group mark, or ends the open one: units are numbered by notes, and only the unit's own note gives the mark."""
    w = _w(keys, order)
    numbered = rows.withColumn("unit", F.sum(note.cast("int")).over(w))
    return numbered.withColumn("unit_group", F.max(F.when(note, group)).over(Window.partitionBy(*keys, "unit")))


def gaps(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """WN-03, R17: numbers that a sequence from its first to its last leaves out."""
    distinct = rows.select(*keys, number).distinct()
    w = Window.partitionBy(*keys).orderBy(number)
    nxt = distinct.withColumn("__n", F.lead(number).over(w)).where(F.col("__n") > F.col(number) + 1)
    return nxt.select(*keys, F.explode(F.sequence(F.col(number) + 1, F.col("__n") - 1)).alias("missing"))


def repeats(rows: DataFrame, keys: list[str], number: str) -> DataFrame:
    """WN-03, R17: numbers that occur more than once."""
    return rows.groupBy(*keys, number).agg(F.count("*").alias("n")).where("n > 1")


def restarts(rows: DataFrame, keys: list[str], order: list[str], number: Column, name: str = "segment") -> DataFrame:
    """WN-14: a number no greater than the one before starts a new segment."""
    w = _w(keys, order)
    return rows.withColumn("__r", F.coalesce((number <= F.lag(number).over(w)).cast("int"), F.lit(0))).withColumn(name, F.sum("__r").over(w)).drop("__r")


def prefix_until(rows: DataFrame, keys: list[str], pos: str, stop: Column, most: int) -> DataFrame:
    """WN-13, SRT-04: rows before the first that stops, and so many at most."""
    first = F.min(F.when(stop, F.col(pos))).over(Window.partitionBy(*keys))
    return rows.withColumn("__stop", first).where((F.col(pos) < F.coalesce("__stop", F.lit(2**31 - 1))) & (F.col(pos) < most)).drop("__stop")


def option_like(rows: DataFrame, keys: list[str], order: list[str], labelled: Column, reach: int = 3, least: int = 3) -> DataFrame:
    """WN-18: rows with enough labelled rows around them."""
    w = _w(keys, order).rowsBetween(-reach, reach)
    return rows.withColumn("option_like", labelled & (F.count_if(labelled).over(w) >= least))


def or_verdict(rows: DataFrame, keys: list[str], order: list[str], is_or: Column, number: Column) -> DataFrame:
    """WN-22, R18, R19: for rows that end in OR, whether a twin, another question or nothing follows."""
    w = _w(keys, order)
    nxt = F.lead(number).over(w)
    verdict = F.when(nxt.isNull(), "nothing follows").when(nxt == number, "twin").otherwise("another number")
    return rows.withColumn("or_verdict", F.when(is_or, verdict))


def successor_letters(rows: DataFrame, keys: list[str], order: list[str], letter: str) -> DataFrame:
    """WN-20: sections without a letter take the next one after the last letter, counted on; 'A' if none came before or 'H' is passed."""
    w = _w(keys, order)
    known = rows.withColumn("__last", F.last(letter, ignorenulls=True).over(w)).withColumn("__known", F.count(letter).over(w))
    w2 = Window.partitionBy(*keys, "__known").orderBy(*order)
    step = F.row_number().over(w2) - F.when(F.col("__known") > 0, 1).otherwise(0)
    code = F.ascii(F.coalesce("__last", F.lit("@"))) + step
    return known.withColumn("lettered", F.coalesce(F.col(letter), F.when(code <= F.ascii(F.lit("H")), F.chr(code)).otherwise("A"))).drop("__last", "__known")


def later_same(rows: DataFrame, keys: list[str], letter: str, pos: str) -> Column:
    """JN-06: whether the same letter comes again later (contents lines are dropped if it does)."""
    return F.max(pos).over(Window.partitionBy(*keys, letter)) > F.col(pos)
