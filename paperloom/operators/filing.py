"""Filing papers: names that are free, a log of moves, and what a folder held at a time.

A log is rows (file, at, folder, name) that are only ever added: an upload is a file's first row, a move or a new name
a further one. A row is refused if another file has that name in that folder then. Whether one has depends on rows
before it, of other files and folders; settle() cuts the log into blocks of time, of bounded size, and goes through each in order, a
task a block, from what its own files and places held when it began. That is first taken as nothing, then as what the
blocks before it left, until no block begins otherwise than it was taken to. What is right for all blocks before one is
right for the next, so the rounds end in the one answer that going through the log would give; their number follows the
longest chain of blocks that refusals run through, not the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..tables import stored
from .sequences import nth_free


def held_versions(listing: DataFrame, name: str, suffixes: list[str], base: str = "base") -> DataFrame:
    """(base, version) that a folder's names hold: name + suffix is version 1 of its name, and base_vN + suffix version N of base as well."""
    stem = reduce(lambda rest, s: F.when(F.col(name).endswith(s), F.expr(f"left(`{name}`, char_length(`{name}`) - {len(s)})")).otherwise(rest), sorted(suffixes, key=len), F.lit(None))
    stems = listing.select(stem.alias("__stem")).where("__stem is not null")
    own = stems.select(F.col("__stem").alias(base), F.lit(1).cast("long").alias("version"))
    number = F.regexp_extract("__stem", r"_v([1-9]\d{0,8})$", 1)
    later = stems.where(number != "").select(F.regexp_replace("__stem", r"_v\d+$", "").alias(base), number.cast("long").alias("version"))
    return own.unionAll(later.where("version > 1")).distinct()


def free_names(rows: DataFrame, base: str, order: list[str], *taken: DataFrame) -> DataFrame:
    """SET-04: rows with version and free_name: name, name_v2, ... in order of arrival; versions that any of the listings (base, version) holds are passed over, so that a document and its review are free together. A base's rows and versions are sorted once."""
    ranked = rows.withColumn("__rank", F.row_number().over(Window.partitionBy(base).orderBy(*order)))
    if taken:
        held = reduce(DataFrame.unionByName, (t.select(base, F.col("version").cast("long").alias("version")) for t in taken))
        named = nth_free(ranked, held, [base], "__rank", "version")
    else:
        named = ranked.withColumn("version", F.col("__rank").cast("long"))
    return named.withColumn("free_name", F.when(F.col("version") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("_v"), F.col("version").cast("string")))).drop("__rank")


def retired(superseded: DataFrame, archive: DataFrame, order: list[str], name: str = "name", suffix: str = "_superseded") -> DataFrame:
    """JN-05: superseded files with archived, the name that each gets in the archive (listing column name): before its extension the suffix, and a version where that is taken."""
    extension = F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1)
    rows = superseded.withColumn("__ext", extension).withColumn("__base", F.concat(F.expr(f"left(`{name}`, char_length(`{name}`) - char_length(__ext))"), F.lit(suffix)))
    key = F.concat("__base", F.lit("\n"), "__ext")  # names of different extensions do not meet
    parts = archive.select(F.regexp_extract("name", r"(\.[^.]*)$", 1).alias("__ext"), "name")
    listed = parts.select(F.concat(F.expr("left(name, char_length(name) - char_length(__ext))")).alias("__stem"), "__ext")
    version = F.regexp_extract("__stem", r"_v([1-9]\d{0,8})$", 1)
    held = listed.select(F.concat("__stem", F.lit("\n"), "__ext").alias("__key"), F.lit(1).alias("version")).unionAll(listed.where(version != "").select(F.concat(F.regexp_replace("__stem", r"_v\d+$", ""), F.lit("\n"), "__ext"), version.cast("int")))
    named = free_names(rows.withColumn("__key", key), "__key", order, held)
    return named.withColumn("archived", F.concat("__base", F.when(F.col("version") > 1, F.concat(F.lit("_v"), F.col("version").cast("string"))).otherwise(""), "__ext")).drop("__ext", "__base", "__key", "version", "free_name")


#: Rows of a block of the log, which one task goes through in order.
BLOCK = 100_000


def _blocks(moves: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """The log, written once, with __block, the number of its stretch of time."""
    n = max(1, math.ceil(moves.count() / BLOCK))
    return stored(moves.repartitionByRange(n, *order).withColumn("__block", F.spark_partition_id())), n


def _through(file: str, place: tuple[str, ...], schema: pa.Schema):
    """Blocks gone through in order, each from what its files and places held when it began (rows with a __key before its moves)."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, where, held = None, {}, {}
        for batch in batches:
            took, kept = [], []
            slots = zip(*(batch.column(c).to_pylist() for c in place), strict=True)
            for k, (at, known, f, slot) in enumerate(zip(batch.column("__block").to_pylist(), batch.column("__key").to_pylist(), batch.column(file).to_pylist(), slots, strict=True)):
                if at != block:
                    block, where, held = at, {}, {}
                if known == 1:
                    where[f] = slot
                elif known == 2:
                    held[slot] = f
                else:
                    free = slot not in held or held[slot] == f
                    if free:
                        was = where.get(f)
                        if was is not None and was in held and held[was] == f:
                            del held[was]
                        held[slot] = f
                        where[f] = slot
                    kept.append(k)
                    took.append(free)
            rows = batch.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in schema.names[:-1]), pa.array(took, pa.bool_())], schema=schema)

    return go


def _begun(settled: DataFrame, file: str, place: tuple[str, ...], order: list[str]) -> DataFrame:
    """What the files and places of each block held when it began, by the rows accepted before it: (__block, __key, file, place), where __key is 1 for a file's place and 2 for a place's file."""
    slot = F.struct(*place)
    last = settled.where("accepted").groupBy("__block", file).agg(F.max_by(slot, F.struct(*order)).alias("__slot"))
    by_file = Window.partitionBy(file).orderBy("__block")
    stays = last.withColumn("__until", F.lead("__block").over(by_file))
    asked = settled.select("__block", file).distinct()
    both = asked.withColumns({"__slot": F.lit(None).cast(last.schema["__slot"].dataType), "__asks": F.lit(True)}).unionByName(last.select((F.col("__block") + 1).alias("__block"), file, "__slot", F.lit(False).alias("__asks")))
    known = both.withColumn("__slot", F.last("__slot", ignorenulls=True).over(by_file.rangeBetween(Window.unboundedPreceding, 0))).where("__asks and __slot is not null")
    of_files = known.select("__block", F.lit(1).alias("__key"), file, *(F.col("__slot")[c].alias(c) for c in place))
    wanted = settled.select("__block", slot.alias("__slot")).distinct()
    holds = F.struct(F.col(file).alias("f"), F.col("__until").alias("until"))
    came = stays.select((F.col("__block") + 1).alias("__block"), "__slot", holds.alias("__holds"), F.lit(False).alias("__asks"))
    both = wanted.withColumns({"__holds": F.lit(None).cast(came.schema["__holds"].dataType), "__asks": F.lit(True)}).unionByName(came)
    latest = F.max(F.when(F.col("__holds").isNotNull(), F.struct("__block", "__holds"))).over(Window.partitionBy("__slot").orderBy("__block").rangeBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__holds", latest["__holds"]).where("__asks and __holds is not null and (__holds.until is null or __holds.until >= __block)")
    of_places = found.select("__block", F.lit(2).alias("__key"), F.col("__holds.f").alias(file), *(F.col("__slot")[c].alias(c) for c in place))
    return of_files.unionByName(of_places)


def settle(moves: DataFrame, file: str = "file", place: tuple[str, ...] = ("folder", "name"), order: tuple[str, ...] = ("at",)) -> DataFrame:
    """SNK-01, SNK-02: the log with accepted; order must be that of arrival, without ties."""
    log, n = _blocks(moves, [*order])
    fields = log.withColumn("accepted", F.lit(True))
    schema = to_arrow_schema(fields.schema)
    columns = [*moves.columns, "accepted"]
    begun = None
    while True:
        rows = log.withColumn("__key", F.lit(0))
        if begun is not None:
            rows = rows.unionByName(begun, allowMissingColumns=True)
        rows = rows.repartition(n, "__block").sortWithinPartitions("__block", F.col("__key") == 0, *order)
        settled = stored(rows.mapInArrow(_through(file, place, schema), fields.schema))
        if n == 1:
            return settled.select(columns)
        now = stored(_begun(settled, file, place, [*order]))
        each = now.withColumn("__new", F.lit(1)).unionByName((begun if begun is not None else now.limit(0)).withColumn("__new", F.lit(-1)))
        if each.groupBy("__block", "__key", file, *place).agg(F.sum("__new").alias("__new")).where("__new <> 0").isEmpty():
            return settled.select(columns)
        begun = now


def intervals(settled: DataFrame, file: str = "file", at: str = "at") -> DataFrame:
    """Where each file was: accepted rows with since and until (null: it is still there)."""
    return settled.where("accepted").withColumn("since", F.col(at)).withColumn("until", F.lead(at).over(Window.partitionBy(file).orderBy(at))).drop("accepted", at)


def listing_at(held: DataFrame, at: Column) -> DataFrame:
    """The folders as they were at a time, whatever moved since."""
    return held.where((F.col("since") <= at) & (F.col("until").isNull() | (F.col("until") > at)))


def held_when(papers: DataFrame, held: DataFrame, at: str, place: tuple[str, ...] = ("folder", "name"), file: str = "file") -> DataFrame:
    """papers with holder, the file that had the paper's place when it arrived (null: it was free): an as-of join by one sort of each place."""
    events = held.select(*place, F.col("since").alias(at), F.lit(0).alias("__kind"), F.struct(file, "until").alias("__held"))
    both = papers.withColumn("__kind", F.lit(1)).withColumn("__held", F.lit(None).cast(events.schema["__held"].dataType)).unionByName(events, allowMissingColumns=True)
    last = F.last("__held", ignorenulls=True).over(Window.partitionBy(*place).orderBy(at, "__kind").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn("__last", last).where("__kind = 1")
    return found.withColumn("holder", F.when(F.col("__last.until").isNull() | (F.col("__last.until") > F.col(at)), F.col(f"__last.{file}"))).drop("__kind", "__held", "__last")
