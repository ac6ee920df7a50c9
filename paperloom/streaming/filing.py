"""Papers filed one after the other, as a stream with state.

What a paper's earlier attempts left behind is kept by paper in the state store, so a batch costs what it brings, not
what came before: which versions of its review note wait for fixes, with the content that they had and the file that
they came from, how many formatted versions there are, and the first one's content. Content is the note's text without
its source line and blank lines. State and progress advance together through the checkpoint; results are written batch
by batch in folders of their own, so a batch that stopped half-way is written again, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "base string, at long, source string, status string, name string, superseded_note string, superseded_source string"
STATE = "versions array<long>, contents array<string>, sources array<string>, made long, first string"


def content(note: Column) -> Column:
    """What two review notes are compared by: their lines without blanks at the ends, empty lines and the line that names the source."""
    lines = F.transform(F.split(F.coalesce(note, F.lit("")), r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.sha2(F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("Source:")), "\n"), 256)


def _first_free(held: list[int]) -> int:
    n = 1
    while n in held:
        n += 1
    return n


class Attempts(StatefulProcessor):
    """One paper's attempts, each in order of arrival within its batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("attempts", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        versions, contents, sources, made, first = [], [], [], 0, None
        if (state := self.state.get()) is not None:
            versions, contents, sources, made, first = state
            versions, contents, sources = list(versions), list(contents), list(sources)
        out = []
        for r in sorted(rows, key=lambda r: (r.at is None, r.at or 0, r.source is None, r.source or "")):
            base, note, retired = key[0], (None, None), None
            if r.blocking:
                if 1 in versions and contents[versions.index(1)] == r.content:
                    status, name = "recovered", f"{base}_REVIEW"
                else:
                    n = _first_free(versions)
                    status, name = "needs-fixes", f"{base}_REVIEW" + (f"_v{n}" if n > 1 else "")
                    versions.append(n)
                    contents.append(r.content)
                    sources.append(r.source)
            elif made and first == r.content:
                status, name = "recovered", base
            else:
                made += 1
                first = r.content if made == 1 else first
                status, name = "formatted", base + (f"_v{made}" if made > 1 else "")
                if 1 in versions:  # the earlier attempt's note and file leave the folder
                    retired = versions.index(1)
                    note = (f"{base}_REVIEW", sources[retired])
            if retired is not None:
                del versions[retired], contents[retired], sources[retired]
            out.append(Row(base=base, at=r.at, source=r.source, status=status, name=name, superseded_note=note[0], superseded_source=note[1]))
        self.state.update((versions, contents, sources, made, first))
        yield from out

    def close(self) -> None:
        pass


def filed(papers: DataFrame) -> DataFrame:
    """A stream of papers (base, at, source, blocking, note) with status, name and what each supersedes."""
    rows = papers.select("base", F.col("at").cast("long").alias("at"), "source", F.coalesce("blocking", F.lit(False)).alias("blocking"), content(F.col("note")).alias("content"))
    return rows.groupBy("base").transformWithState(Attempts(), OUT, "Append", "None")


def file_all(spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, out: str, files_per_batch: int = 100, kind: str = "parquet", after=None) -> None:
    """STR-02, STR-03: file what is new below path since the last call. Of each batch two tables are written, results and what they supersede, each in a folder of the batch; `after` is called between both."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:

        def write(batch: DataFrame, number: int) -> None:
            batch = batch.persist()
            try:
                batch.drop("superseded_note", "superseded_source").write.mode("overwrite").parquet(f"{out}/results/batch={number}")
                if after:
                    after(number)
                batch.where("superseded_note is not null").select("base", "at", "superseded_note", "superseded_source").write.mode("overwrite").parquet(f"{out}/superseded/batch={number}")
            finally:
                batch.unpersist()

        stream = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)
        filed(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
