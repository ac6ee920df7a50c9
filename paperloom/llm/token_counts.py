"""Token counts by a map-side two-tier lookup.

Every task counts its pre-tokens in a bounded summary; the merged summaries give the frequent pre-tokens of
the whole corpus. Their lengths in ids go out as one compact broadcast hash table of FREQUENT entries at
most, whatever the corpus. Pre-tokens that it lacks are encoded through a bounded cache in each worker, so
no occurrence of a pre-token is ever shuffled.

Defined cases: null text counts as empty; an empty text has no tokens; a very long text is taken in parts; repeated
rows give repeated results; words that share the count at the table's bound stay out of it together; further columns
pass through; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytebpe import ByteBpe, Encoder, Spans, Table, shared_bpe
from .common import column_bytes, cut_lineage, small_batches, text_or_empty

#: Entries of the broadcast table, and of each task's summary while it counts and when it ends.
FREQUENT = 1 << 16
SUMMARY = 1 << 17
SUMMARY_OUT = 1 << 13
#: Bytes of a pre-token of the table at most; longer ones are encoded where they stand.
LONGEST = 256
LIMIT = 1024


def block_words(bpe: ByteBpe, part: np.ndarray, at: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct pre-tokens of a block and how often each occurs; texts with added tokens are left out."""
    starts, before = bpe.split(part, at)
    if not len(starts):
        return [], np.zeros(0, np.int64)
    spans = Spans(part, starts, np.append(starts[1:], len(part)))
    _, first, count = np.unique(spans.key, return_index=True, return_counts=True)
    return spans.take(first).words(), count


def _summaries(path: str):
    def run(batches):
        bpe, seen = Encoder(path), Counter()
        for batch in batches:
            for _, _, part, at in bpe.blocks(*column_bytes(batch.column(0))):
                words, count = block_words(bpe.bpe, part, at)
                seen.update({w: c for w, c in zip(words, count.tolist(), strict=True) if len(w) <= LONGEST})
                if len(seen) > SUMMARY:
                    seen = Counter(dict(seen.most_common(SUMMARY // 2)))
        top = seen.most_common(SUMMARY_OUT)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.binary()), pa.array([c for _, c in top], pa.int64())], ["word", "n"])

    return run


def known_table(words: list[bytes], ids: list[np.ndarray]) -> Table:
    """A table of different pre-tokens and their ids."""
    table = Table(max(1, len(words)))
    if words:
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        table.add(Spans.of(words), count, np.concatenate(ids).astype(np.uint16))
    return table


def most_frequent(words: DataFrame, most: int) -> DataFrame:
    """Of (word, n): the words from a count on, as many as fit in `most`. Counts of over 4,096 stand together by 64ths of a doubling; a histogram of some thousand rows settles the bound, and words of the count that would cross it stay out."""
    step = F.when(F.col("n") < 4096, F.col("n")).otherwise(4096 + F.floor((F.log2(F.col("n").cast("double")) - 12) * 64)).cast("int")
    left, bound = most, None
    for r in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
        if r["count"] > left:
            break
        left, bound = left - r["count"], r.step
    return words.where(step >= bound if bound is not None else F.lit(False))


def _encode(path: str):
    def run(batches):
        merge = shared_bpe(path).merge
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([np.array(merge(w), "<u2").tobytes() for w in batch.column(0).to_pylist()], pa.binary())], ["word", "ids"])

    return run


def encoded_table(words: DataFrame, path: str) -> Table:
    """The table of a bounded DataFrame of words, which tasks encode."""
    found = words.select("word").mapInArrow(_encode(path), "word binary, ids binary").toArrow()
    return known_table(found.column(0).to_pylist(), [np.frombuffer(x, "<u2") for x in found.column(1).to_pylist()])


def frequent_table(docs: DataFrame, path: str, text: str = "text", most: int = FREQUENT) -> Table:
    """A table of the most frequent pre-tokens by the tasks' merged summaries: at most so many, whatever the corpus."""
    with small_batches(docs.sparkSession):
        top = docs.select(text_or_empty(text).alias("text")).mapInArrow(_summaries(path), "word binary, n long")
        return encoded_table(most_frequent(cut_lineage(top.groupBy("word").agg(F.sum("n").alias("n"))), most), path)


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = LIMIT) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (more tokens than limit)."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(frequent_table(docs, path, text))
    keep = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit", text)]

    def run(batches):
        encoder = Encoder(path, table.value)
        for batch in batches:
            raw, at = column_bytes(batch.column(batch.num_columns - 1))
            n = encoder.counts(raw, at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], names)

    names = [*keep, "n_bytes", "n_tokens", "over_limit"]
    rows = docs.select(*keep, text_or_empty(text).alias(text))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return rows.mapInArrow(run, schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
