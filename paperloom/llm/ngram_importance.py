"""Target-distribution importance resampling by a streaming CRC ring.

One scan of a text keeps the zlib states of the last n starts. Each new word extends every state by a space and the
word and begins one of its own, so all runs of 1 to n words get their CRC without being built; what is left of it by
the number of buckets is the feature. The scan is done once: a table holds each document's buckets, and counts and
weights come from there. Tasks add up their buckets before anything is shuffled, and the gains of all buckets (as many
numbers as the parameter says) are the only thing sent to all. Documents with enough words get the floored mean of
their gains plus Gumbel noise from doc_id, and the greatest are drawn; ranks come from a sort by ranges and the sizes
of its parts, never from one task.

Defined cases: null or empty text has no features and weight 0; very long texts are scanned in blocks, with the ring
carried over; rows without doc_id draw their noise as an empty id and come last among ties; rows that repeat a doc_id
share their noise, and ties between them go any way; without target texts all gains come from smoothing; an empty table
gives an empty result; further columns pass through, and those named like a result are replaced.
"""

from __future__ import annotations

import math
import re
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_bytes, cut_lineage, small_batches, text_or_empty
from .quality import kth_largest

#: Longest runs of words, buckets, and what a document needs and how many in a hundred of those are drawn.
RUNS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
BLOCK = 1 << 20
#: Words over UTF-8 bytes: all bytes of characters beyond ASCII belong to words.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
NO_WORD = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
RESULTS = ("n_words", "n_features", "weight", "score", "rank")


def blocks(text: bytes):
    """A text in parts of whole words."""
    at = 0
    while at < len(text):
        end = NO_WORD.search(text, at + BLOCK) if at + BLOCK < len(text) else None
        end = end.start() if end else len(text)
        yield text[at:end]
        at = end


def scan(text: bytes, runs: int, buckets: int) -> tuple[int, np.ndarray]:
    """How many words a text has, and the bucket of each run of 1 to `runs` words, by the words where they end."""
    ring: list[int] = []  # states of the last starts, newest first
    n, out = 0, []
    for block in blocks(text):
        found = WORD.findall(block.lower())
        n += len(found)
        ends = array("I")
        for word in found:
            spaced = b" " + word
            ring = [crc32(word), *[crc32(spaced, state) for state in ring[: runs - 1]]]
            ends.extend(ring)
        out.append((np.frombuffer(ends, np.uint32) % np.uint32(buckets)).astype(width(buckets)))
    return n, np.concatenate(out) if out else np.zeros(0, width(buckets))


def width(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def _scanned(runs: int, buckets: int, names: list[str]):
    def run(batches):
        for batch in batches:
            raw, at = column_bytes(batch.column(batch.num_columns - 1))
            data = memoryview(raw)
            found = [scan(bytes(data[a:b]), runs, buckets) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([n for n, _ in found], pa.int64()), pa.array([x.tobytes() for _, x in found], pa.binary())], names)

    return run


def with_buckets(docs: DataFrame, text: str = "text", runs: int = RUNS, buckets: int = BUCKETS, columns: list[str] | None = None) -> DataFrame:
    """A table of docs' columns (or those given) without the text, with n_words and feature_buckets: one little-endian integer for each feature."""
    kept = [c for c in (columns if columns is not None else docs.columns) if c not in (text, *RESULTS, "feature_buckets")]
    rows = docs.select(*kept, text_or_empty(text).alias("__text"))
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("feature_buckets", T.BinaryType())])
    with small_batches(docs.sparkSession):
        return cut_lineage(rows.mapInArrow(_scanned(runs, buckets, schema.names), schema))


def bucket_counts(scanned: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features fall in each bucket. Every task adds up its own first."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            total += np.bincount(column_bytes(batch.column(0))[0].view(width(buckets)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    for r in scanned.select("feature_buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) for each bucket."""
    n = len(raw)
    all_raw, all_target = int(raw.sum()) + n, int(target.sum()) + n
    return np.array([math.floor(1000 * math.log((t + 1) * all_raw / ((s + 1) * all_target))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(h: int) -> int:
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighted(scanned: DataFrame, gain: np.ndarray, key: str = "doc_id", seed: int = SEED) -> DataFrame:
    """The scanned table with n_features, weight and score in place of the buckets."""
    kept = [c for c in scanned.columns if c not in ("n_words", "feature_buckets")]
    names = [*kept, "n_words", "n_features", "weight", "score"]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    kind = width(len(gain))

    def run(batches):
        for batch in batches:
            *own, n_words, buckets, h = batch.columns
            raw, at = column_bytes(buckets)
            n = np.diff(at) // np.dtype(kind).itemsize
            total = np.concatenate([[0], np.cumsum(gain[raw.view(kind)])])
            end = np.cumsum(n)
            weight = (total[end] - total[end - n]) // np.maximum(n, 1)
            score = weight + np.fromiter(map(noise, h.to_pylist()), np.int64, len(weight))
            yield pa.RecordBatch.from_arrays([*own, n_words, pa.array(n), pa.array(weight), pa.array(score)], names)

    schema = T.StructType([*scanned.select(*kept, "n_words").schema.fields, *(T.StructField(c, T.LongType()) for c in names[-3:])])
    return scanned.select(*kept, "n_words", "feature_buckets", F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("__h")).mapInArrow(run, schema)


def ranked(rows: DataFrame, *order) -> DataFrame:
    """rows with rank 1, 2, 3 ... in an order. The sorted table is written with each row's part and place there, and the parts' sizes, a number each, give the rest."""
    place = cut_lineage(rows.orderBy(*order).withColumn("__place", F.monotonically_increasing_id()))
    part, before, sums = F.shiftright("__place", 33), 0, []
    for r in sorted(place.groupBy(part.alias("part")).count().collect()):
        sums.append((r.part, before))
        before += r["count"]
    sums = rows.sparkSession.createDataFrame(sums, "__part long, __before long")
    return place.join(F.broadcast(sums), part == F.col("__part")).withColumn("rank", F.col("__before") + F.col("__place").bitwiseAND((1 << 33) - 1) + 1).drop("__place", "__part", "__before")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", runs: int = RUNS, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, columns: list[str] | None = None) -> DataFrame:
    """docs (all columns but the text, or those given) with n_words, n_features, weight, score and rank; rank is null for rows that are not drawn."""
    scanned = with_buckets(docs, text, runs, buckets, columns)
    gain = gains(bucket_counts(scanned, buckets), bucket_counts(with_buckets(target, text, runs, buckets, []), buckets))
    scored = cut_lineage(weighted(scanned, gain, key, seed))
    k = percent * scored.where(F.col("n_words") >= least).count() // 100
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    drawable = F.col("n_words") >= least
    high = drawable & (F.col("score") >= int(kth_largest(scored.where(drawable), "score", k)))
    first = ranked(scored.where(high), F.desc("score"), F.asc_nulls_last(key))
    return first.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank"))).unionByName(scored.where(~high).withColumn("rank", F.lit(None).cast("long")))


def op13_target_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(docs, target, columns=["doc_id"]).select("doc_id", "n_features", "weight", "score", "rank")


#: Code points by UTF-8 bytes, and the CRC of each distinct feature byte by byte over the table that the polynomial gives.
OP13_SQL = r"""
WITH crc AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))
), words AS MATERIALIZED (
  SELECT doc_id, false AS target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
  UNION ALL
  SELECT item_id, true, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
), runs AS MATERIALIZED (
  SELECT doc_id, target, unnest(w) AS f FROM words
  UNION ALL
  SELECT doc_id, target, unnest(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) FROM words
), features AS MATERIALIZED (SELECT doc_id, target, f, count(*) AS n FROM runs GROUP BY ALL),
coded AS MATERIALIZED (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2), lambda k: (instr('0123456789ABCDEF', h[k]) - 1) * 16 + instr('0123456789ABCDEF', h[k + 1]) - 1)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS h FROM features GROUP BY f), crc
), counts AS (SELECT bucket, sum(CASE WHEN target THEN n ELSE 0 END)::BIGINT AS t, sum(CASE WHEN target THEN 0 ELSE n END)::BIGINT AS s FROM features JOIN coded USING (f) GROUP BY bucket),
totals AS (SELECT sum(t) AS tt, sum(s) AS ss FROM counts),
gain AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (ss + 10000)::DOUBLE / ((s + 1)::DOUBLE * (tt + 10000)::DOUBLE)))::BIGINT AS g FROM counts, totals),
weights AS (SELECT doc_id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS total FROM features JOIN coded USING (f) JOIN gain USING (bucket) WHERE NOT target GROUP BY doc_id),
hashed AS (SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda k: instr('0123456789abcdef', sha256('7:' || doc_id)[k]) - 1)), lambda a, b: a * 16 + b) AS h FROM documents),
scored AS (
  SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features,
    (CASE WHEN n_features IS NULL THEN 0 ELSE (total - (total % n_features + n_features) % n_features) // n_features END)::BIGINT AS weight, h
  FROM words d JOIN hashed USING (doc_id) LEFT JOIN weights USING (doc_id) WHERE NOT d.target
), final AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM final WHERE n_words >= 20)
SELECT f.doc_id, f.n_features, f.weight, f.score, CASE WHEN r <= 25 * n // 100 THEN r END AS rank FROM final f LEFT JOIN drawn USING (doc_id)
"""
