"""Quality classifier by importance resampling.

Target text (labelled good and not toxic, from a bounded sample of labelled rows) and raw text (all documents) each
have a generative model over hashed n-grams: words and word pairs, multinomial. A document's log importance is
log p_target - log p_raw, in nats and unscaled. Gumbel top-k then draws k documents without replacement: log importance
plus Gumbel noise from doc_id and text (times a temperature, 1 by default), and the k greatest keys.

The sum over a long text outweighs the few words that make it toxic, so a second model says what lies outside the
target: which words a text has at all (independent presences). Only words whose presence in target text differs from
what raw text lets expect by over CHANCE standard deviations count; where their log ratios add up to less than OUTSIDE,
the document is not supported by the target. Supported documents are drawn first; others fill up what is left of k, by
the same keys. k is a parameter; by default it is the share of good rows among the labelled rows, of all documents.

Defined cases: null or empty text has log importance 0, and very long texts the sum over all of their n-grams; rows
that repeat doc_id and text share their noise, so ties at the k-th key are all kept; null ids are told apart by their
texts; without labelled rows every ratio is 0, all are supported and k is all documents; an empty table gives an empty result; further
columns pass through, and those called log_weight, log_presence, supported or sample_key are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytebpe import Spans
from .common import column_bytes, cut_lineage, lean, small_batches, text_or_empty

#: Labelled rows used at most.
LABELLED = 50_000
WORD_BITS, PAIR_BITS = 18, 16
#: Rows or occurrences that smoothing adds to both sides of a ratio.
SMOOTH = 1.0
#: Standard deviations from the expected presences under which a word says nothing.
CHANCE = 4.0
#: Log ratio of presences below which a document lies outside the target.
OUTSIDE = -2.0
RESULTS = ("log_weight", "log_presence", "supported", "sample_key")
CHUNK = 1024
BLOCK = 1 << 20
KINDS = {"has": WORD_BITS, "word": PAIR_BITS, "pair": PAIR_BITS}


def ngrams(raw: np.ndarray, at: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each kind (document, bucket): of its distinct words, of its words, of its word pairs. A word is a run of letters, digits and longer characters, or of other marks."""
    none = np.zeros(0, np.int64)
    if not len(raw):
        return {k: (none, none) for k in KINDS}
    alnum = ((raw >= 48) & (raw < 58)) | ((raw >= 65) & (raw < 91)) | ((raw >= 97) & (raw < 123)) | (raw >= 128)
    kind = np.where((raw == 32) | ((raw >= 9) & (raw <= 13)), 0, np.where(alnum, 1, 2)).astype(np.int8)
    start = np.ones(len(raw), bool)
    start[1:] = kind[1:] != kind[:-1]
    start[at[:-1][at[:-1] < len(raw)]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], len(raw))
    word = kind[starts] > 0
    starts, ends = starts[word], ends[word]
    doc = np.searchsorted(at, starts, "right") - 1
    h = Spans(raw, starts, ends).key
    two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
    two = (two ^ (two >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    same = doc[:-1] == doc[1:]
    once = np.unique((doc.astype(np.uint64) << np.uint64(WORD_BITS)) | (h >> np.uint64(64 - WORD_BITS)))  # a word counts once a text
    return {
        "has": ((once >> np.uint64(WORD_BITS)).astype(np.int64), (once & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)),
        "word": (doc, (h >> np.uint64(64 - PAIR_BITS)).astype(np.int64)),
        "pair": (doc[:-1][same], (two[same] >> np.uint64(64 - PAIR_BITS)).astype(np.int64)),
    }


def blocks(column: pa.Array):
    raw, at = column_bytes(column)
    a, n = 0, len(at) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(at, at[a] + BLOCK, "right")) - 1))
        yield a, b, raw[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


def _count(batches):
    """Per task, counts of each kind over raw (all rows) and target (rows flagged), in chunks; kind '' has the rows."""
    total = {(k, t): np.zeros(1 << bits, np.int64) for k, bits in KINDS.items() for t in (False, True)}
    rows = np.zeros(CHUNK, np.int64)
    for batch in batches:
        flag = np.asarray(batch.column(1))
        rows[:3] += len(flag), int(flag.sum()), int(np.asarray(batch.column(2)).sum())
        for a, b, raw, at in blocks(batch.column(0)):
            target = flag[a:b]
            for kind, (doc, bucket) in ngrams(raw, at).items():
                total[kind, False] += np.bincount(bucket, minlength=1 << KINDS[kind])
                if target.any():
                    total[kind, True] += np.bincount(bucket[target[doc]], minlength=1 << KINDS[kind])
    for (kind, target), counts in [*total.items(), (("", False), rows)]:
        part = counts.reshape(-1, CHUNK)
        some = np.flatnonzero(part.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array([f"{kind}{int(target)}"] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array([part[k].astype("<u4" if part[k].max() < 1 << 32 else "<u8").tobytes() for k in some], pa.binary())], ["kind", "chunk", "counts"])


def _add(batches):
    """Sums of chunks that stand together; memory holds one chunk."""
    last, total = None, None
    row = lambda: pa.RecordBatch.from_arrays([pa.array([last[0]]), pa.array([last[1]], pa.int32()), pa.array([total.astype("<u8").tobytes()], pa.binary())], ["kind", "chunk", "counts"])
    for batch in batches:
        for kind, chunk, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = np.frombuffer(counts, "<u4" if len(counts) == 4 * CHUNK else "<u8")
            if (kind, chunk) == last:
                total += part
                continue
            if last:
                yield row()
            last, total = (kind, chunk), part.astype(np.int64)
    if last:
        yield row()


class Model:
    """Log ratios of target and raw text by bucket, from the counts of both."""

    def __init__(self, chunks: list) -> None:
        full = {f"{k}{t}": np.zeros(1 << bits) for k, bits in KINDS.items() for t in (0, 1)} | {"0": np.zeros(CHUNK)}
        for kind, chunk, counts in chunks:
            full[kind][chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(counts, "<u8")
        raw_rows, target_rows = full["0"][:2]
        self.ratio = {}
        for kind in KINDS:
            raw, target = full[f"{kind}0"], full[f"{kind}1"]
            share = target_rows / max(raw_rows, 1) if kind == "has" else target.sum() / max(raw.sum(), 1)
            expected = raw * share
            ratio = np.log((target + SMOOTH) / (expected + SMOOTH))
            if kind == "has":
                ratio = np.where(np.abs(expected - target) > CHANCE * np.sqrt(expected + 0.5), ratio, 0)
            self.ratio[kind] = ratio.astype(np.float32)

    def ratios(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Each text's log ratio by its words and word pairs, and by the words that it has."""
        sums, has = np.zeros(len(column)), np.zeros(len(column))
        for a, b, raw, at in blocks(column):
            found = {k: np.bincount(doc, self.ratio[k][bucket], b - a) for k, (doc, bucket) in ngrams(raw, at).items()}
            sums[a:b], has[a:b] = found["word"] + found["pair"], found["has"]
        return sums, has


def labelled_sample(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(labelled_id, good): a bounded sample by hash of labelled rows; conflicting rows count by their worst."""
    own = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic")).where("doc_id is not null")
    return own.orderBy(F.xxhash64("doc_id")).limit(most).select(F.col("doc_id").alias("labelled_id"), F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False)).alias("good"))


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[Model, float]:
    """The models, counted over all documents, and the share of good rows among those of labelled documents (1 if there are none)."""
    spark = docs.sparkSession
    with small_batches(spark):
        sample = cut_lineage(labelled_sample(labels, most))
        rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id"), "left")
        flagged = rows.select("text", F.coalesce("good", F.lit(False)).alias("target"), F.col("labelled_id").isNotNull().alias("labelled"))
        parts = flagged.mapInArrow(lean(_count), "kind string, chunk int, counts binary")
        summed = parts.repartition("kind", "chunk").sortWithinPartitions("kind", "chunk").mapInArrow(_add, "kind string, chunk int, counts binary")
        chunks = [tuple(r) for r in summed.collect()]
    _, target, labelled = next((np.frombuffer(counts, "<u8")[:3] for kind, chunk, counts in chunks if (kind, chunk) == ("0", 0)), (0, 0, 0))
    return Model(chunks), float(target / labelled) if labelled else 1.0


def weighted(docs: DataFrame, model: Model, temperature: float = 1.0) -> DataFrame:
    """docs with log_weight, log_presence, supported and sample_key: the log importance, that of presences, whether it reaches OUTSIDE, and the log importance with Gumbel noise from doc_id and text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in RESULTS]
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(9), "doc_id", "text"), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    rows = docs.select(*kept, (-F.log(-F.log(draw)) * temperature).alias("__noise"), text_or_empty().alias("__text"))

    def run(batches):
        for batch in batches:
            *own, noise, text = batch.columns
            weight, presence = shared.value.ratios(text)
            yield pa.RecordBatch.from_arrays([*own, pa.array(weight), pa.array(presence), pa.array(presence >= OUTSIDE), pa.array(weight + np.asarray(noise))], [*kept, *RESULTS])

    double = T.DoubleType()
    schema = T.StructType([*docs.select(*kept).schema.fields, *(T.StructField(c, t) for c, t in zip(RESULTS, (double, double, T.BooleanType(), double), strict=True))])
    return rows.mapInArrow(lean(run), schema)


def kth_largest(rows: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of a column of finite doubles, by histograms of 1024 bins, each within one bin of the last."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    above = 0
    while low < high:
        bin_of = F.least(F.lit(1023), F.floor((F.col(key) - low) / (high - low) * 1024))
        bins = {r.b: (r.n, r.low, r.high) for r in rows.where(F.col(key).between(low, high)).groupBy(bin_of.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()}
        for b in sorted(bins, reverse=True):
            n, low, high = bins[b]
            if above + n >= k:
                break
            above += n
    return low


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, most: int = LABELLED, columns: list[str] | None = None, temperature: float = 1.0) -> DataFrame:
    """The k drawn documents (by default as many as the labelled rows' share of good ones lets expect) with the results; of docs all columns, or those given. Weights are read once and written with the rows."""
    model, share = fit(docs, labels, most)
    with small_batches(docs.sparkSession):
        scored = cut_lineage(weighted(docs, model, temperature).select(*(columns or [c for c in docs.columns if c not in RESULTS]), *RESULTS))
    n, inside = scored.agg(F.count("*"), F.count_if("supported")).first()
    k = round(n * share) if k is None else k
    if k <= 0 or not n:
        return scored.limit(0)
    part = F.col("supported") if k <= inside else ~F.col("supported")
    left = k if k <= inside else min(k, n) - inside
    if not left:
        return scored.where("supported")
    drawn = part & (F.col("sample_key") >= F.lit(float(kth_largest(scored.where(part), "sample_key", left))))
    return scored.where(drawn if k <= inside else F.col("supported") | drawn)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(docs, labels, columns=["doc_id"])
