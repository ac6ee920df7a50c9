"""Document fingerprints by consistent weighted sampling.

A text's terms are its words (runs without white space), weighted by their counts. For each of SAMPLES draws
a term t has r and c from Gamma(2, 1) and b from U(0, 1), all from the hash of t and the draw's number. With weight w,

    level = floor(ln w / r + b),  ln y = r (level - b),  ln a = ln c - ln y - r,

and the draw takes the term of least a with its level. Two texts take the same pair with a probability equal
to their generalised Jaccard similarity, sum of min over sum of max of weights. A fingerprint keeps 16 bits
of each pair's hash, so a draw collides by chance once in 65,536; likeness is the share of equal draws.

Words of weight one need only r (b) and c at level 0; their ln a is kept for as many words as a worker's
bounded caches hold, and drawn anew, to the same values, for others.

The next document is found by ranges: bounds from a sample cut the order into ranges of some thousand rows, each is
sorted by one task as a stream, and the first row of a range also goes to the end of the range before it.

Defined cases: null text counts as empty; texts without words have equal fingerprints, all zero, and are
alike to each other only; equal texts have equal fingerprints; the next document is the next in the order
of doc_id (nulls first), then a hash of the text, then the text, so rows of one id or none lie in many ranges like
others and repeated rows follow each other; of one row the next is itself; a very long text is sampled in parts of its
terms; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import Keys, Spans, mixed
from .common import small_batches, text_or_empty

SAMPLES = 64
#: Words whose draws a worker keeps: at weight one, and whole.
WORDS, WHOLE = 1 << 16, 1 << 14
#: Bytes of texts that are taken at once, and terms of them.
BLOCK, TERMS = 1 << 18, 1 << 14
_UNIT = np.float32(2.0**-24)
#: Rows of a range, about; beyond MANY ranges up to WIDE of them, so that bounds stay few (16 bytes for each range).
RANGE_ROWS, MANY, WIDE = 2_000, 1_000, 100_000
#: Sampled rows for each bound.
SAMPLED = 8


class Sampler:
    """Signatures of texts, with bounded caches of words' draws."""

    def __init__(self, samples: int = SAMPLES) -> None:
        self.samples = samples
        draw = np.arange(1, samples + 1, dtype=np.uint64)
        self.salt = [mixed(draw * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k << 32)) for k in range(3)]
        self.one, self.one_values = Keys(WORDS), np.empty((2 * WORDS, samples), np.float32)
        self.full, self.full_values = Keys(WHOLE), np.empty((2 * WHOLE, 3, samples), np.float32)

    def draws(self, key: np.ndarray) -> np.ndarray:
        """r, b and ln c of each key and draw, from three 64-bit hashes cut into uniform numbers of 24 bits."""
        u = []
        for salt in self.salt:
            h = mixed(key[:, None] ^ salt)
            u += [((h >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * _UNIT, ((h >> np.uint64(8) & np.uint64(0xFFFFFF)).astype(np.float32) + np.float32(0.5)) * _UNIT]
        return np.stack([-np.log(u[0] * u[1]), u[2], np.log(-np.log(u[3] * u[4]))], axis=1)

    def _cached(self, table: Keys, values: np.ndarray, key: np.ndarray, make) -> np.ndarray:
        at = table.find(key)
        new = np.flatnonzero(at < 0)
        if len(new):
            made = make(key[new])
            room = table.limit - table.n
            if room < len(new):
                if len(new) > table.limit:
                    out = np.empty((len(key), *values.shape[1:]), np.float32)
                    out[at >= 0], out[new] = values[at[at >= 0]], made
                    return out
                table.clear()
                return self._cached(table, values, key, make)
            values[table.n : table.n + len(new)] = made
            at[new] = np.arange(table.n, table.n + len(new))
            table.place(key[new])
        return values[at]

    def _at_one(self, key: np.ndarray) -> np.ndarray:
        r, b, c = np.moveaxis(self.draws(key), 1, 0)
        return c + r * b - r

    def signatures(self, texts: list[bytes]) -> np.ndarray:
        """A row of 16-bit numbers, one for each draw, for every text."""
        out = np.zeros((len(texts), self.samples), np.uint16)
        size = np.cumsum([len(x) for x in texts])
        a = 0
        while a < len(texts):
            b = min(len(texts), max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + BLOCK, "right"))))
            self._block(texts[a:b], out[a:b])
            a = b
        return out

    def _block(self, texts: list[bytes], out: np.ndarray) -> None:
        raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        at = np.cumsum([0, *(len(x) + 1 for x in texts)])
        gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate([[1], gap.view(np.int8), [1]])))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return
        word = Spans(raw, starts, ends).key
        doc = np.searchsorted(at, starts, "right") - 1
        order = np.lexsort((word, doc))
        word, doc = word[order], doc[order]
        new = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1])]))
        count = np.diff(np.append(new, len(word)))
        word, doc = word[new], doc[new]
        best: dict[int, tuple] = {}
        for part in range(0, len(word), TERMS):
            rows = slice(part, part + TERMS)
            for d, least, pair in self._least(word[rows], count[rows], doc[rows]):
                if d in best:
                    better = least < best[d][0]
                    least, pair = np.where(better, least, best[d][0]), np.where(better, pair, best[d][1])
                best[d] = least, pair
        at = np.fromiter(best, np.int64, len(best))
        out[at] = (mixed(np.stack([pair for _, pair in best.values()])) >> np.uint64(48)).astype(np.uint16)

    def _least(self, key: np.ndarray, count: np.ndarray, doc: np.ndarray):
        """(document, least ln a in sortable bits, pair) of some documents' terms, which stand together."""
        many = np.flatnonzero(count > 1)
        a = np.empty((len(key), self.samples), np.float32)
        single = np.flatnonzero(count == 1)
        a[single] = self._cached(self.one, self.one_values, key[single], self._at_one)
        r, b, c = np.moveaxis(self._cached(self.full, self.full_values, key[many], self.draws), 1, 0)
        level = np.floor(np.log(count[many].astype(np.float32))[:, None] / r + b)
        a[many] = c - r * (level - b) - r
        bits = a.view(np.uint32)
        bits = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31))
        packed = (bits.astype(np.uint64) << np.uint64(32)) | np.arange(len(key), dtype=np.uint64)[:, None]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        least = np.minimum.reduceat(packed, first, axis=0)
        row = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        place = np.full(len(key), -1)
        place[many] = np.arange(len(many))
        at = place[row]
        steps = np.zeros(row.shape, np.int64)
        own = at >= 0
        if own.any():
            steps[own] = level[at[own], np.broadcast_to(np.arange(self.samples), row.shape)[own]].astype(np.int64)
        pair = key[row] + steps.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        yield from zip(doc[first].tolist(), least >> np.uint64(32), pair, strict=True)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points, rounded down, replaced by as many from the start of following."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def sort_key(doc_id: pa.Array, text_hash: pa.Array) -> np.ndarray:
    """(doc_id, hash of the text) as bytes that sort as the pair does, nulls first."""
    out = np.zeros(len(doc_id), [("some", ">u1"), ("id", ">u8"), ("hash", ">u8")])
    flip = lambda x: np.asarray(x).view(np.uint64) ^ np.uint64(1 << 63)
    out["some"], out["id"], out["hash"] = np.asarray(doc_id.is_valid()), flip(doc_id.fill_null(0)), flip(text_hash)
    return out.view("S17")


def bounds(keyed: DataFrame, rows: int) -> np.ndarray:
    """Lower bounds of all ranges but the first, from a sample by hash of (doc_id, text_hash)."""
    n = keyed.count()
    parts = max(1, min(-(-n // rows), max(MANY, -(-n // WIDE))))
    every = max(1, n // (parts * SAMPLED))
    sample = keyed.select("doc_id", "text_hash").where(F.pmod(F.xxhash64(F.lit(3), "doc_id", "text_hash"), F.lit(every)) == 0).toArrow()
    keys = np.sort(sort_key(*(sample.column(c).combine_chunks() for c in ("doc_id", "text_hash"))))
    return np.unique(keys[(np.arange(1, parts) * len(keys)) // parts]) if parts > 1 and len(keys) else keys[:0]


def _place(shared):
    def run(batches):
        for batch in batches:
            at = np.searchsorted(shared.value, sort_key(batch.column(0), batch.column(1)), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], [*batch.schema.names, "range_no"])

    return run


def in_ranges(docs: DataFrame, rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """(range_no, is_next, doc_id, text_hash, text), documents by ranges and for each range the first document of the next one, of the last range that of the first; and the number of ranges."""
    spark = docs.sparkSession
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    cuts = bounds(keyed, rows)
    shared = spark.sparkContext.broadcast(cuts)
    narrow = keyed.select("doc_id", "text_hash").mapInArrow(_place(shared), "doc_id long, text_hash long, range_no int")
    row = F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "text_hash")
    first = {r.range_no: r.least for r in narrow.groupBy("range_no").agg(F.min(row).alias("least")).collect()}
    order = sorted(first)
    ids = spark.createDataFrame([(first[k].doc_id, first[k].text_hash, order[i - 1]) for i, k in enumerate(order)], "head_id long, head_hash long, to_range int")
    heads = keyed.join(F.broadcast(ids), (F.col("text_hash") == F.col("head_hash")) & F.col("doc_id").eqNullSafe(F.col("head_id")))
    heads = heads.groupBy("to_range").agg(F.min(F.struct("text_hash", "text", "doc_id")).alias("x"))
    placed = keyed.mapInArrow(_place(shared), "doc_id long, text_hash long, text string, range_no int")
    own = placed.select("range_no", F.lit(False).alias("is_next"), "doc_id", "text_hash", "text")
    return own.unionAll(heads.select(F.col("to_range").alias("range_no"), F.lit(True), "x.doc_id", "x.text_hash", "x.text")), len(cuts) + 1


def _pairs(samples: int):
    def run(batches):
        sampler = Sampler(samples)
        held = None  # the last row: range, whether it only follows, doc_id, text, its signature
        for batch in batches:
            number, is_next, doc_id, _, text = (c.to_pylist() for c in batch.columns)
            rows = list(zip(number, is_next, doc_id, text, sampler.signatures([x.encode() for x in text]), strict=True))
            rows, held = ([held] if held else []) + rows, rows[-1] if rows else held
            two = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if x[0] == y[0] and not x[1]]
            changed = [edited(x[3], y[3]).encode() for x, y in two]
            other = sampler.signatures(changed)
            out = [(x[2], len(x[3]), hashlib.sha256(e).hexdigest(), x[4].tobytes().hex(), o.tobytes().hex(), likeness(x[4], o), likeness(x[4], y[4])) for (x, y), e, o in zip(two, changed, other, strict=True)]
            columns = zip(*out, strict=True) if out else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return run


def compare_with_edits(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness; one shuffle of the texts, by ranges of doc_id."""
    with small_batches(docs.sparkSession, 10_000):
        placed, n = in_ranges(docs)
    rows = placed.repartition(n, "range_no").sortWithinPartitions("range_no", "is_next", "doc_id", "text_hash", "text")
    return rows.mapInArrow(_pairs(samples), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
