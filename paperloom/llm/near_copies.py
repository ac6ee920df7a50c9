"""Near copies: SimHash links, and texts whose word shingles are alike.

Four differing bits of 64 are a strict measure: texts that share four fifths of their shingles lie some ten bits apart.
So the links of simhash are joined by those of similar texts. Two successive four-word shingles stand for one of five
words, so the same scan that makes the fingerprint gives the five-word ones. Of these a text keeps a signature: the
least hash in each of BINS bins, to 16 bits. Texts whose shares of equal bins (of those that either fills) reach
SIMILARITY less one standard error are linked. Candidates are texts that agree on one of BANDS keys, each from the least
hashes of ROWS bins of their own: at a similarity of 0.8 some 99.8 of a hundred pairs do. Of equal fingerprints one
document speaks for all. A key's group is searched like those of simhash, by a forest over the texts not reached yet,
and a group of over GROUP texts is dealt in pairs of chunks, so no pair is lost and no task holds the group.

Defined cases: as in simhash; a text of fewer than five words has one shingle, the whole; one without words has
fingerprint zero and links by that alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import mixed
from .common import cut_lineage, lean, small_batches, text_or_empty
from .components import components
from .simhash import DISTANCE, links, majority, shingles

SIMILARITY, BINS, BANDS, ROWS = 0.8, 256, 12, 4
#: What the estimate from BINS bins errs by.
ERROR = (SIMILARITY * (1 - SIMILARITY) / BINS) ** 0.5
GROUP = 2_000


def five_words(hashes: bytes) -> np.ndarray:
    """The different five-word shingles, from the values of the four-word ones in order."""
    four = np.frombuffer(hashes, ">u8").astype(np.uint64)
    return np.unique(mixed(four[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ four[1:]) if len(four) > 1 else mixed(four))


def signature(five: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """(least hash of each bin to 16 bits, 0 for an empty one; the keys of the bands that are not empty) of ascending different hashes."""
    out = np.zeros(BINS, np.uint16)
    bins, first = np.unique(five >> np.uint64(56), return_index=True)
    out[bins.astype(np.intp)] = five[first] % np.uint64(65535) + np.uint64(1)
    other = np.sort(mixed(five + np.uint64(1)))
    own = (other >> np.uint64(32)) * np.uint64(BANDS * ROWS) >> np.uint64(32)
    bins, first = np.unique(own, return_index=True)
    least = np.zeros(BANDS * ROWS, np.uint64)
    least[bins.astype(np.intp)] = other[first]
    key = np.arange(1, BANDS + 1).astype(np.uint64)
    for row in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) ^ least[row::ROWS])
    return out, key[least.reshape(BANDS, ROWS).any(axis=1)].view(np.int64).tolist()


def _signed(batches):
    for batch in batches:
        *other, text = batch.columns
        fp, sig, keys = [], [], []
        for x in text:
            hashes = shingles(x.as_buffer().to_pybytes())
            own, bands = signature(five_words(hashes)) if hashes else (np.zeros(BINS, np.uint16), [])
            fp.append(majority(hashes))
            sig.append(own.tobytes())
            keys.append(bands)
        yield pa.RecordBatch.from_arrays([*other, pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(sig, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], [*batch.schema.names[:-1], "fp", "sig", "keys"])


def alike(signatures: np.ndarray, one: np.ndarray) -> np.ndarray:
    """The share of bins that are equal, of those that either fills."""
    either = ((signatures != 0) | (one != 0)).sum(axis=1)
    return ((signatures == one) & (one != 0)).sum(axis=1) / np.maximum(either, 1)


def _forest(fp: np.ndarray, sig: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of one group."""
    out, rest = [], np.arange(len(fp))
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = alike(sig[rest], sig[x]) >= SIMILARITY - ERROR
            found = rest[near]
            out += [(int(fp[x]), int(fp[y])) for y in found]
            frontier += found.tolist()
            rest = rest[~near]
    return out


def _groups(batches):
    """Rows (key, fp, sig) come by key; each group is at most two chunks."""
    last, fp, sig = None, [], []

    def flush():
        found = _forest(np.array(fp), np.frombuffer(b"".join(sig), np.uint16).reshape(-1, BINS)) if len(fp) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([max(p) for p in found], pa.int64()), pa.array([min(p) for p in found], pa.int64())], ["a", "b"])

    for batch in batches:
        for key, f, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last:
                yield flush()
                last, fp, sig = key, [], []
            fp.append(f)
            sig.append(s)
    yield flush()


def similar_links(distinct: DataFrame, most: int = GROUP) -> DataFrame:
    """(a, b): links of similar texts among rows (fp, sig, keys) of different fp."""
    keyed = distinct.select("fp", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    rows = cut_lineage(keyed.join(shared, "key"))  # a table of its own, so that the key of a third of all texts is split in the join
    chunks = F.when(F.col("n") > most, F.ceil(2 * F.col("n") / most)).otherwise(1).cast("long")
    own = F.pmod(F.xxhash64("fp"), chunks)
    pair = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j"))))
    dealt = rows.join(distinct.select("fp", "sig"), "fp").select("key", "fp", "sig", pair.alias("pair")).select(F.xxhash64("key", "pair").alias("key"), "fp", "sig")
    with small_batches(distinct.sparkSession):
        return cut_lineage(dealt.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lean(_groups), "a long, b long")).distinct()


def survivors(docs: DataFrame, distance: int = DISTANCE, most: int = GROUP) -> DataFrame:
    """(doc_id, text_hash), the XXH64 of its text, of one row for each group of near copies: the least doc_id, nulls last, then the least hash."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text_or_empty().cast("binary").alias("text"))
    kinds = ", ".join(f"{c} {kind}" for c, kind in rows.dtypes[:-1])
    row = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")
    with small_batches(docs.sparkSession):
        each = cut_lineage(rows.mapInArrow(lean(_signed), f"{kinds}, fp long, sig binary, keys array<long>"))
    distinct = cut_lineage(each.groupBy("fp").agg(F.min(row).alias("least"), F.min_by(F.struct("sig", "keys"), row).alias("x")).select("fp", "least", "x.sig", "x.keys"))
    both = links(distinct, distance).unionByName(similar_links(distinct, most)).distinct()
    node = cut_lineage(components(both).withColumnRenamed("node", "fp"))
    least = distinct.select("fp", "least")
    chosen = least.join(node, "fp", "left_anti").select("least").unionByName(least.join(node, "fp").groupBy("component").agg(F.min("least").alias("least")).select("least"))
    return chosen.select("least.doc_id", "least.text_hash")
