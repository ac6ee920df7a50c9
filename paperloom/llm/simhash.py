"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits: each is 1 if set in over half of the XXH64 values of the text's word shingles.
Fingerprints link at DISTANCE or fewer differing bits. Candidates come from three segments of 22, 21 and 21
bits. The perfect Golay code (23, 12) gives a segment one or six codeword indices, those of the words one
bit away or nearer; two segments that differ in at most two bits share one of them, as a word between both
decodes to it. At most four errors over three segments leave either a segment without error, and then one
of the others with two at most: key = the clean segment and an index of the other; or one error in two
segments and at most two in the third: key = a clean half of both and an index of the third. That makes 18
tables of 33-bit keys, so no link is missed. Equal keys meet by sort; in a group a search from each unseen
fingerprint over those not reached yet gives a spanning forest of all links by true distance, never all
pairs. A group of over GROUP fingerprints is dealt in chunks by hash, and every two chunks meet in a task of their own,
so no link is lost and no task holds the group. Fingerprints are joined once each, however many documents share one.

Defined cases: null or wordless text has fingerprint zero, linked like any other; equal texts have equal
fingerprints; repeated rows have a row each; a very long text is hashed whole by its task; a null doc_id takes part but
can't name a component unless all of its ids are null; an empty table gives an empty result; columns beyond doc_id and
text are ignored.
"""

from __future__ import annotations

import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, lean, small_batches, text_or_empty
from .components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints of one key that one task searches, and fingerprints of one task that makes keys.
GROUP, KEYED = 20_000, 20_000
#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the binary Golay code of length 23.
GOLAY = 0b101011100011


def shingles(text: bytes) -> bytes:
    """The XXH64 values of a text's word shingles, eight bytes each from the highest; of the whole sequence if it has fewer words, none without words."""
    norm = b" ".join(text.lower().split())
    if not norm:
        return b""
    gaps = np.flatnonzero(np.frombuffer(norm, np.uint8) == 0x20).tolist()
    starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(norm)]
    digest = xxhash.xxh64_digest
    if len(starts) <= SHINGLE:
        return digest(norm, SEED)
    return b"".join([digest(norm[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :], strict=False)])


def majority(hashes: bytes) -> int:
    """A bit for each that over half of the values set."""
    n = len(hashes) // 8
    if not n:
        return 0
    lanes = np.frombuffer(hashes, np.uint8).reshape(n, 8)
    if n < 64:
        ones = np.unpackbits(lanes, axis=1).sum(axis=0)
    else:
        ones = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint(text: bytes) -> int:
    return majority(shingles(text))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _fingerprints(batches):
    for batch in batches:
        *other, text = batch.columns
        each = [fingerprint(x.as_buffer().to_pybytes()) for x in text]
        yield pa.RecordBatch.from_arrays([*other, pa.array(np.array(each, np.uint64).view(np.int64))], [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, *also: Column) -> DataFrame:
    """(doc_id, fp) with the 64 bits as a signed long; further columns stand between."""
    rows = docs.select("doc_id", *also, text_or_empty().cast("binary").alias("text"))
    return rows.mapInArrow(lean(_fingerprints), ", ".join(f"{c} {kind}" for c, kind in rows.dtypes[:-1]) + ", fp long")


def _remainder(word: int) -> int:
    for k in range(22, 10, -1):
        if word >> k & 1:
            word ^= GOLAY << (k - 11)
    return word


@lru_cache(maxsize=1)
def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a word; for each syndrome, the changes that make a word the codewords near it, -1 for none."""
    unit = [_remainder(1 << k) for k in range(23)]
    low, high = np.zeros(1 << 12, np.int64), np.zeros(1 << 11, np.int64)
    for k in range(12):
        low ^= np.where(np.arange(1 << 12) >> k & 1, unit[k], 0)
    for k in range(11):
        high ^= np.where(np.arange(1 << 11) >> k & 1, unit[12 + k], 0)
    leader = np.full(1 << 11, -1, np.int64)
    for size in range(4):
        for bits in itertools.combinations(range(23), size):
            s = 0
            for b in bits:
                s ^= unit[b]
            if leader[s] < 0:
                leader[s] = sum(1 << b for b in bits)
    near = np.full((1 << 11, 6), -1, np.int64)
    for s in range(1 << 11):
        found = sorted({int(leader[s])} | {int(leader[s ^ unit[b]]) ^ (1 << b) for b in range(23)})
        near[s, : len(found)] = found
    return low, high, near


def indices(segment: np.ndarray) -> np.ndarray:
    """The six codeword indices of each segment of up to 23 bits, -1 where there is but one."""
    low, high, near = golay_tables()
    change = near[low[segment & 0xFFF] ^ high[segment >> 12]]
    return np.where(change < 0, -1, (segment[:, None] ^ change) >> 11)


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all 18 tables."""
    value = fp.view(np.uint64)
    part = [((value >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    index = [indices(x) for x in part]
    half = [(x & 0x7FF, x >> 11) for x in part]
    exact = [(part[i], j) for i, j in itertools.permutations(range(3), 2)]
    for k in range(3):
        i, j = (x for x in range(3) if x != k)
        exact += [((half[i][a] << 11) | half[j][b], k) for a in (0, 1) for b in (0, 1)]
    rows, out = [], []
    for table, (clean, j) in enumerate(exact):
        row, column = np.nonzero(index[j] >= 0)
        rows.append(row)
        out.append((np.int64(table) << 34) | (clean[row] << 12) | index[j][row, column])
    return np.concatenate(rows), np.concatenate(out)


def _keyed(batches):
    for batch in batches:
        fp = np.asarray(batch.column(0))
        row, key = keys(fp)
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row])], ["key", "fp"])


def distances(a: np.ndarray, b) -> np.ndarray:
    """Differing bits; of signed numbers bitwise_count would count the absolute value's."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def forest(group: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of different fingerprints of one group."""
    out, rest = [], group
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = distances(rest, x) <= distance
            if near.any():
                found = rest[near]
                out.append((np.full(len(found), x), found))
                frontier += found.tolist()
                rest = rest[~near]
    return out


def _linked(distance: int, most: int):
    """From rows (key, part, fp) in order, links (a, b) of each group of equal key and part; of a group of over `most`, nothing but rows (key, fp) to be dealt anew."""

    def links(key: np.ndarray, fp: np.ndarray):
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, len(key)))
        two = start[size == 2]
        two = two[distances(fp[two], fp[two + 1]) <= distance]
        found, big = [(fp[two], fp[two + 1])], [(key[:0], fp[:0])]
        for a, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if n > most:
                big.append((key[a : a + n], fp[a : a + n]))
            else:
                found += forest(fp[a : a + n], distance)
        a, b = np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])
        pairs = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        yield batch_of(pairs[:, 0], pairs[:, 1], None)
        for key, fp in big:
            yield batch_of(fp, fp, key)

    def batch_of(a, b, key):
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)], ["a", "b", "key"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        count, passed = 0, None  # the key of a group that is being passed on
        for batch in batches:
            key, fp = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            if passed is not None and len(key):
                own = int(np.searchsorted(key, passed, "right"))
                if own:
                    yield batch_of(fp[:own], fp[:own], key[:own])
                key, fp = key[own:], fp[own:]
                passed = None if len(key) else passed
            if not len(key):
                continue
            held.append((key, fp))
            count += len(key)
            if count < 200_000:
                continue
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            if cut == 0 and count > most:
                yield batch_of(fp, fp, key)
                held, count, passed = [], 0, key[-1]
                continue
            if cut:
                yield from links(key[:cut], fp[:cut])
            held, count = [(key[cut:], fp[cut:])], len(key) - cut
        if held:
            yield from links(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def links(distinct: DataFrame, distance: int = DISTANCE, most: int = GROUP) -> DataFrame:
    """(a, b): links that span every component of different fingerprints (column fp). Keys are complete up to DISTANCE only."""
    if distance > DISTANCE:
        raise ValueError(f"keys find all links up to {DISTANCE} differing bits, not {distance}")
    spark, schema = distinct.sparkSession, "a long, b long, key long"
    dealt = distinct.select("fp").repartition(-(-max(1, distinct.count()) // KEYED))
    with small_batches(spark, 20_000):
        keyed = dealt.mapInArrow(_keyed, "key long, fp long")
        found = cut_lineage(keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(lean(_linked(distance, most)), schema))
        big = found.where("key is not null")
        chunks = cut_lineage(big.groupBy("key").agg(F.ceil(2 * F.count("*") / most).cast("int").alias("chunks")))
        out = found.where("key is null")
        if not chunks.isEmpty():
            own = F.pmod(F.xxhash64("a"), F.col("chunks"))
            pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(F.least(x.cast("long"), own).alias("i"), F.greatest(x.cast("long"), own).alias("j"))))
            met = big.join(chunks, "key").select("a", "key", pair.alias("pair")).select(F.xxhash64("key", "pair").alias("key"), F.col("a").alias("fp"))
            again = met.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_linked(distance, 1 << 62), schema)
            out = out.unionByName(cut_lineage(again))
    return out.select("a", "b").distinct()


def _with_component(distinct: DataFrame, distance: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Different fingerprints (column fp and others) without any link, and those with links, written with the least fingerprint that links reach as component."""
    node = cut_lineage(components(links(distinct, distance, most)).withColumnRenamed("node", "fp"))
    return distinct.join(node, "fp", "left_anti"), cut_lineage(distinct.join(node, "fp"))


def _fingerprint_table(docs: DataFrame, *also: Column) -> DataFrame:
    with small_batches(docs.sparkSession):
        return cut_lineage(fingerprints(docs, *also))


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, most: int = GROUP) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach."""
    each = _fingerprint_table(docs)
    alone, linked = _with_component(cut_lineage(each.groupBy("fp").agg(F.min("doc_id").alias("least"))), distance, most)
    # a table of its own, so that a component of many fingerprints is split in the join
    least = cut_lineage(linked.groupBy("component").agg(F.min("least").alias("component_id")))
    classes = alone.select("fp", F.col("least").alias("component_id")).unionByName(linked.join(least, "component").select("fp", "component_id"))
    return each.join(classes, "fp").select("doc_id", "fp", "component_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
