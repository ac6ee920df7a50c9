"""BPE encoding and decoding through a table of distinct words.

Words (pre-tokens) are split in tasks, which count their distinct ones. Of the table of distinct words the `most`
frequent, at most so many whatever the corpus, are encoded in tasks and go out as one compact broadcast; words that
it lacks meet by word, each distinct one is encoded once there, and its ids go back to the rows that hold it. Either
way a row's ids are put together by the positions of its words. Words are equal if their bytes are. Texts travel
packed, once, for that join. Decoding goes through the id-to-piece table of the vocabulary, whose size is fixed.

Defined cases: null text counts as empty; texts that hold an added token's string are encoded by the library
as they are; a very long text is split whole by one task; equal rows have equal results, with or without doc_id (they
share one list of rare words, by the hash of id and text; a shared hash would only join two lists); an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import Encoder, Spans, Table, shared_bpe
from .common import column_bytes, cut_lineage, pieces, small_batches, text_or_empty
from .token_counts import block_words, encoded_table, most_frequent

#: Words of the broadcast table at most: about 35 MB as it is sent.
BROADCAST = 1 << 20
#: Distinct words that a task holds before it passes them on.
HELD = 1 << 19


def _distinct(path: str):
    def flush(seen: dict):
        again = [(w, n) for w, n in seen.items() if n > 1]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in again], pa.binary()), pa.array([n for _, n in again], pa.int64())], ["word", "n"])

    def run(batches):
        encoder, seen = Encoder(path, cache=1), {}
        for batch in batches:
            for _, _, part, at in encoder.blocks(*column_bytes(batch.column(0))):
                if encoder.bpe.has_special(part):
                    plain = [k for k in range(len(at) - 1) if not encoder.bpe.has_special(part[at[k] : at[k + 1]])]
                    size = np.diff(at)[plain]
                    part = part[pieces(at[:-1][plain], size)]
                    at = np.concatenate([[0], np.cumsum(size)])
                for word, n in zip(*block_words(encoder.bpe, part, at), strict=True):
                    seen[word] = seen.get(word, 0) + int(n)
            if len(seen) > HELD:
                yield flush(seen)
                seen = {}
        yield flush(seen)

    return run


def word_counts(docs: DataFrame, path: str) -> DataFrame:
    """(word, n): words that occur more than once in some task, with their counts there; written to the shared folder."""
    return cut_lineage(docs.select(text_or_empty().alias("text")).mapInArrow(_distinct(path), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


class Known:
    """Ids of blocks of texts by a table alone, and the words that it lacks."""

    def __init__(self, path: str, table: Table) -> None:
        self.bpe, self.table = shared_bpe(path), table

    def lookup(self, raw: np.ndarray, at: np.ndarray):
        starts, before = self.bpe.split(raw, at)
        ends = np.append(starts[1:], len(raw))
        return self.table.find(Spans(raw, starts, ends)), starts, ends, before


def _missing(path: str, shared):
    """(key, word) for the different words of each row that the table lacks; rows with added tokens have none."""

    def run(batches):
        known, blocks = Known(path, shared.value), Encoder(path, cache=1).blocks
        for batch in batches:
            key = np.asarray(batch.column(0))
            for a, b, part, at in blocks(*column_bytes(batch.column(1))):
                entry, starts, ends, before = known.lookup(part, at)
                miss = np.flatnonzero(entry < 0)
                if known.bpe.has_special(part):
                    special = np.array([known.bpe.has_special(part[at[k] : at[k + 1]]) for k in range(b - a)])
                    miss = miss[~special[np.searchsorted(before, miss, "right") - 1]]
                data = part.tobytes()
                own = key[a:b][np.searchsorted(before, miss, "right") - 1].tolist()
                pairs = list(dict.fromkeys(zip(own, (data[x:y] for x, y in zip(starts[miss].tolist(), ends[miss].tolist(), strict=True)), strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in pairs], pa.int64()), pa.array([w for _, w in pairs], pa.binary())], ["key", "word"])

    return run


def _encoded(path: str):
    """Words that stand together are encoded once, and equal rows' words go back once."""

    def run(batches):
        merge, last, ids, last_key = shared_bpe(path).merge, None, b"", None
        for batch in batches:
            out = []
            for key, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if word != last:
                    last, ids, last_key = word, np.array(merge(word), "<u2").tobytes(), None
                if key != last_key:
                    out.append((key, word, ids))
                last_key = key
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["key", "word", "ids"])

    return run


def _packed(batches):
    for batch in batches:
        pack = zstandard.ZstdCompressor(level=3).compress
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([pack(x.as_buffer()) for x in batch.column(2)], pa.binary())], ["key", "doc_id", "text"])


def _digests(path: str, shared):
    """Ids of each document from the table and its joined words; their digest, and that of the text decoded from them."""

    def run(batches):
        known = Known(path, shared.value)
        size = np.array([len(x) for x in known.bpe.vocabulary], np.int64)
        first, piece = np.cumsum(size) - size, np.frombuffer(b"".join(known.bpe.vocabulary), np.uint8)
        blocks, unpack = Encoder(path, cache=1).blocks, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            texts = [unpack(x.as_buffer()) for x in batch.column(1)]
            raw, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
            n, ids_sha, text_sha = [], [], []
            for a, b, part, own in blocks(raw, at):
                special = known.bpe.has_special(part)
                entry, starts, ends, before = known.lookup(part, own)
                for i in range(b - a):
                    text = part[own[i] : own[i + 1]]
                    if special and known.bpe.has_special(text):
                        ids = np.array(known.bpe.encode_text(text.tobytes()), np.int64)
                    else:
                        rows = slice(before[i], before[i + 1])
                        ids = _document(known.table, entry[rows], part, starts[rows], ends[rows], batch.column(2)[a + i].as_py())
                    back = piece[pieces(first[ids], size[ids])].tobytes()
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(back.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _document(table: Table, entry: np.ndarray, part: np.ndarray, starts: np.ndarray, ends: np.ndarray, rare) -> np.ndarray:
    """The ids of one document: the table's, and those of its joined words at their positions."""
    here = entry >= 0
    count = np.where(here, table.count[np.where(here, entry, 0)], 0).astype(np.int64)
    if here.all():
        return table.pool[pieces(table.first[entry], count)].astype(np.int64)
    joined = {x["word"]: x["ids"] for x in rare or ()}
    position = np.flatnonzero(~here)
    words = [joined[part[a:b].tobytes()] for a, b in zip(starts[position].tolist(), ends[position].tolist(), strict=True)]
    count[position] = [len(x) // 2 for x in words]
    end = np.cumsum(count)
    out = np.empty(int(end[-1]), np.int64)
    own = np.flatnonzero(here)
    out[pieces((end - count)[own], count[own])] = table.pool[pieces(table.first[entry[own]], count[own])]
    out[pieces((end - count)[position], count[position])] = np.frombuffer(b"".join(words), "<u2")
    return out


def encode_and_decode(docs: DataFrame, path: str, most: int = BROADCAST) -> DataFrame:
    """doc_id, n_tokens and the digests of each document's ids and of the text decoded from them."""
    spark = docs.sparkSession
    with small_batches(spark):
        table = encoded_table(most_frequent(word_counts(docs, path), most), path)
    shared = spark.sparkContext.broadcast(table)
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    missing = keyed.select("key", "text").mapInArrow(_missing(path, shared), "key long, word binary")
    met = missing.repartition("word").sortWithinPartitions("word", "key").mapInArrow(_encoded(path), "key long, word binary, ids binary")
    found = met.groupBy("key").agg(F.collect_list(F.struct("word", "ids")).alias("rare"))
    packed = keyed.select("key", "doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_packed, "key long, doc_id long, text binary")
    joined = packed.join(found.hint("shuffle_merge"), "key", "left").select("doc_id", "text", "rare")
    return joined.mapInArrow(_digests(path, shared), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
