"""Lexical retrieval packing into windows of tokens.

Three passes. The first counts the document frequency of every word, the documents and their words over the whole
table. The second places documents: each is a vector of its words' tf-idf, projected to 64 dimensions by the bits
of the words' hashes, and walks down a tree of two-means cuts, built on a sample, to a leaf of at most about
SHARD_BYTES of text, a row counting ROW_BYTES besides. A cut lies within the middle half of its node's bytes, so a hot cluster is split like any
other; faint dimensions from a hash of doc_id and text split what is equal. The tree has at most LEAVES leaves; where
their shares are larger than a shard, the sides of fixed hyperplanes through the leaf's mean part them further, in
the tasks, as many as the bytes ask for. A table of one shard is searched whole.

The third packs. A shard holds a BM25 inverted index of its documents with the whole table's statistics. A seed
document opens a window; while there is room, the unused neighbour in the shard that BM25 ranks first for all words
of the seed follows it (a new seed, if none is left), and the one that crosses the end of the window is cut there
and seeds the next window with its rest. Only the shard's last window can stay short; it is stored as sequences of
power-of-two lengths, which need no padding.

Neighbours that the tree parts do not meet. Document frequencies are exact for all words: tasks hold those of the
TABLE_WORDS most frequent ones, and a table with more words joins the others to the documents that have them, so that
each document brings the frequencies of its own rare words along.

Each document is its ids and then END_ID. Each id lies in exactly one piece.

Defined cases: null text counts as empty and packs END_ID alone; equal scores go by doc_id, then text
(nulls first); a document without terms in common with any other goes on in that order; repeated rows are
packed each; a shard that grows beyond twice its size by repeated rows is packed in several runs, and a very long text
makes one by itself; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from copy import copy
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import Encoder
from .common import column_bytes, cut_lineage, lean, parts_of, pieces, small_batches, text_or_empty

WINDOW, END_ID = 1024, 0
SHARD_BYTES = 2 << 20
#: What a row counts for besides its bytes, so that empty and short texts bound a shard's rows as well.
ROW_BYTES = 256
#: Words whose document frequency each task holds, 12 bytes each.
TABLE_WORDS = 1 << 22
#: Documents of the sample for each leaf of the tree, and leaves at most: what the driver holds and cuts, whatever the table.
SAMPLE, LEAVES = 32, 1 << 12
#: Dimensions that words have, and those that part equal documents.
DIMENSIONS, FAINT = 64, 4
K1, B = 1.2, 0.75


class Statistics:
    """Documents, mean length and document frequencies of a table; a word that neither terms nor `rest` has stands in one document."""

    def __init__(self, n: int, mean: float, terms: np.ndarray, df: np.ndarray) -> None:
        self.n, self.mean, self.rest = n, mean, None
        order = np.argsort(terms)
        self.terms, self.df = terms[order], df[order].astype(np.int32)

    def beside(self, terms: np.ndarray, df: np.ndarray) -> Statistics:
        """These with the frequencies of further words, which may repeat."""
        terms, first = np.unique(terms, return_index=True)
        out = copy(self)
        out.rest = Statistics(self.n, self.mean, terms, df[first]) if len(terms) else None
        return out

    def frequency(self, words: np.ndarray) -> np.ndarray:
        other = 1 if self.rest is None else self.rest.frequency(words)
        if not len(self.terms):
            return np.full(len(words), other, np.int64)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, self.df[at], other).astype(np.int64)

    def idf(self, df: np.ndarray) -> np.ndarray:
        return np.log1p((np.maximum(self.n - df, 0) + 0.5) / (df + 0.5))


def pairs(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, document, occurrences) by document and word."""
    ends = before.tolist()
    words = np.concatenate([words[:0], *(np.sort(words[a:b]) for a, b in zip(ends, ends[1:], strict=False))])
    doc = np.repeat(np.arange(len(before) - 1), np.diff(before))
    first = np.flatnonzero(np.concatenate([[True], (words[1:] != words[:-1]) | (doc[1:] != doc[:-1])])) if len(words) else np.zeros(0, np.int64)
    return words[first], doc[first], np.diff(np.append(first, len(words)))


def postings(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The different words, and (place of the word, document, occurrences) by word and document."""
    word, doc, tf = pairs(words, before)
    order = np.argsort(word, kind="stable")
    word = word[order]
    new = np.concatenate([[True], word[1:] != word[:-1]])[: len(word)]
    return word[new], np.cumsum(new) - 1, doc[order], tf[order]


class Index:
    """BM25 over the words of a shard's documents, given as hashes; without statistics the shard is the whole table."""

    def __init__(self, words: np.ndarray, before: np.ndarray, whole: Statistics | None = None) -> None:
        n = len(before) - 1
        length = np.diff(before)
        unique, term, self.doc, tf = postings(words, before)
        self.df = np.bincount(term, minlength=len(unique))
        self.first = np.cumsum(self.df) - self.df
        if whole is None:
            whole = Statistics(n, length.mean() if n else 0, unique, self.df)
        idf = whole.idf(np.maximum(whole.frequency(unique), self.df))
        norm = K1 * (1 - B + B * length / max(1.0, whole.mean))
        self.weight = idf[term] * tf * (K1 + 1) / (tf + norm[self.doc])
        # the query of each document: its words that other documents have as well
        order = np.argsort(self.doc, kind="stable")
        order = order[self.df[term[order]] > 1]
        self.slot = term[order]
        self.start = np.searchsorted(self.doc[order], np.arange(n + 1))
        # words of many documents as rows of a matrix: a product adds them faster than their postings
        hot = np.flatnonzero(self.df * 8 > n)
        self.row = np.full(len(unique), -1)
        self.row[hot] = np.arange(len(hot))
        self.matrix = np.zeros((len(hot), n), np.float32)
        own = self.row[term] >= 0
        self.matrix[self.row[term[own]], self.doc[own]] = self.weight[own]

    def scores(self, seed: int, n: int) -> np.ndarray:
        """BM25 of all documents for all words of the seed."""
        terms = self.slot[self.start[seed] : self.start[seed + 1]]
        if not len(terms):
            return np.zeros(n)
        row = self.row[terms]
        chosen = np.zeros(len(self.matrix), np.float32)
        chosen[row[row >= 0]] = 1
        rare = terms[row < 0]
        at = pieces(self.first[rare], self.df[rare])
        return np.bincount(self.doc[at], self.weight[at], minlength=n) + chosen @ self.matrix


def words(encoder: Encoder, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' pre-tokens, and how many stand before each text."""
    keys, before = [np.zeros(0, np.uint64)], [0]
    for _, _, part, own in encoder.blocks(raw, at):
        found, count = encoder.keys(part, own)
        keys.append(found)
        before += (before[-1] + count[1:]).tolist()
    return np.concatenate(keys), np.array(before)


def lay_out(index: Index, before: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of a shard's pieces. before counts ids with END_ID."""
    n = len(before) - 1
    unused = np.ones(n, bool)
    left, nxt = n, 0
    out, sequence, used = [], 0, 0
    seed, scores = -1, None
    while left:
        if seed >= 0 and scores is None:
            scores = index.scores(seed, n)
            scores[~unused] = -1
        best = int(scores.argmax()) if scores is not None else -1
        if best < 0 or scores[best] <= 0:
            while not unused[nxt]:
                nxt += 1
            best, seed, scores = nxt, nxt, None  # no neighbour is left: a new seed goes on in the window
        unused[best] = False
        if scores is not None:
            scores[best] = -1
        left -= 1
        start, size = 0, int(before[best + 1] - before[best])
        while start < size:
            take = min(size - start, window - used)
            out.append((best, start, take, sequence, used))
            start, used = start + take, used + take
            if used == window:
                sequence, used = sequence + 1, 0
                seed, scores = (best, None) if start < size else (-1, None)
    if used & (used - 1):
        out = _powers_of_two(out, sequence, used)
    return out


def _powers_of_two(pieces: list, last: int, used: int) -> list:
    """The last window's pieces over sequences whose lengths are the powers of two in its length, largest first."""
    tail = [p for p in pieces if p[3] == last]
    ends, at = [], 0
    for bit in range(used.bit_length() - 1, -1, -1):
        if used >> bit & 1:
            ends.append((at, at := at + (1 << bit)))
    out = pieces[: len(pieces) - len(tail)]
    for doc, start, size, _, offset in tail:
        for k, (a, b) in enumerate(ends):
            low, high = max(a, offset), min(b, offset + size)
            if low < high:
                out.append((doc, start + low - offset, high - low, last + k, low - a))
    return out


def _counter(path: str):
    def run(batches):
        encoder, n, tokens, size = Encoder(path), 0, 0, 0
        terms, counts, held = [], [], 0

        def merged():
            term, place = np.unique(np.concatenate(terms), return_inverse=True)
            return term, np.bincount(place, np.concatenate(counts), minlength=len(term)).astype(np.int64)

        def rows(term, count):
            none = np.zeros(len(term), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(count), pa.array(none), pa.array(none)], COUNTS)

        for batch in batches:
            raw, at = column_bytes(batch.column(0))
            n, size = n + len(at) - 1, size + len(raw)
            found, before = words(encoder, raw, at)
            tokens += len(found)
            unique, count = np.unique(pairs(found, before)[0], return_counts=True)
            terms.append(unique)
            counts.append(count)
            held += len(unique)
            if held > 1 << 20:
                term, count = merged()
                if len(term) > 1 << 19:
                    yield rows(term, count)
                    term, count = term[:0], count[:0]
                terms, counts, held = [term], [count], len(term)
        if terms:
            yield rows(*merged())
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *(pa.array([x], pa.int64()) for x in (n, tokens, size))], COUNTS)

    return run


COUNTS = ["term", "df", "tokens", "bytes"]


def counted(texts: DataFrame, path: str) -> tuple[Statistics, int, DataFrame | None]:
    """Statistics of all rows of a table of texts, its bytes, and (term, df) of the words that its statistics have no place for, if there are any. Words of one row find nothing and are left out."""
    rows = texts.mapInArrow(lean(_counter(path)), ", ".join(f"{c} long" for c in COUNTS))
    with small_batches(texts.sparkSession):
        rows = cut_lineage(rows.groupBy("term").agg(*(F.sum(c).alias(c) for c in COUNTS[1:])).where("term is null or df > 1"))
    whole = rows.where("term is null").first()
    if whole is None:
        return Statistics(0, 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)), 0, None
    table, rest = rows.where("term is not null").select("term", F.col("df").cast("int").alias("df")), None
    held = table
    if table.count() > TABLE_WORDS:
        held = table.orderBy(F.desc("df"), "term").limit(TABLE_WORDS)
    found = held.toArrow()
    term, df = found.column("term").to_numpy(), found.column("df").to_numpy()
    if held is not table:
        least = int(df.min())
        rest = table.where((F.col("df") < least) | (F.col("df") == least) & (F.col("term") > int(term[df == least].max())))
    return Statistics(whole.df, whole.tokens / max(1, whole.df), term.view(np.uint64), df), whole.bytes, rest


def statistics(texts: DataFrame, path: str) -> tuple[Statistics, int]:
    """Statistics of all rows of a table of texts, and its bytes."""
    return counted(texts, path)[:2]


def _asker(path: str, whole):
    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            raw, at = column_bytes(batch.column(1))
            word, doc, _ = pairs(*words(encoder, raw, at))
            asked = np.flatnonzero(whole.value.frequency(word) == 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc[asked])), pa.array(word[asked].view(np.int64))], ["own", "term"])

    return run


def rare_words(keyed: DataFrame, path: str, whole, rest: DataFrame) -> DataFrame:
    """(own, rare): for each hash of a row (own, text) its words that the statistics lack, with their document frequencies. Rows that share a hash share the words of both, which does no harm."""
    with small_batches(keyed.sparkSession):
        asked = keyed.select("own", "text").mapInArrow(lean(_asker(path, whole)), "own long, term long")
        return cut_lineage(asked.join(rest, "term").groupBy("own").agg(F.collect_set(F.struct("term", "df")).alias("rare")))


def _rest(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and frequencies of a column of rare words, of all its rows."""
    flat = column.flatten()
    return flat.field("term").to_numpy().view(np.uint64), flat.field("df").to_numpy()


def vectors(encoder: Encoder, whole: Statistics, raw: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
    """A row for each text: its words by tf-idf in DIMENSIONS, of length 1, and faint ones from `own`, a hash of its row."""
    unique, term, doc, tf = postings(*words(encoder, raw, at))
    df = whole.frequency(unique)
    idf = np.where(df > 1, whole.idf(df), 0).astype(np.float32)
    sign = _SIGNS[unique.astype("<u8").view(np.uint8)].reshape(-1, DIMENSIONS)
    out = np.zeros((len(at) - 1, DIMENSIONS + FAINT), np.float32)
    order = np.argsort(doc.astype(np.uint16) if len(at) <= 1 << 16 else doc, kind="stable")
    weight = (_LOGS[np.minimum(tf, len(_LOGS) - 1)] * idf[term])[order]
    term, ends = term[order], np.cumsum(np.bincount(doc, minlength=len(at) - 1)).tolist()
    for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):  # one text at a time stays in the cache
        out[k, :DIMENSIONS] = weight[a:b] @ sign.take(term[a:b], axis=0)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    out[:, DIMENSIONS:] = (own.view(np.uint16).reshape(-1, FAINT) / 65536.0 - 0.5) * 1e-3
    return out


_SIGNS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float32) * 2 - 1
_LOGS = 1 + np.log(np.maximum(np.arange(1 << 12), 1)).astype(np.float32)


class Tree:
    """Two-means cuts; a leaf has at most `most` of the weights that it was built on, unless its rows are equal."""

    def __init__(self, rows: np.ndarray, weight: np.ndarray, most: float) -> None:
        self.normal, self.bound, self.child, self.leaves, means = [], [], [], 0, []
        todo = [(np.arange(len(rows)), None)]
        while todo:
            own, parent = todo.pop()
            cut = self._cut(rows[own], weight[own]) if weight[own].sum() > most else None
            if cut is None:
                node, self.leaves = -1 - self.leaves, self.leaves + 1
                means.append(rows[own].mean(axis=0) if len(own) else np.zeros(rows.shape[1]))
            else:
                node, (normal, bound, right) = len(self.normal), cut
                self.normal.append(normal)
                self.bound.append(bound)
                self.child.append([0, 0])
                todo += [(own[right], (node, 1)), (own[~right], (node, 0))]
            if parent:
                self.child[parent[0]][parent[1]] = node
        self.normal, self.bound, self.child = np.array(self.normal, np.float32), np.array(self.bound, np.float32), np.array(self.child, np.int64)
        self.means = np.array(means, np.float32)

    @staticmethod
    def _cut(rows: np.ndarray, weight: np.ndarray):
        mean = np.average(rows, axis=0, weights=weight)
        far = rows[((rows - mean) ** 2).sum(axis=1).argmax()]
        a, b = far, 2 * mean - far
        for _ in range(8):
            side = rows @ (b - a) > (b - a) @ (a + b) / 2
            if side.all() or not side.any():
                break
            a, b = np.average(rows[~side], axis=0, weights=weight[~side]), np.average(rows[side], axis=0, weights=weight[side])
        normal = (b - a).astype(np.float32)
        along = (rows @ normal).astype(np.float32)
        order = np.argsort(along, kind="stable")
        share = np.cumsum(weight[order]) / weight.sum()
        low, high = (along[order[min(np.searchsorted(share, x), len(order) - 1)]] for x in (0.25, 0.75))
        bound = np.float32(np.clip(normal @ (a + b) / 2, low, high))
        for right in (along > bound, along >= bound):
            if right.any() and not right.all():
                return normal, along[~right].max(), along > along[~right].max()
        return None

    def leaf(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64) if len(self.normal) else np.full(len(rows), -1)
        while len(at := np.flatnonzero(node >= 0)):
            here = node[at]
            node[at] = self.child[here, (np.einsum("ij,ij->i", rows[at], self.normal[here]) > self.bound[here]).astype(np.int64)]
        return -1 - node

    def shard(self, rows: np.ndarray, bits: int) -> np.ndarray:
        """The leaf of each row and the sides of `bits` hyperplanes through its mean; faint dimensions count for more, so that equal documents part."""
        leaf = self.leaf(rows)
        plane = np.random.default_rng(1).normal(size=(rows.shape[1], bits))
        plane[DIMENSIONS:] *= 16
        sides = ((rows - self.means[leaf]) @ plane > 0).astype(np.int64)
        return (leaf << bits) | (sides << np.arange(bits)).sum(axis=1)


def _vectors(path: str, whole):
    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            raw, at = column_bytes(batch.column(0))
            own = whole.value.beside(*_rest(batch.column(2))) if batch.num_columns > 2 else whole.value
            out = vectors(encoder, own, raw, at, np.asarray(batch.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in out.astype(np.float16)], pa.binary()), pa.array(np.diff(at) + ROW_BYTES)], ["vector", "bytes"])

    return run


def _placer(path: str, whole, tree, bits: int):
    def run(batches):
        encoder = Encoder(path)
        for batch in batches:
            raw, at = column_bytes(batch.column(1))
            rare = batch.columns[3:]
            own = whole.value.beside(*_rest(rare[0])) if rare else whole.value
            rows = vectors(encoder, own, raw, at, np.asarray(batch.column(2)))
            yield pa.RecordBatch.from_arrays([pa.array(tree.value.shard(rows, bits)), batch.column(0), batch.column(1), *rare], ["shard", "doc_id", "text", "rare"][: 3 + len(rare)])

    return run


def _packer(path: str, window: int, most: int, whole):
    def pack(encoder: Encoder, doc_ids: list, texts: list[bytes], rare: list, base: int):
        raw = np.frombuffer(b"".join(texts), np.uint8)
        at = np.cumsum([0, *map(len, texts)])
        parts, before, keys, terms = [], [0], [np.zeros(0, np.uint64)], [0]
        for _, _, ids, own, found, count in encoder.ids_and_keys(raw, at):
            full = np.insert(ids, own[1:], END_ID)
            parts.append(full)
            before += (before[-1] + own[1:] + np.arange(1, len(own))).tolist()
            keys.append(found)
            terms += (terms[-1] + count[1:]).tolist()
        ids, before = np.concatenate(parts), np.array(before)
        wide = ids.astype("<u4")
        own = whole.value.beside(*(np.concatenate(x) for x in zip(*rare, strict=True))) if rare else whole.value
        pieces = lay_out(Index(np.concatenate(keys), np.array(terms), own), before, window)
        doc, start, size, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces, strict=True))
        data = memoryview(wide.tobytes())
        low = (before[doc] + start) * 4
        crc = [zlib.crc32(data[a : a + 4 * k]) for a, k in zip(low.tolist(), size.tolist(), strict=True)]
        total = np.diff(before)[doc]
        ids_of = pa.array(doc_ids, pa.int64()).take(pa.array(doc))
        batch = pa.RecordBatch.from_arrays([ids_of, pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(total), pa.array(base + sequence), pa.array(offset)], NAMES)
        return batch, int(sequence.max()) + 1

    def run(batches):
        encoder, shard, count, doc_ids, texts, rare, size = shared_encoder(path), None, 0, [], [], [], 0
        for batch in batches:
            number = batch.column(0).to_pylist()
            raw, at = column_bytes(batch.column(2))
            data = raw.tobytes()
            for k, doc_id in enumerate(batch.column(1).to_pylist()):
                text = data[at[k] : at[k + 1]]
                if texts and (number[k] != shard or size + len(text) + ROW_BYTES > most):
                    out, used = pack(encoder, doc_ids, texts, rare, (shard << 32) + count)
                    yield out
                    count, doc_ids, texts, rare, size = count + used, [], [], [], 0
                if number[k] != shard:
                    shard, count = number[k], 0
                doc_ids.append(doc_id)
                texts.append(text)
                if batch.num_columns > 3:
                    rare.append(_rest(batch.column(3).slice(k, 1)))
                size += len(text) + ROW_BYTES
        if texts:
            yield pack(encoder, doc_ids, texts, rare, (shard << 32) + count)[0]

    return run


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> Encoder:
    """One for all tasks of a worker that pack, so that they learn common words once; it remembers as many as a task's own would."""
    return Encoder(path)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, path: str, window: int = WINDOW, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row per piece: where it lies in its document and in its sequence."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    found, size, rest = counted(own.select("text"), path)
    whole = docs.sparkSession.sparkContext.broadcast(found)
    keyed, total = own.withColumn("own", F.xxhash64("doc_id", "text")), size + ROW_BYTES * found.n
    rare, kind = [], ""
    if rest is not None:
        keyed = keyed.join(rare_words(keyed, path, whole, rest), "own", "left").select("doc_id", "text", "own", "rare")
        rare, kind = ["rare"], ", rare array<struct<term:bigint,df:int>>"
    if total <= shard_bytes:
        placed = keyed.select(F.lit(0).cast("long").alias("shard"), "doc_id", "text", *rare)
    else:
        # one row in `every`, by hash, so that every run takes the same
        share = max(shard_bytes, total // LEAVES)
        bits = max(0, (share // shard_bytes - 1).bit_length())
        every = max(1, found.n * share // (SAMPLE * total))
        with small_batches(docs.sparkSession):
            sample = keyed.where(F.pmod(F.xxhash64("own"), F.lit(every)) == 0).select("text", "own", *rare).mapInArrow(_vectors(path, whole), "vector binary, bytes long").orderBy("vector", "bytes").toArrow()
        rows = np.frombuffer(b"".join(sample.column("vector").to_pylist()), np.float16).reshape(-1, DIMENSIONS + FAINT).astype(np.float32)
        weight = sample.column("bytes").to_numpy().astype(np.float64)
        tree = docs.sparkSession.sparkContext.broadcast(Tree(rows, weight, share * weight.sum() / total))
        placed = keyed.mapInArrow(lean(_placer(path, whole, tree, bits)), f"shard long, doc_id long, text string{kind}")
    rows = placed.repartition(parts_of(size), "shard").sortWithinPartitions("shard", "doc_id", "text")
    with small_batches(docs.sparkSession):  # pieces are few bytes, so they are written at once, from batches of bounded size
        return cut_lineage(rows.mapInArrow(lean(_packer(path, window, 2 * shard_bytes, whole)), ", ".join(f"{c} long" for c in NAMES)))


def op7_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
