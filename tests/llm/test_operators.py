"""The ten operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from paperloom.llm import chat, cws, media, packing, quality, repeats, simhash, token_counts, warc, word_table
from paperloom.llm.bytebpe import Encoder, Spans, library, mixed
from paperloom.llm.common import column_bytes
from paperloom.llm.components import components

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, n_bytes string, k1 string, kept int, fp string, log_weight int, shard string"
TEXTS = [
    (1, "It's a test, isn't it?  We'll see\n\n 123 times."), (2, None), (3, ""), (4, "  \n\t "), (5, "x <|endoftext|> y"), (5, "x <|endoftext|> y"), (None, "no id at all"), (6, "Grün über 日本語 😀 é"), (7, "word " * 5000),
    (8, "word " * 5000), (9, "a"), (10, "It's a test, isn't it?  We'll see\n\n 123 times."),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "b", "k", 1, "f", 2, "s") for i, t in TEXTS], SCHEMA)


def key(v):
    return (v is None, v)


def tokens(text):
    return library(BPE).encode(text or "", add_special_tokens=False).ids


def test_split_as_the_library(spark):
    rng = random.Random(3)
    alphabet = [*"ab'sStTremvld  \n\t\r", "１", "３", "é", "日", "!", "?", ".", "\u0085", " ", "　", "ñ", "😀", "'s", "'re", "'ll", "  ", "\n\n", " '", "<|endoftext|>", "़", "ा"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["".join(chr(rng.choice([*range(1, 0xD800), *range(0xE000, 0x20000)])) for _ in range(20)) for _ in range(200)]
    encoder = Encoder(BPE)
    raw, at = column_bytes(pa.array(texts))
    got = [None] * len(texts)
    for a, b, ids, before in encoder.ids(raw, at):
        for k in range(a, b):
            got[k] = ids[before[k - a] : before[k - a + 1]].tolist()
    assert got == [tokens(t) for t in texts]
    assert encoder.counts(raw, at).tolist() == [len(x) for x in got]


def test_long_texts_come_in_parts(monkeypatch):
    from paperloom.llm import bytebpe

    monkeypatch.setattr(bytebpe, "BLOCK", 64)
    rng = random.Random(9)
    texts = ["".join(rng.choices(["ab", " c", "  ", "1", "'s", " é", ".", " word"], k=2000)), "x" * 5000, "a b"]
    encoder = Encoder(BPE)
    raw, at = column_bytes(pa.array(texts))
    assert encoder.counts(raw, at).tolist() == [len(tokens(t)) for t in texts]
    got = [ids[before[k - a] : before[k - a + 1]].tolist() for a, b, ids, before in encoder.ids(raw, at) for k in range(a, b)]
    assert got == [tokens(t) for t in texts]


def test_op4_long_texts_come_in_parts(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 300)
    rng = random.Random(8)
    raw = np.frombuffer("".join(rng.choices("abcd ", k=3000)).encode(), np.uint8)
    windows = []
    for _, _, start, own in repeats._blocks(np.array([0, 100, 2900, 3000])):
        _, _, low, high, _ = repeats.stretches(raw[start : start + own[-1]], own)
        windows += [start + w for a, b in zip(low, high, strict=True) for w in range(a, b + 1)]
    assert sorted(windows) == list(range(100, 2900 - 199))


def test_vocabulary_encodes_to_itself():
    encoder = Encoder(BPE)
    words = [w for w in encoder.bpe.vocabulary[:20_000:7] if w and w.decode("utf-8", "ignore").encode() == w]
    for w in words:
        assert encoder.bpe.merge(w) == [encoder.bpe.vocabulary.index(w)] or tokens(w.decode()) == encoder.bpe.merge(w)


def test_op6(docs):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BPE).collect()), key=lambda r: (key(r[0]), r[1:]))
    want = sorted(((i, len((t or "").encode()), len(tokens(t)), len(tokens(t)) > 1024) for i, t in TEXTS), key=lambda r: (key(r[0]), r[1:]))
    assert got == want
    assert token_counts.count_tokens(docs.where("doc_id > 99"), BPE).count() == 0


def twins(n, pairs):
    """Pairs of words that prefix polynomial hashes modulo 2^64 can't tell apart: a shared head, and Thue-Morse strings over two letters and with the letters swapped."""
    rng = random.Random(11)
    for _ in range(pairs):
        x, y = rng.sample("abcdefghijklmnopqrstuvwxyz", 2)
        bits = [k.bit_count() & 1 for k in range(n)]
        head = "".join(rng.choices("abcdefgh", k=8))
        yield head + "".join((x, y)[b] for b in bits)
        yield head + "".join((y, x)[b] for b in bits)


def test_different_words_are_never_equal(spark):
    rows = [(k, t) for k, t in enumerate([*twins(1024, 5), *twins(2048, 3), *twins(64, 20)] * 2)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = {i: tokens(t) for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table, BPE).collect()} == {i: len(x) for i, x in want.items()}
    for most in (1 << 18, 0):
        for r in word_table.encode_and_decode(table, BPE, most).collect():
            assert r.ids_sha256 == hashlib.sha256(np.array(want[r.doc_id], "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(rows[r.doc_id][1].encode()).hexdigest()
    for r in packing.pack(table, BPE).collect():
        own = np.array([*want[r.doc_id], packing.END_ID], "<u4")
        assert r.ids_crc32 == zlib.crc32(own[r.start : r.start + r.length].tobytes())


def test_words_of_one_key_stand_apart(monkeypatch):
    from paperloom.llm import bytebpe

    def one_key(spans, *args, own=bytebpe.Spans.__init__):
        own(spans, *args)
        spans.key = spans.key & np.uint64(3 << 60)

    monkeypatch.setattr(bytebpe.Spans, "__init__", one_key)
    rng = random.Random(4)
    texts = ["".join(rng.choices(["ab", " c", "  ", "1", " é", " word", "x" * 20, "x" * 19 + "y", " " + "z" * 40], k=60)) for _ in range(20)]
    encoder = Encoder(BPE)
    raw, at = column_bytes(pa.array(texts))
    got = [ids[before[k - a] : before[k - a + 1]].tolist() for a, b, ids, before in encoder.ids(raw, at) for k in range(a, b)]
    assert got == [tokens(t) for t in texts]


def test_broadcast_table_is_bounded(spark):
    words = spark.createDataFrame([(f"w{k}".encode(), 20_000 + k % 3) for k in range(50)] + [(b"x", 5), (b"y", 5), (b"z", 4)], "word binary, n long")
    for most in (0, 10, 50, 51, 52, 60):
        assert token_counts.most_frequent(words, most).count() == (0 if most < 50 else 50 if most < 52 else min(most, 53))


@pytest.mark.parametrize("most", [1 << 19, 5, 0])
def test_op3(docs, most):
    def want(t):
        ids = tokens(t)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library(BPE).decode(ids, skip_special_tokens=False).encode()).hexdigest()

    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in word_table.encode_and_decode(docs, BPE, most).collect()), key=lambda r: (key(r[0]), r[1:]))
    assert got == sorted(((i, *want(t)) for i, t in TEXTS), key=lambda r: (key(r[0]), r[1:]))
    assert word_table.encode_and_decode(docs.where("doc_id > 99"), BPE, most).count() == 0


@pytest.mark.parametrize("shard", [60, 1 << 20])
def test_op7(docs, shard):
    rows = packing.pack(docs.where("doc_id is not null"), BPE, window=64, shard_bytes=shard).toPandas()
    texts = [(i, t) for i, t in TEXTS if i is not None]
    assert rows.length.sum() == sum(len(tokens(t)) + 1 for _, t in texts)
    for i, t in texts:
        ids = np.array([*tokens(t), packing.END_ID], "<u4")
        own = rows[rows.doc_id == i]
        copies = sum(j == i for j, _ in texts)
        assert (own.doc_tokens == len(ids)).all() and own.length.sum() == copies * len(ids)
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert (s.offset.values == s.length.cumsum().shift(fill_value=0).values).all()
        used = s.length.sum()
        assert used == 64 or used & (used - 1) == 0
    assert packing.pack(docs.where("doc_id > 99"), BPE).count() == 0


def test_op7_neighbours_are_alike():
    rng = random.Random(1)
    topics = [[f" {'abcdef'[k] * 3}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(40)] for k in range(6)]
    texts = [("".join(rng.choices(topics[k % 6], k=50))).encode() for k in range(60)]
    encoder = Encoder(BPE)
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    ids, before = next((i, b) for _, _, i, b in encoder.ids(raw, at))
    order = list(dict.fromkeys(p[0] for p in packing.lay_out(packing.Index(*packing.words(encoder, raw, at)), before, 1 << 12)))
    same = sum(a % 6 == b % 6 for a, b in zip(order, order[1:], strict=False))
    assert same > 40


def test_op7_neighbours_meet_across_the_table(spark):
    rng = random.Random(5)
    topics = [[f" {chr(97 + k) * 3}{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(40)] for k in range(12)]
    texts = [(k, "".join(rng.choices(topics[k % 12], k=60))) for k in range(600)]
    size = sum(len(t) for _, t in texts)
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), BPE, window=512, shard_bytes=size // 12).toPandas()
    assert rows.length.sum() == sum(len(tokens(t)) + 1 for _, t in texts)
    assert rows.sequence_id.map(lambda s: s >> 32).nunique() >= 12
    pairs = same = 0
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        ids = s.doc_id.tolist()
        pairs, same = pairs + len(ids) - 1, same + sum(a % 12 == b % 12 for a, b in zip(ids, ids[1:], strict=False))
    assert same > 0.9 * pairs


@pytest.mark.parametrize("equal", [False, True])
def test_op7_tree_stays_small(spark, monkeypatch, equal):
    monkeypatch.setattr(packing, "LEAVES", 2)
    built = []
    own = packing.Tree.__init__
    monkeypatch.setattr(packing.Tree, "__init__", lambda self, rows, weight, most: own(self, rows, weight, most) or built.append((len(rows), self)))
    rng = random.Random(6)
    texts = [(k, "same words in every text " * 8 if equal else " ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=60))) for k in range(900)]
    rows = packing.pack(spark.createDataFrame([*texts, (None, None)], "doc_id long, text string").repartition(3), BPE, window=128, shard_bytes=8192).toPandas()
    assert rows.length.sum() == sum(len(tokens(t)) + 1 for _, t in texts) + 1
    sampled, tree = built[0]
    assert sampled < 300 and tree.leaves <= 4
    sizes = rows.groupby(rows.sequence_id // (1 << 32)).length.sum()
    assert len(sizes) > 15 and sizes.max() < 0.3 * sizes.sum()  # the planes part each leaf further, equal texts too


def test_op7_layout_against_greedy_by_hand():
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(12)], k=rng.randint(1, 14))).encode() for _ in range(25)]
    encoder = Encoder(BPE)
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    index = packing.Index(*packing.words(encoder, raw, at))
    sizes = [len(tokens(t.decode())) + 1 for t in texts]
    before, window = np.cumsum([0, *sizes]), 1 << 20
    pieces = packing.lay_out(index, before, window)
    left, seed, order = set(range(len(texts))), 0, [0]
    left.discard(0)
    score = index.scores(0, len(texts))
    while left:
        best = max(left, key=lambda d: (score[d], -d))
        if score[best] <= 0:  # no neighbour is left: the next unused document seeds
            seed = best = min(left)
            score = index.scores(seed, len(texts))
        left.discard(best)
        order.append(best)
    assert list(dict.fromkeys(p[0] for p in pieces)) == order


def test_op7_statistics_cover_the_table(spark):
    texts = ["a b a", " b c", None, "", "a b", " c  c"]
    found, size = packing.statistics(spark.createDataFrame([(t or "",) for t in texts], "text string").repartition(3), BPE)
    encoder = Encoder(BPE)
    raw, at = column_bytes(pa.array([t or "" for t in texts]))
    hashes, before = packing.words(encoder, raw, at)
    own = [set(hashes[a:b].tolist()) for a, b in zip(before, before[1:], strict=False)]
    count = Counter(w for s in own for w in s)
    assert (found.n, found.mean, size) == (len(texts), len(hashes) / len(texts), len(raw))
    assert dict(zip(found.terms.tolist(), found.df.tolist(), strict=True)) == {w: n for w, n in count.items() if n > 1}
    index = packing.Index(hashes[: before[2]], before[:3], found)
    alone = packing.Index(hashes[: before[2]], before[:3])
    assert (index.scores(0, 2) > alone.scores(0, 2)).all()


def test_op7_query_takes_all_words():
    encoder, rng = Encoder(BPE), random.Random(2)
    texts = ["".join(f" {chr(97 + j % 26)}{chr(97 + j // 26)}q" for j in rng.sample(range(200), 60)) for _ in range(40)]
    raw, at = column_bytes(pa.array(texts))
    index = packing.Index(*packing.words(encoder, raw, at))
    own = [t.split() for t in texts]
    df, mean = Counter(w for t in own for w in set(t)), sum(map(len, own)) / len(own)
    got = index.scores(0, len(texts))
    for k, t in enumerate(own):
        want = sum(np.log1p((40 - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / mean)) for w in set(own[0]) & set(t) if df[w] > 1)
        assert abs(got[k] - want) < 1e-3


def components_by_hand(prints, distance):
    ids = sorted(prints, key=key)
    parent = {i: i for i in range(len(ids))}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[ids[i]] ^ prints[ids[j]]).bit_count() <= distance:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {d: ids[find(i)] for i, d in enumerate(ids)}


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_op5(spark, docs):
    rng = random.Random(7)
    base = [" ".join(rng.choices("abcdefghij", k=1)[0] * rng.randint(1, 4) + str(rng.randint(0, 40)) for _ in range(120)) for _ in range(12)]
    rows = [(100 + k, base[k % 12] if k < 12 else re.sub(r"\S+$", f"end{k}", base[k % 12])) for k in range(60)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    prints = {i: fingerprint_by_hand(t) for i, t in [*TEXTS, *rows] if i is not None}
    want = components_by_hand(prints, 4)
    for most in (simhash.GROUP, 3):
        for r in simhash.near_duplicates(both.where("doc_id is not null"), most=most).collect():
            assert r.fp & (1 << 64) - 1 == prints[r.doc_id]
            assert r.component_id == want[r.doc_id]
    assert simhash.near_duplicates(docs).count() == len(TEXTS)
    assert simhash.near_duplicates(docs.where("doc_id > 99")).count() == 0


def test_op5_refuses_what_its_keys_miss(docs):
    with pytest.raises(ValueError, match="4 differing bits"):
        simhash.near_duplicates(docs, simhash.DISTANCE + 1)


def test_op5_golay_keys_miss_no_pair():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 2000, dtype=np.uint64)
    b = a.copy()
    for i in range(2000):
        for k in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)
    one, two = (set(zip(*(x.tolist() for x in simhash.keys(v.view(np.int64))), strict=True)) for v in (a, b))
    assert {r for r, _ in one & two} == set(range(2000))


def test_components_of_long_chains(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (3, 4)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def repeats_by_hand(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = True
        starts = np.diff(np.concatenate([[0], gone.view(np.int8)])) == 1
        yield len(b), int(gone.sum()), int(starts.sum()), bytes(np.frombuffer(b, np.uint8)[~gone])


@pytest.mark.parametrize("most", [repeats.GROUP, 10, 1])
def test_op4(spark, docs, most):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    para = lambda n: " ".join(rng.choices(words, k=n))
    shared, texts = [para(60) for _ in range(6)], []
    for _ in range(150):
        r = rng.random()
        if r < 0.5:
            t = para(20) + rng.choice(shared) + para(30)
        elif r < 0.6:
            k = rng.randint(0, 150)
            t = para(3) + rng.choice(shared)[k : k + rng.randint(190, 260)] + para(3)
        elif r < 0.7:
            t = "ab" * rng.randint(80, 300)
        elif r < 0.8:
            t = rng.choice(shared) * 2
        else:
            t = list(rng.choice(texts)) if texts else list("x")
            for _ in range(rng.randint(0, 3)):
                t[rng.randrange(len(t))] = "Z"
            t = "".join(t)
        texts.append(t)
    rows = [*TEXTS, *((1000 + k, t) for k, t in enumerate(texts))]
    table = spark.createDataFrame([(i, t, "b", "k", 1) for i, t in rows], "doc_id long, text string, n_bytes string, k1 string, kept int")
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(table, most).collect()), key=lambda r: (key(r[0]), r[1:]))
    assert got == sorted(((i, *x) for (i, _), x in zip(rows, repeats_by_hand([t for _, t in rows]), strict=True)), key=lambda r: (key(r[0]), r[1:]))
    assert repeats.remove_repeats(docs.where("doc_id > 99")).count() == 0


def test_op4_suffixes_are_sorted():
    rng = random.Random(2)
    raw = np.frombuffer("".join(rng.choices("ab", k=600)).encode(), np.uint8)
    start = np.arange(0, 500, 3)
    group = np.sort(np.array([rng.randint(0, 3) for _ in start]))
    s = repeats.Suffixes(raw, start, np.full(len(start), 90), group)
    text = [(group[i], raw[start[i] : start[i] + 90].tobytes()) for i in s.order]
    assert text == sorted(text)


def jaccard(a, b):
    a, b = Counter(a.split()), Counter(b.split())
    words = set(a) | set(b)
    return sum(min(a[w], b[w]) for w in words) / max(1, sum(max(a[w], b[w]) for w in words))


def signature_by_hand(text, samples=cws.SAMPLES):
    """Consistent weighted sampling one word and one draw at a time, by the formula of the module's docstring."""
    sampler = cws.Sampler(samples)
    counts = Counter(w for w in re.split("[ \t\n\v\f\r]+", text) if w)
    out = [0] * samples
    best = [np.inf] * samples
    for w, n in counts.items():
        word = w.encode()
        key = Spans(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)])).key
        r, b, ln_c = sampler.draws(key)[0]
        for k in range(samples):
            level = np.floor(np.log(np.float32(n)) / r[k] + b[k])
            ln_a = ln_c[k] - r[k] * (level - b[k]) - r[k]
            if ln_a < best[k]:
                best[k] = ln_a
                pair = (int(key[0]) + int(level) * 0xD6E8FEB86659FD93) % 2**64
                out[k] = int(mixed(np.array([pair], np.uint64))[0] >> np.uint64(48))
    return np.array(out, np.uint16)


@pytest.mark.parametrize("rows", [1, 3, 2000])
def test_op2(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(cws, "in_ranges", lambda d, f=cws.in_ranges: f(d, rows))
    own = docs.unionByName(docs.where("doc_id is null").withColumn("text", F.lit("another without id, word word word")))
    texts = [(r.doc_id, r.text or "", r.h) for r in own.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()]
    texts.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[1]))
    want = []
    for (i, t, _), (_, after, _) in zip(texts, [*texts[1:], texts[0]], strict=True):
        change = cws.edited(t, after)
        a, e, n = (signature_by_hand(x) for x in (t, change, after))
        want.append((i, len(t), hashlib.sha256(change.encode()).hexdigest(), a.tobytes().hex(), e.tobytes().hex(), float((a == e).mean()), float((a == n).mean())))
    got = [tuple(r) for r in cws.compare_with_edits(own).collect()]
    order = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(want, key=order)
    assert cws.compare_with_edits(docs.where("doc_id > 99")).count() == 0


def test_op2_estimates_generalised_jaccard():
    rng = random.Random(4)
    words = [f"w{k}" for k in range(200)]
    sampler, errors = cws.Sampler(256), []
    for _ in range(60):
        a = rng.choices(words, k=150)
        b = a[: rng.randint(0, 150)] + rng.choices(words, k=80)
        one, two = sampler.signatures([" ".join(a).encode(), " ".join(b).encode()])
        errors.append(cws.likeness(one, two) - jaccard(" ".join(a), " ".join(b)))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_op8(docs):
    rows = media.png_features(media.to_png(docs, "text")).collect()
    texts = Counter((i, (t or "").encode()) for i, t in TEXTS)
    assert len(rows) == len(TEXTS)
    for r in rows:
        own = [b for i, b in texts if i == r.doc_id]
        pads = [b + b"\0" * (-len(b) % 64 or (0 if b else 64)) for b in own]
        assert (r.payload_sha256, r.payload_bytes, r.tail_crc32) in {(hashlib.sha256(p).hexdigest(), len(p), zlib.crc32(p[-64:])) for p in pads}
    assert media.png_features(media.to_png(docs.where("doc_id > 99"), "text")).count() == 0


def test_op8_png_filters_and_damage():
    rng = np.random.default_rng(1)
    smooth = (np.add.outer(np.arange(40), np.arange(50)) * 2 % 256).astype(np.uint8)
    for image in (smooth, rng.integers(0, 256, (7, 9), dtype=np.uint8), np.zeros((1, 64), np.uint8)):
        assert (media.decode_png(media.encode_png(image)) == image).all()
    rows = np.zeros((5, 11), np.uint8)
    rows[:, 0], rows[:, 1:] = [4, 3, 2, 1, 4], rng.integers(0, 256, (5, 10))
    got = media._unfilter(rows)
    want = np.zeros((5, 10), int)
    for y in range(5):
        for x in range(10):
            a, b = (want[y, x - 1] if x else 0), (want[y - 1, x] if y else 0)
            c = want[y - 1, x - 1] if x and y else 0
            p = min((a, b, c), key=lambda v: (abs(a + b - c - v)))
            want[y, x] = (int(rows[y, x + 1]) + [0, a, b, (a + b) // 2, p][rows[y, 0]]) & 255
    assert (got == want).all()
    data = bytearray(media.encode_png(smooth))
    data[60] ^= 1
    with pytest.raises(ValueError):
        media.decode_png(bytes(data))
    picture = np.kron(rng.integers(0, 256, (8, 8), dtype=np.uint8), np.ones((8, 8), np.uint8))
    near, other = picture.copy(), np.kron(rng.integers(0, 256, (8, 8), dtype=np.uint8), np.ones((8, 8), np.uint8))
    near[3, 4] ^= 3
    assert (media.cosine_hash(picture) ^ media.cosine_hash(near)).bit_count() <= 4 < 12 < (media.cosine_hash(picture) ^ media.cosine_hash(other)).bit_count()


def test_op10(spark, tmp_path):
    rows = [(1, "u", "x", 1), (2, "u", "x", 1), (3, "u", None, 1), (4, "u", "", 1), (5, None, "é\r\n\r\nWARC/1.1\r\n", 1), (5, None, "é\r\n\r\nWARC/1.1\r\n", 1), (None, "u", "x", 1), (6, "a\r\nb", "z" * 100_000, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 int")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect())
    kinds = {1: ("revisit", 2), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None), 5: ("response", None), None: ("revisit", 2), 6: ("response", None)}
    assert got == Counter((i, len((h or "").encode()), warc.base32_sha1((h or "").encode()), *kinds[i]) for i, _, h, _ in rows)
    big = spark.range(24).selectExpr("id as page_id", "concat('http://x/', id) as url", "repeat(cast(id div 2 as string), 3000000) as html")
    warc.write_archives(big, f"file://{tmp_path}/big")
    got = {r.page_id: (r.payload_bytes, r.refers_to) for r in warc.read_archives(spark, f"file://{tmp_path}/big").collect()}
    assert got == {k: (3_000_000 * len(str(k // 2)), k + 1 if k % 2 == 0 else None) for k in range(24)}
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "big").glob("*.gz"))
    kept = [f for f, _ in warc.parse_records(raw)]
    assert {f["WARC-Refers-To"] for f in kept if f["WARC-Type"] == "revisit"} <= {f["WARC-Record-ID"] for f in kept if f["WARC-Type"] == "response"}
    assert len({f["WARC-Record-ID"] for f in kept}) == 24
    packed = spark.createDataFrame([(k,) for k in range(160)], "page_id long").coalesce(1).selectExpr("page_id", "'u' as url", "repeat(concat('page ', page_id, ' '), 110000) as html")
    packed.write.parquet(f"file://{tmp_path}/packed")
    warc.write_archives(spark.read.parquet(f"file://{tmp_path}/packed"), f"file://{tmp_path}/even")
    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "even").glob("*.gz")]
    assert sum(sizes) > 140_000_000 and max(sizes) < 64 << 20  # files follow the bytes, however well they are compressed
    (tmp_path / "cut").mkdir()
    only = [warc.parse_records(gzip.decompress(f.read_bytes())) for f in (tmp_path / "big").glob("*.gz")]
    revisit = next(f for each in only for f, _ in each if f["WARC-Type"] == "revisit")
    record = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in revisit.items() if k != "Content-Length") + "Content-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "cut" / "part.gz").write_bytes(gzip.compress(record.encode()))
    with pytest.raises(Exception, match="no response"):
        warc.read_archives(spark, f"file://{tmp_path}/cut").collect()
    warc.write_archives(pages, f"file://{tmp_path}/least", least=2)
    assert {r.page_id: r.record_type for r in warc.read_archives(spark, f"file://{tmp_path}/least").collect()}[1] == "response"
    warc.write_archives(pages.where("page_id > 99"), f"file://{tmp_path}/none")
    assert warc.read_archives(spark, f"file://{tmp_path}/none").count() == 0


def test_op1(spark):
    rows = [(1, 0, "system", None, 1), (1, 1, "user", r"a <s>\< \\", 1), (1, 2, "assistant", "</s>[INST] ok [/INST]", 1), (1, 3, "user", "more", 1), (1, 4, "assistant", "", 1), (1, 5, "user", "tail", 1), (2, None, "assistant", "x", 1), (2, None, "assistant", "x", 1), (None, 0, None, "n", 1), (3, 0, "user", "only", 1)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    examples = chat.expand(table).collect()
    texts = [r for r in examples if r.conv_id == 1 and r.example_no is not None]
    assert len(texts) == 2 and texts[0].formatted.startswith("<s>system<r></s>")
    got = {r.conv_id: r for r in chat.summary(chat.expand(table)).collect()}
    for conv in (1, 2, None, 3):
        turns = sorted(((t, r or "", x or "") for c, t, r, x, _ in rows if c == conv), key=lambda v: (v[0] is not None, v))
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.summary(chat.expand(table.where("conv_id > 9"))).count() == 0
    plan = chat.summary(chat.expand(table))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_op9(spark):
    rng = random.Random(6)
    good = [f"w{k}" for k in range(80)]
    rows, labels = [], []
    for k in range(600):
        words, kind = rng.choices(good, k=rng.randint(40, 80)), k % 5
        if kind == 3:
            words = [w.upper() + "!!" for w in words]
        if kind == 4:
            for bad in ("villain", "scum", "fool"):
                words.insert(rng.randrange(len(words)), bad)
        rows.append((k, " ".join(words), kind, 1.0))
        if k % 2:
            labels.append((k, int(kind != 3), int(kind == 4)))
    docs = spark.createDataFrame([*rows, (None, None, 0, 1.0), (1000, "", 0, 1.0), (5, rows[5][1], 0, 1.0)], "doc_id long, text string, kind int, log_weight double")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = Counter(r.kind for r in quality.resample(docs, table).where("doc_id < 600").select("doc_id", "kind").distinct().collect())
    assert all(kept[k] >= 112 for k in (0, 1, 2)) and kept[3] <= 8 and kept[4] <= 15
    assert quality.resample(docs, table.where("doc_id < 0")).count() == 603
    assert quality.resample(docs.where("doc_id > 9999"), table).count() == 0

    # both models by hand: presences by the words' own names, as no two of them share a bucket here, words and pairs by their buckets
    def buckets(text):
        found = quality.ngrams(*column_bytes(pa.array([text or ""])))
        return [found[k][1].tolist() for k in ("word", "pair")]

    target, raw = [], []
    good = {i for i, q, x in labels if q and not x}
    for r in docs.collect():
        words = re.findall(r"[A-Za-z0-9]+|[^A-Za-z0-9\s]+", r.text or "")
        raw.append((r, words, buckets(r.text)))
        assert [len(b) for b in raw[-1][2]] == [len(words), max(0, len(words) - 1)]
        target += [raw[-1]] if r.doc_id in good else []
    has = [Counter(w for x in side for w in set(x)) for side in ([w for _, w, _ in raw], [w for _, w, _ in target])]
    grams = [[Counter(g for _, _, b in side for g in b[k]) for k in (0, 1)] for side in (raw, target)]

    def log_weight(words, own_buckets):
        out = 0
        for w in set(words):
            expected, found = has[0][w] * len(target) / len(raw), has[1][w]
            out += np.log((found + 1) / (expected + 1)) if abs(expected - found) > 4 * np.sqrt(expected + 0.5) else 0
        both = 0
        for k, own in enumerate(own_buckets):
            share = sum(grams[1][k].values()) / sum(grams[0][k].values())
            both += sum(np.log((grams[1][k][g] + 1) / (grams[0][k][g] * share + 1)) for g in own)
        return both, out

    model, share = quality.fit(docs, table)
    assert share == len(target) / (len(labels) + 1)  # one labelled row is there twice
    rows = quality.weighted(docs, model).collect()
    want = {(r.doc_id, r.text): log_weight(w, b) for r, w, b in raw}
    off = [abs(r.log_weight - want[r.doc_id, r.text][0]) for r in rows]
    assert max(off) < 1e-3
    assert all(abs(r.log_presence - want[r.doc_id, r.text][1]) < 1e-3 and r.supported == (want[r.doc_id, r.text][1] >= quality.OUTSIDE) for r in rows)
    assert {r.supported for r in rows} == {True, False}
    for k in (0, 1, 200, 480, 550, 603):
        keys = sorted(((r.supported, r.sample_key) for r in rows), reverse=True)
        got = Counter((r.doc_id, r.text) for r in quality.resample(docs, table, k).collect())
        assert got == Counter((r.doc_id, r.text) for r in rows if k and (r.supported, r.sample_key) >= keys[k - 1])
    noise = np.array([r.sample_key - r.log_weight for r in rows])
    assert abs(noise.mean() - 0.5772) < 0.2 and 1.0 < noise.std() < 1.6
    top = {(r.doc_id, r.text) for r in sorted((r for r in rows if r.supported), key=lambda r: -r.log_weight)[:200]}
    shared = [len(top & {(r.doc_id, r.text) for r in quality.resample(docs, table, 200, temperature=t).collect()}) for t in (0.0, 1.0, 1000.0)]
    assert shared[0] >= 199 and shared[0] > shared[2] and shared[1] > shared[2]


def test_kth_largest(spark):
    values = [1.0] * 50 + [2.0] * 30 + [k / 7 for k in range(100)]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 10, 30, 60, 120, 180):
        assert quality.kth_largest(rows, "x", k) == sorted(values, reverse=True)[k - 1]


def test_settings_stay_as_they_were(spark, tmp_path):
    before = dict(spark.sparkContext._jvm.scala.jdk.CollectionConverters.MapHasAsJava(spark._jsparkSession.conf().getAll()).asJava())
    from paperloom.llm import entry

    for query in entry.QUERIES.values():
        query(spark, "/root/testdata/sf0.001").count()
    after = dict(spark.sparkContext._jvm.scala.jdk.CollectionConverters.MapHasAsJava(spark._jsparkSession.conf().getAll()).asJava())
    assert after == before


def test_pipeline(spark):
    import corpus_pipeline

    directory = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{directory}/documents.parquet").withColumns({"kept_id": F.lit(1), "kept": F.lit("x"), "n_bytes": F.lit(2)})
    columns, before = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, directory).persist()
        assert after.columns == columns, name
        assert after.select("doc_id").exceptAll(before.select("doc_id")).count() == 0
        before = after
    texts = {r.doc_id: r.text for r in before.collect()}
    pieces = corpus_pipeline.STAGES[-1][1](spark, before, directory).toPandas()
    assert set(pieces.doc_id) == set(texts)
    assert pieces.length.sum() == sum(len(tokens(t)) + 1 for t in texts.values())


def test_pipeline_keeps_one_row_of_each_component(spark):
    import corpus_pipeline

    rng = random.Random(9)
    own = [" ".join(f"w{rng.randint(0, 9999)}" for _ in range(80)) for _ in range(8)]
    prints = [fingerprint_by_hand(t) for t in own]
    assert min((a ^ b).bit_count() for k, a in enumerate(prints) for b in prints[:k]) > simhash.DISTANCE
    rows = [(None, own[0]), (None, own[1]), (None, own[1].upper()), (None, own[2]), (7, own[2]), (5, own[3]), (5, own[4]), (3, own[4]), (5, None), (9, own[5]), (9, own[5]), (9, own[6]), (8, own[6]), (None, "")]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "")
    got = Counter((i, (t or "").lower()) for i, t in kept.collect())
    assert got == Counter([(None, own[0]), (None, own[1]), (7, own[2]), (5, own[3]), (3, own[4]), (5, ""), (9, own[5]), (8, own[6])])


def test_cosine_hash_by_hand():
    rng = np.random.default_rng(4)
    for shape in ((64, 64), (96, 64), (32, 64)):
        image = rng.integers(0, 256, shape, dtype=np.uint8)
        high, wide = shape[0] // 32, shape[1] // 32
        small = [[float(image[y * high : (y + 1) * high, x * wide : (x + 1) * wide].astype(float).mean()) for x in range(32)] for y in range(32)]
        wave = lambda k, n: np.cos(np.pi * (2 * n + 1) * k / 64)
        low = np.array([[sum(small[y][x] * wave(v, y) * wave(u, x) for y in range(32) for x in range(32)) for u in range(8)] for v in range(8)])
        own = int(media.cosine_hash(image))
        bits = [own >> (63 - k) & 1 for k in range(64)]
        rest = low.ravel().copy()
        above = [bits[k] for k in np.argsort(rest)]
        # the bits part the coefficients into low ones and high ones, by their median
        assert sum(a > b for a, b in zip(above, above[1:], strict=False)) <= 1 and 28 <= sum(bits) <= 36


def test_op7_rare_words_keep_their_frequencies(spark, monkeypatch):
    """Words that the tasks' table has no place for are joined to the documents that have them."""
    rng = random.Random(5)
    texts = [(k, " ".join(f"w{int(rng.paretovariate(0.7)) % 900}x" for _ in range(rng.randint(0, 80)))) for k in range(150)] + [(None, None), (7, "w1x w2x"), (7, "w1x w2x")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    for shard in (4096, 1 << 20):
        monkeypatch.setattr(packing, "TABLE_WORDS", 1 << 22)
        want = sorted(map(str, packing.pack(docs, BPE, window=64, shard_bytes=shard).collect()))
        monkeypatch.setattr(packing, "TABLE_WORDS", 20)
        found, _, rest = packing.counted(docs.select(F.coalesce("text", F.lit("")).alias("text")), BPE)
        assert len(found.terms) == 20 and rest.count() > 100
        assert sorted(map(str, packing.pack(docs, BPE, window=64, shard_bytes=shard).collect())) == want
