"""Language network, annulus search and streaming CRC ring against brute force, and their defined cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import annulus, language, ngram_importance
from paperloom.llm.language import Network

SF = "/root/testdata/sf0.001"
LONG = ("the quick brown fox jumps over the lazy dog " * 80_000) + "end"
TEXTS = [
    (1, "The cat sat on the mat, and the dog sat by it. A2 über Straße naïve " * 3), (2, None), (3, ""), (4, " \n\t--!!"), (5, "one two"), (6, "Solo"), (7, LONG), (8, "same words " * 15), (8, "same words " * 15), (9, "same words " * 15),
    (None, "no id here but many words " * 5), (None, None), (10, "日本語 と ÉCOLE école 1234 x" * 9),
]
SCHEMA = "doc_id long, text string, rank string, weight int, cluster int, score string, feature_buckets string, shade string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "r", 1, 2, "s", "b", f"x{k}") for k, (i, t) in enumerate(TEXTS)], SCHEMA)


def features(text: str | None, runs: int) -> tuple[int, list[str]]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)
    return len(words), [" ".join(words[k : k + n]) for n in range(1, runs + 1) for k in range(len(words) - n + 1)]


def expected_importance(rows, targets, runs, buckets, least, percent, seed):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    own = [features(t, runs) for _, t in rows]
    raw, target = Counter(of(f) for _, fs in own for f in fs), Counter(of(f) for t in targets for f in features(t, runs)[1])
    total, wanted = sum(raw.values()), sum(target.values())
    gain = [math.floor(1000 * math.log((target[b] + 1) * (total + buckets) / ((raw[b] + 1) * (wanted + buckets)))) for b in range(buckets)]
    out = []
    for (i, _), (n, fs) in zip(rows, own, strict=True):
        weight = sum(gain[of(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return Counter(map(tuple, out))


@pytest.mark.parametrize(("runs", "buckets", "percent"), [(2, 10_000, 25), (1, 7, 100), (4, 70_000, 60)])
def test_importance_as_brute_force(spark, docs, runs, buckets, percent):
    targets = ["the cat sat on a mat", None, "", "über alles école"]
    got = ngram_importance.resample(docs, spark.createDataFrame([(t,) for t in targets], "text string"), runs=runs, buckets=buckets, percent=percent, least=2)
    assert got.columns == ["doc_id", "cluster", "shade", "n_words", "n_features", "weight", "score", "rank"]
    rows = Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect())
    want = expected_importance(TEXTS, targets, runs, buckets, 2, percent, 7)
    assert rows == want
    assert got.where("shade = 'x6'").first().n_words == 720_001


def test_importance_of_whole_tables(spark):
    got = ngram_importance.op13_target_importance(spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    targets = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = Counter((i, n, w, s, r) for i, _, n, w, s, r in expected_importance(rows, targets, 2, 10_000, 20, 25, 7).elements())
    assert Counter(tuple(r) for r in got.collect()) == want


def test_importance_of_nothing(spark, docs):
    none = docs.limit(0)
    assert ngram_importance.resample(none, docs).count() == 0
    assert ngram_importance.resample(docs, none, least=10**6).where("rank is not null").count() == 0


def test_blocks_hold_whole_words(monkeypatch):
    text = "Aa bb, ccé dd-ee " .encode() * 50
    whole = ngram_importance.scan(text, 3, 1000)
    monkeypatch.setattr(ngram_importance, "BLOCK", 5)
    parts = ngram_importance.scan(text, 3, 1000)
    assert b"".join(ngram_importance.blocks(text)) == text and whole[0] == parts[0] and (whole[1] == parts[1]).all()


def brute_clusters(rows, k, rounds, seed, scale):
    kept = [(i, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and len(v) == 3 and all(c is not None and math.isfinite(c) for c in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [list(v) for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for n, vs in groups.items():
            centroids[n] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = [(i, *reversed(near(v))) for i, v in kept]
    inertia = Counter()
    for _, c, d in found:
        inertia[c] += d
    return Counter((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for i, c, d in found)


@pytest.mark.parametrize(("k", "rounds"), [(8, 10), (40, 3), (1, 2)])
def test_clusters_as_brute_force(spark, k, rounds):
    rng = random.Random(k)
    rows = [(n, [rng.choice([-1.5, -1.0, 0.0, 0.25, 1.0]) * rng.choice([1, 1, 40]) for _ in range(3)]) for n in range(120)] + [(n, [1.0, 1.0, 1.0]) for n in range(200, 260)]
    rows += [(300, None), (301, [1.0]), (302, [1.0, None, 2.0]), (303, [1.0, float("nan"), 2.0]), (304, [1.0, float("inf"), 2.0]), (5, [9.0, 9.0, 9.0]), (5, [9.0, 9.0, 9.0]), (None, [0.1, 0.2, 0.3]), (306, [])]
    df = spark.createDataFrame([(i, v, "d", 7) for i, v in rows], "vec_id long, embedding array<float>, distance string, label int").repartition(5)
    got = annulus.cluster(df, dimensions=3, k=k, rounds=rounds)
    assert got.columns[:2] == ["vec_id", "label"]
    assert Counter((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got.collect()) == brute_clusters(rows, k, rounds, 3, 1024)


def test_annulus_holds_boundary_ties_and_leaves_others_out():
    rng = np.random.default_rng(1)
    centroids = np.array([[3, 4], [4, 3], [-5, 0], [0, 5], [50, 0], [400, 300]], np.int64)
    x = rng.integers(-450, 450, (4000, 2))
    x[:4] = [[0, 0], [7, 7], [5, 0], [-1, -1]]
    search = annulus.Annulus(centroids)
    distance = ((x[:, None] - centroids) ** 2).sum(axis=2)
    cluster, least = search.nearest(x)
    assert (cluster == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()
    low, high = search.annulus(x)
    assert (high - low).mean() < 0.8 * len(centroids)


def test_clusters_of_nothing_few_and_too_large(spark):
    schema = "vec_id long, embedding array<float>"
    none = annulus.cluster(spark.createDataFrame([], schema), dimensions=3)
    assert none.count() == 0 and none.columns == ["vec_id", *annulus.RESULTS]
    few = annulus.cluster(spark.createDataFrame([(1, [0.0, 1.0, 2.0]), (2, [5.0, 1.0, 2.0])], schema), dimensions=3)
    assert few.select("distance").distinct().collect()[0][0] == 0 and few.select("cluster").distinct().count() == 2
    with pytest.raises(Exception, match="over"):
        annulus.cluster(spark.createDataFrame([(1, [1e30, 1.0, 2.0])], schema), dimensions=3)


WORDS = {"aa": ["kala", "mana", "tala", "nama"], "bb": ["přes", "žluť", "kůň", "ďábel"], "cc": ["тихий", "вечер", "дом", "река"]}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows = [(n, " ".join(rng.choices(WORDS[lang], k=rng.randint(1, 60))), lang, "z", 5) for n in range(600) for lang in [rng.choice([*WORDS])]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, extra int")


def test_language_on_held_out_rows(spark, labelled):
    network = language.train(labelled.where(language.remainder() != 2), epochs=6)
    assert network.languages == [*WORDS]
    got = language.predict(labelled.where(language.remainder() == 2), network).collect()
    assert len(got) > 100 and sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got) and got[0].asDict().keys() == {"doc_id", "lang", "extra", "lang_pred", "score"}
    long = spark.createDataFrame([(1, "дом река " * 200_000), (1, "дом река " * 200_000), (2, None), (3, ""), (4, "123 !?"), (None, "kala mana tala"), (5, "ž")], "doc_id long, text string")
    found = [(r.doc_id, r.lang_pred, r.score > 0) for r in language.predict(long, network).collect()]
    assert found[:2] == [(1, "cc", True)] * 2 and found[2:5] == [(2, "und", False), (3, "und", False), (4, "und", False)] and found[5] == (None, "aa", True) and found[6][1] in WORDS
    assert language.predict(long.limit(0), network).count() == 0


def test_a_text_is_all_of_its_windows(labelled):
    network = language.train(labelled, epochs=2)
    text = ("kala mana " * 40 + "дом река " * 40).encode()
    raw, at = np.frombuffer(text * 2, np.uint8), np.array([0, len(text), 2 * len(text)])
    share = network.texts(raw, at)
    starts = np.arange(0, len(text), language.WINDOW)
    symbols = language.windows(raw, starts, np.full(len(starts), len(text)))
    letters = (symbols[:, : language.WINDOW] >= language.LETTER).sum(axis=1) + 1e-3
    assert np.allclose(share[0], (network.probabilities(symbols) * letters[:, None]).sum(axis=0) / letters.sum()) and np.allclose(share[0], share[1])
    wide = symbols.astype(np.intp)
    answers = sum(network.filters[o][wide[:, o : o + language.WINDOW]] for o in range(4)).max(axis=1)
    assert np.allclose(network.probabilities(symbols), network.softmax(np.maximum(answers, 0)), atol=1e-5)


def test_gradients_by_differences():
    rng = np.random.default_rng(2)
    network = Network(["a", "b", "c"])
    network.filters, network.layer, network.bias = (p.astype(np.float64) for p in (network.filters, network.layer, network.bias))
    x, label = rng.integers(0, language.SYMBOLS, (6, language.WINDOW + language.AHEAD)), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        answers = sum(network.filters[o][x[:, o : o + language.WINDOW]] for o in range(4)).max(axis=1)
        return -np.log(network.softmax(np.maximum(answers, 0))[np.arange(6), label]).mean()

    for param, grad in zip([network.filters, network.layer, network.bias], network._gradients(x, label), strict=True):
        for at in sorted(np.argsort(np.abs(grad).ravel())[-3:]):
            place = np.unravel_index(at, param.shape)
            before = param[place]
            param[place] = before + 1e-6
            high = loss()
            param[place] = before - 1e-6
            low = loss()
            param[place] = before
            assert abs((high - low) / 2e-6 - grad[place]) < 1e-4


def test_language_learns_from_the_rest_alone(spark, labelled):
    rows = labelled.where(language.remainder() != 2)
    taken = language.training_windows(rows, most=90).collect()
    assert 60 <= len(taken) <= 90 and {r.lang for r in taken} == {*WORDS}
    assert language.train(labelled.withColumn("lang", F.lit(None).cast("string"))) is None
    assert {(r.lang_pred, r.score) for r in language.predict(labelled, None).collect()} == {("und", 0.0)}
    got = language.op11_language_id(spark, SF)
    ids = {r.doc_id: r.held_out for r in got.collect()}
    assert len(ids) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(v == (zlib.crc32(str(i).encode()) % 4 == 2) for i, v in ids.items())
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in got.collect() if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)
