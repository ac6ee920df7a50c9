"""The pipeline's near-duplicate stage against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

import corpus_pipeline
from paperloom.llm import near_copies as N
from paperloom.llm.simhash import shingles

WORDS = [f"{a}{b}{c}" for a in "bdgklmnprst" for b in "aeiou" for c in ("n", "r", "st", "")]


def five(text: str) -> set:
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a: str, b: str) -> float:
    x, y = five(a), five(b)
    return len(x & y) / max(1, len(x | y))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    out = []
    for k in range(150):
        words = rng.choices(WORDS, k=rng.choice([12, 60, 300, 900]))
        out.append(" ".join(words))
        for _ in range(k % 3):
            near = list(words)
            for _ in range(max(1, int(len(words) * rng.choice([0.005, 0.01, 0.02])))):
                near[rng.randrange(len(near))] = rng.choice(WORDS)
            out.append(" ".join(near))
    return [*out, "", "", "one two", "One  TWO", "x", out[0]]


def test_estimates_follow_jaccard(texts):
    sig = [N.signature(N.five_words(h))[0] if (h := shingles(t.encode())) else np.zeros(N.BINS, np.uint16) for t in texts[:120]]
    off = [N.alike(s[None], t)[0] - jaccard(a, b) for s, a in zip(sig, texts, strict=False) for t, b in zip(sig, texts, strict=False) if jaccard(a, b) > 0.3]
    assert abs(np.mean(off)) < 0.01 and np.abs(off).max() < 0.12


def test_links_of_all_similar_pairs(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)
    kept = {r.doc_id for r in N.survivors(docs).collect()}
    chunked = {r.doc_id for r in N.survivors(docs, most=2).collect()}
    assert kept == chunked
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if jaccard(texts[a], texts[b]) >= 0.8 and texts[a] != texts[b]]
    assert len(pairs) > 60
    met = sum(not (a in kept and b in kept) for a, b in pairs)
    assert met >= 0.95 * len(pairs)
    # what is like no other text stays, and of each group at least one
    alone = [k for k, t in enumerate(texts) if all(jaccard(t, u) < 0.7 for j, u in enumerate(texts) if j != k) and t]
    assert len(alone) > 30 and set(alone) <= kept
    for k, t in enumerate(texts):
        assert k in kept or any(j in kept and (jaccard(t, u) > 0.55 or t == u) for j, u in enumerate(texts) if j != k)
    assert len({"", "one two", "x"} & {texts[k].lower() for k in kept}) == 3 and {len(texts) - 1, len(texts) - 5} & kept == set()


def test_a_key_of_many_texts(spark):
    rng = random.Random(3)
    line = " ".join(rng.choices(WORDS, k=30))
    rows = [(k, f"{line} {' '.join(rng.choices(WORDS, k=2))}") for k in range(300)] + [(1000 + k, f"{line} {' '.join(rng.choices(WORDS, k=40))}") for k in range(60)]
    found = [{r.doc_id for r in N.survivors(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()} for most in (2000, 40)]
    assert found[0] == found[1] and sum(k < 1000 for k in found[0]) == 1 and {k for k in found[0] if k >= 1000} == {1000 + k for k in range(60)}


def test_pipeline_of_nothing_and_of_odd_rows(spark, tmp_path):
    sf = tmp_path / "sf"
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    labels = "doc_id long, quality int, toxic int"
    rng = random.Random(1)
    long = " ".join(rng.choices(WORDS, k=200_000))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words here", "en", "s", 15), (3, long, "en", "s", len(long)), (4, " ".join(rng.choices(WORDS, k=400)), "en", "s", 1), (4, "twice", "en", "s", 5), (4, "twice", "en", "s", 5)]
    for name, part in (("none", []), ("odd", rows)):
        spark.createDataFrame(part, schema).write.parquet(f"file://{sf}/{name}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"file://{sf}/{name}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{sf}/none").count() == 0
    got = corpus_pipeline.run(spark, f"file://{sf}/odd").collect()
    assert {r.doc_id for r in got} == {1, None, 3, 4} and sum(r.length for r in got if r.doc_id == 3) == max(r.doc_tokens for r in got if r.doc_id == 3)
