"""Ordered differences and free numbers against brute force."""

from __future__ import annotations

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from paperloom.operators import diff as D
from paperloom.operators.sequences import nth_free


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return row[-1]


def cases():
    rng = random.Random(5)
    out = [([], []), (["a"], []), ([], ["a"]), ([None, "", None], ["", None]), (["a", "b", "c"], ["c", "a", "b"]), (["x"] * 9, ["x"] * 4)]
    for _ in range(60):
        a = [rng.choice("abcde" if rng.random() < 0.7 else "abcdefghijklmnop") for _ in range(rng.randint(0, 25))]
        b = [x for x in a for _ in range(rng.choice([0, 1, 1, 1, 2]))]
        rng.shuffle(b) if rng.random() < 0.3 else None
        out.append((a, b))
    return out


@pytest.mark.parametrize("bits", [1 << 28, 64, 1])
def test_matches_are_longest_common_subsequences(monkeypatch, bits):
    monkeypatch.setattr(D, "KEPT_BITS", bits)
    for a, b in cases():
        pairs = D.common_lines(a, b)
        assert len(pairs) == common_length(a, b) and all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


@pytest.mark.parametrize("anchored", [False, True])
def test_scripts_in_order(spark, anchored):
    schema = "file string, place int, line string"
    old, new = ([(f"f{k}", 10 * p, line) for k, case in enumerate(cases()) for p, line in enumerate(case[side])] for side in (0, 1))
    old, new = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    script = D.ordered_diff(old, new, "file", anchored=anchored)
    by_file = {}
    for r in script.orderBy("file", "seq").collect():
        by_file.setdefault(r.file, []).append((r.sign, r.number, r.line))
    for k, (a, b) in enumerate(cases()):
        rows, out, at = by_file.get(f"f{k}", []), [], 0
        for sign, number, line in rows:
            if sign == "-":  # the script read as a patch: what stands before goes over
                out += a[at : number - 1]
                at = number
                assert a[number - 1] == line
            else:
                stay = number - 1 - len(out)
                out += a[at : at + stay]
                at += stay
                out.append(line)
        assert out + a[at:] == b
        least = len(a) + len(b) - 2 * common_length(a, b)
        assert len(rows) >= least if anchored else len(rows) == least
    again = Counter((r.file, r.number, r.line) for r in D.patched(old, script, "file").collect())
    assert again == Counter((f"f{k}", p + 1, line) for k, (_, b) in enumerate(cases()) for p, line in enumerate(b))
    report = {r.file: r for r in D.shown(script, "file", most=2).collect()}
    assert report["f4"].lines == ["-c", "+c"] or len(report["f4"].lines) == 2
    assert report["f5"].lines == ["-x", "-x"] and report["f5"].more == 3


def test_a_long_file_takes_seconds():
    rng = random.Random(1)
    a = [f"line {rng.randint(0, 30_000)}" for _ in range(100_000)]
    b = [x for x in a if rng.random() > 0.02]
    for k in range(0, len(b), 50):
        b[k] = f"line {rng.randint(0, 30_000)}"
    began = time.perf_counter()
    pairs = D.common_lines(a, b)
    assert len(pairs) > 94_000 and all(a[i] == b[j] for i, j in pairs) and time.perf_counter() - began < 60


def test_nth_free_as_a_loop(spark):
    rng = random.Random(2)
    held = [(g, rng.randint(-2, 30)) for g in "abc" for _ in range(25)] + [("d", 1), ("d", 2), ("d", 4)]
    rows = [(g, n) for g in "abcde" for n in (*range(1, 20), 40)]
    got = {(r.g, r.n): r.free for r in nth_free(spark.createDataFrame(rows, "g string, n int"), spark.createDataFrame(held, "g string, free int"), ["g"], "n", "free").collect()}
    for g, n in rows:
        free = [k for k in range(1, 100) if (g, k) not in held]
        assert got[g, n] == free[n - 1]
    big = spark.range(1, 1_000_001).select(F.lit("x").alias("g"), F.col("id").alias("n"))
    taken = spark.range(1, 1_000_001).select(F.lit("x").alias("g"), (F.col("id") * 2).alias("free"))
    assert nth_free(big, taken, ["g"], "n", "free").where("free <> 2 * n - 1").count() == 0
