"""Free names, the log of moves and the filing stream against loops."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paperloom.operators import filing as O
from paperloom.streaming import filing as S


def by_loop(moves):
    """The log gone through in order."""
    where, held, out = {}, {}, {}
    for at, file, folder, name in sorted(moves):
        slot = (folder, name)
        out[at] = held.get(slot, file) == file
        if out[at]:
            held.pop(where.get(file), None)
            held[slot], where[file] = file, slot
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_moves_as_a_loop(spark, seed):
    rng = random.Random(seed)
    moves = [(at, rng.randrange(40), rng.choice("ab"), rng.choice("pqrstuvw")) for at in range(300)]
    log = spark.createDataFrame(moves, "at long, file int, folder string, name string").repartition(3)
    settled = O.settle(log)
    want = by_loop(moves)
    assert {r.at: r.accepted for r in settled.collect()} == want and 20 < sum(want.values()) < 280
    held = O.intervals(settled)
    for at in (0, 57, 299):
        where = {}
        for t, file, folder, name in moves:
            if t <= at and want[t]:
                where[file] = (folder, name)
        rows = [(r.file, (r.folder, r.name)) for r in O.listing_at(held, F.lit(at)).collect()]
        assert len(rows) == len(where) and dict(rows) == where and len(set(where.values())) == len(where)
    papers = [(k, rng.randrange(300), rng.choice("abc"), rng.choice("pqrstuvw")) for k in range(80)]
    got = {r.k: r.holder for r in O.held_when(spark.createDataFrame(papers, "k int, at long, folder string, name string"), held, "at").collect()}
    for k, at, folder, name in papers:
        where = {}
        for t, file, *slot in moves:
            if t <= at and want[t]:
                where[file] = tuple(slot)
        assert got[k] == next((f for f, slot in where.items() if slot == (folder, name)), None)
    assert O.settle(log.limit(0)).count() == 0


def test_names_of_listings(spark):
    names = ["a.docx", "a_v2_REVIEW.docx", "b_v2.docx", "b_v10.docx", "c_v1.docx", "c_v02.docx", "d.pdf", None, "_v3.docx"]
    held = {(r.base, r.version) for r in O.held_versions(spark.createDataFrame([(n,) for n in names], "name string"), "name", [".docx", "_REVIEW.docx"]).collect()}
    assert held == {("a", 1), ("a_v2", 1), ("a", 2), ("b_v2", 1), ("b", 2), ("b_v10", 1), ("b", 10), ("c_v1", 1), ("c_v02", 1), ("_v3", 1), ("", 3)}
    rows = spark.createDataFrame([("a", k) for k in range(3)] + [("b", 9), ("e", 1)], "base string, k int")
    listing = O.held_versions(spark.createDataFrame([(n,) for n in names], "name string"), "name", [".docx", "_REVIEW.docx"])
    got = [r.free_name for r in O.free_names(rows, "base", ["k"], listing, spark.createDataFrame([("a", 4)], "base string, version int")).orderBy("base", "k").collect()]
    assert got == ["a_v3", "a_v5", "a_v6", "b", "e"]
    gone = spark.createDataFrame([("x.docx", 1), ("x.docx", 2), ("x.pdf", 1), ("y", 1)], "name string, k int")
    archive = spark.createDataFrame([("x_superseded.docx",), ("x_superseded_v3.docx",), ("y_superseded_v2",)], "name string")
    assert sorted((r.name, r.k, r.archived) for r in O.retired(gone, archive, ["k"]).collect()) == [("x.docx", 1, "x_superseded_v2.docx"), ("x.docx", 2, "x_superseded_v4.docx"), ("x.pdf", 1, "x_superseded.pdf"), ("y", 1, "y_superseded")]


SCHEMA = "base string, at long, source string, blocking boolean, note string"


def attempts(n):
    rng = random.Random(n)
    return [(f"p{rng.randrange(9)}", at, f"{at}.docx", rng.random() < 0.6, f"# Note\nSource: {at}\n\n  - point {rng.randrange(3)} \n") for at in range(n)]


def filed_by_loop(rows):
    needs, made, first, out = defaultdict(dict), defaultdict(int), {}, []
    for base, at, source, blocking, note in rows:
        text, gone = note.split("point ")[1].strip(), (None, None)
        if blocking and needs[base].get(1, (None,))[0] == text:
            status, name = "recovered", f"{base}_REVIEW"
        elif blocking:
            n = next(k for k in range(1, 999) if k not in needs[base])
            needs[base][n] = (text, source)
            status, name = "needs-fixes", f"{base}_REVIEW" + (f"_v{n}" if n > 1 else "")
        elif made[base] and first[base] == text:
            status, name = "recovered", base
        else:
            made[base] += 1
            first.setdefault(base, text)
            status, name = "formatted", base + (f"_v{made[base]}" if made[base] > 1 else "")
            if 1 in needs[base]:
                gone = (f"{base}_REVIEW", needs[base].pop(1)[1])
        out.append((base, at, source, status, name, *gone))
    return out


def test_stream_stops_between_two_writes_and_goes_on(spark, tmp_path):
    rows = attempts(120)
    schema = spark.createDataFrame([], SCHEMA).schema
    root = f"file://{tmp_path}"
    for k in range(4):  # a file a batch
        spark.createDataFrame(rows[30 * k : 30 * (k + 1)], schema).coalesce(1).write.parquet(f"{root}/in/part={k}")

    def stop(number):
        if number == 1:
            raise RuntimeError("stopped")

    run = lambda after=None: S.file_all(spark, f"{root}/in/part=*", schema, f"{root}/log", f"{root}/out", files_per_batch=1, after=after)
    with pytest.raises(Exception, match="stopped"):
        run(stop)
    half = spark.read.parquet(f"{root}/out/results").count()
    assert half == 60 and spark.read.parquet(f"{root}/out/superseded").select("batch").distinct().count() <= 1
    run()
    run()
    results = {(r.base, r.at, r.source, r.status, r["name"]) for r in spark.read.parquet(f"{root}/out/results").collect()}
    gone = {(r.base, r.at, r.superseded_note, r.superseded_source) for r in spark.read.parquet(f"{root}/out/superseded").collect()}
    want = filed_by_loop(rows)
    assert results == {w[:5] for w in want} and len(results) == 120
    assert gone == {(w[0], w[1], *w[5:]) for w in want if w[5]} and len(gone) > 5
    assert {w[3] for w in want} == {"recovered", "needs-fixes", "formatted"}


def test_content_is_compared_without_source_and_blanks(spark):
    notes = ["a\n\nSource: x\n b ", "a\r\nb\nSource: yy", "a\nb c", None, ""]
    got = [r[0] for r in spark.createDataFrame([(k, n) for k, n in enumerate(notes)], "k int, note string").orderBy("k").select(S.content(F.col("note"))).collect()]
    assert got[0] == got[1] != got[2] and got[3] == got[4]
