"""What the seventh round changed: patterns tried on lines that can hold them, a cheaper pass over papers, entries clustered once."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.operators import lines as L
from paperloom.operators import papers as P
from paperloom.tables import small_methods

SCHOOL = r"(?i)\bschool\b"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_line_that_begins_otherwise_is_spared_the_patterns(spark):
    texts = ["Section A", "SECTION: भाग", "s", "1. x", "Q.1 x", "प्र.३ x", "प्रश्न ४", "12 (A) x", "", "é", "-", "ſection A", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    t = F.col("t")
    got = rows.select("t", L.is_heading(t).alias("h"), (t.rlike(L.SECTION) | t.rlike(L.BARE_SECTION)).alias("h2"), L.is_question(t).alias("q"), (t.rlike(L.Q_DOT) | t.rlike(L.Q_NUMBER) | t.rlike(L.Q_ALTERNATIVE)).alias("q2")).collect()
    assert all((r.h, r.q) == (r.h2, r.q2) for r in got) and sum(bool(r.h) for r in got) == 2 and sum(bool(r.q) for r in got) == 5


@pytest.mark.parametrize("text", ["x [3]", "x [3] ", "x (2 Marks)\n", "x 5 अंक", "x 4M", "x [1] [2]", "[7]", "x 3 MARKS\u2028", "x 3 k", "", "x [3]."])
def test_the_mark_at_an_end_and_the_text_before_it(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(T.trailing_mark(F.col("t")).alias("m"), F.regexp_extract("t", T.TRAILING_MARK, 0).alias("end"), F.regexp_replace("t", T.TRAILING_MARK, "").alias("rest")).first()
    marked = got.end != "" and not ("[" in got.end and text.count("[") > 1)
    assert (got.m.marks is not None) == marked and got.m.text == (got.rest if marked else text)


def test_values_are_those_of_lists():
    for column in (pa.array([1, None, 3], pa.int32()), pa.array([1, 2], pa.int32()), pa.array([1.5, None]), pa.array([True, None, False]), pa.array([True, False]), pa.array(["a", None, ""]), pa.array([["a", None], None]), pa.array([None, None], pa.string()), pa.array([], pa.float64())):
        got = P._values(column)
        assert got == column.to_pylist() and [type(x) for x in got] == [type(x) for x in column.to_pylist()]


def test_papers_are_clustered_once_for_their_entries(spark):
    lines = spark.createDataFrame([("a", 1, "Section A (4 Marks)"), ("a", 2, "1. Name it. [2]"), ("a", 3, "(a) one"), ("a", 4, "2. Why? [2]")], "paper_id string, line_no int, text string")
    found = spark.createDataFrame(P.items(lines).collect(), P.ENTRIES)
    plan = _plan(P.entries(found).select("paper_id", "number", "marks"))
    assert plan.count("Exchange hashpartitioning") == 1, plan.count("Exchange hashpartitioning")  # 2 before
    assert plan.count("Sort [") <= 4, plan.count("Sort [")
    assert "RowFrame, 1, unboundedfollowing" not in plan  # all rows behind each row, gone through anew
    assert [(r.number, r.marks) for r in P.questions(found).orderBy("number").collect()] == [(1, 2.0), (2, 2.0)]


def test_headings_repeated_later_that_hold_nothing_go(spark):
    lines = spark.createDataFrame([("a", k, t) for k, t in enumerate(["Section A", "Section B", "Section A", "1. x [2]", "Section B", "2. y [3]", "Section C"], 1)], "paper_id string, line_no int, text string")
    got = [(r.letter, r.number) for r in P.entries(P.items(lines)).orderBy("section_no", "entry_no").collect()]
    assert got == [("A", None), ("A", 1), ("B", None), ("B", 2), ("C", None)]


def test_the_limit_of_methods_comes_back(spark):
    name = "spark.sql.codegen.hugeMethodLimit"
    was = spark.conf.get(name)
    with small_methods(spark):
        assert spark.conf.get(name) == "8000"
    assert spark.conf.get(name) == was


def test_the_summary_reads_no_line_again_for_its_headers(spark):
    from paperloom.plans import papers as Q

    assert not [f for f in Q.paper_summary(spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]


def test_differences_deal_texts_out_without_joins(spark):
    from paperloom.operators import diff as D

    rows = lambda lines: spark.createDataFrame([(1, k, t) for k, t in enumerate(lines)] + [(None, 0, "z")], "f int, place int, line string")
    old, new = rows(["a", "b", "b", None, "c", "d"]), rows(["a", "x", "b", None, "d", "d"])
    script = D.ordered_diff(old, new, "f", anchored=True)
    assert "Join" not in _plan(script)
    script = spark.createDataFrame(script.collect(), script.schema)
    done = D.patched(old, script, "f")
    assert "Join" not in _plan(done)
    assert [(r.number, r.line) for r in done.where("f = 1").orderBy("number").collect()] == list(enumerate(["a", "x", "b", None, "d", "d"], 1))
    assert [r.line for r in done.where("f is null").collect()] == ["z"]
