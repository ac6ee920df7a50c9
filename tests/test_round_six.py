"""What the sixth round changed: headers made once, from the lines before the first section or question; items joined with fewer sorts."""

from paperloom.operators import items as I
from paperloom.operators import papers as P
from paperloom.operators import render as V
from paperloom.tables import unsized_batches

SCHOOL = r"(?i)\bschool\b"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_header_block_makes_its_header_once(spark):
    lines = spark.createDataFrame([("a", 1, "Hill School"), ("a", 2, "Class: VII  Max. Marks: 20"), ("a", 3, "General Instructions: Write."), ("a", 4, "2) Read."), ("a", 5, "Q.1. Go on. Class: IX"), ("a", 6, "Subject: Art"), ("b", 1, "Section A")], "paper_id string, line_no int, text string")
    block = V.header_block(P.headers(lines, SCHOOL), "HILL SCHOOL")
    assert _plan(block).count("Aggregate [") == 1
    rows = [(r.paper_id, r.style, r.line, r.text) for r in block.orderBy("paper_id", "block", "line").collect()]
    assert [r[1:] for r in rows if r[0] == "a"] == [
        ("school", 0, "HILL SCHOOL"), ("exam", 0, "EXAMINATION"), ("header", 0, "Class: VII\tSubject: SUBJECT\tMarks: 20 marks"), ("header rule", 0, "Date: ____/____/________\tRoll No.:______________\tTime: 3 hours"),
        ("instructions", 0, "General Instructions:"), ("instruction", 0, "1.\tWrite."), ("instruction", 1, "2)\tRead."),
    ]
    assert not [r for r in rows if r[0] == "b"]


def test_headers_look_over_no_line_behind_the_first_section(spark):
    lines = spark.createDataFrame([("a", 1, "Class: VII")], "paper_id string, line_no int, text string")
    plan = _plan(P.headers(lines, SCHOOL))
    patterns = plan.count("RLIKE") + plan.count("regexp_extract")
    assert patterns < 100, patterns  # 212 before, each line of the paper through them all


def test_islands_are_sorted_once_a_step_and_rows_are_carried_past_them(spark):
    rows = spark.createDataFrame([("a", 1, "A", 1, "question", k, "cont", None, None, f"W{k}\tX{k}", None, k) for k in (3, 1, 2)], "paper_id string, section_no int, letter string, entry_no int, kind string, item_no int, item string, label string, nested string, text string, item_marks double, block_pos int")
    rows = rows.selectExpr("*", "string(null) rest", "array(string(null)) options", "false floating", "array(array(string(null))) cells")
    done = I.settled(rows)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") <= 12, plan.count("Sort [")  # 17 before
    assert plan.count("carried") > 0
    assert done.columns == rows.columns
    assert [(r.item, r.cells, r.letter, r.block_pos) for r in done.collect()] == [("pairs", [["W1", "X1"], ["W2", "X2"], ["W3", "X3"]], "A", 1)]


def test_batches_are_not_sized_row_by_row_and_the_setting_comes_back(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    with unsized_batches(spark):
        assert spark.conf.get(name) == str(2**31 - 1)
    assert spark.conf.get(name) == was
