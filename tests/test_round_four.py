"""What the fourth round changed: which items go through the windows that join them, tasks of bounded size, attempts without frames of their own."""

from pyspark.sql import Row

from paperloom.functions import text as T
from paperloom.operators import papers as P
from paperloom.streaming.filing import Attempts
from paperloom.tables import stored


def _lines(spark, *papers):
    rows = [(f"p{k}", n, text, None) for k, paper in enumerate(papers) for n, text in enumerate(paper, 1)]
    return spark.createDataFrame(rows, "paper_id string, line_no int, text string, align string")


def test_only_entries_with_neighbours_are_joined(spark):
    rows = _lines(spark, ["Section A (9 marks)", "1. Alone here. [2]", "2. One part:", "(a) the part 3M", "3. Two parts:", "(a) first", "(b) second", "4. A line that is", "broken in two."])
    own = P.candidates(rows).coalesce(1).sortWithinPartitions("paper_id", "order_no", "part_no").mapInArrow(P._fold, P._FOLDED)
    near = {(r.number, r.near) for r in own.where("number is not null").collect()}
    assert near == {(1, None), (2, None), (3, True), (4, True)}
    texts = [(r.number, r.item, r.text) for r in P.items(rows).where("number is not null").orderBy("entry_no", "item_no").collect()]
    assert texts == [(1, "stem", "Alone here."), (2, "stem", "One part:"), (2, "sub", "the part"), (3, "stem", "Two parts:"), (3, "sub", "first"), (3, "sub", "second"), (4, "stem", "A line that is broken in two.")]


def test_tasks_stay_small_whatever_the_table(spark, monkeypatch):
    monkeypatch.setattr(P, "TASK_ROWS", 3)
    rows = spark.range(3000).selectExpr("cast(id as string) paper_id")
    assert P.dealt(rows).rdd.getNumPartitions() == 1001


def test_entries_go_over_items_once(spark):
    found = stored(P.items(_lines(spark, ["Section A (4 marks)", "Answer all.", "1. First. [2]", "1. Its twin.", "2. Other. [2]"])))
    all_entries = P.entries(found)
    assert "Union" not in all_entries._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.kind, r.number, r.marks) for r in all_entries.where("kind is not null").orderBy("entry_no").collect()] == [("note", None, None), ("question", 1, 2.0), ("question", 1, 2.0), ("question", 2, 2.0)]


def test_spaces_and_marks_as_before(spark):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate([None, "", " a", "a ", "a b", "a   b", "a  b", "(\t)", "a​b", "plain [2]", "[1] two [2]", "x 3M", "x (4 marks)"])], "k int, t string")
    got = [(r.s, r.m.marks, r.m.text) for r in rows.select("k", T.normalize_space(rows.t).alias("s"), T.trailing_mark(rows.t).alias("m")).orderBy("k").collect()]
    assert [s for s, _, _ in got] == [None, "", "a", "a", "a b", "a\tb", "a b", "(      )", "ab", "plain [2]", "[1] two [2]", "x 3M", "x (4 marks)"]
    assert [(m, t) for _, m, t in got][-4:] == [(2, "plain"), (None, "[1] two [2]"), (3, "x"), (4, "x")]


def test_attempts_take_rows(spark):
    class Held:
        value = None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    paper = Attempts()
    paper.state = Held()
    rows = [Row(at=at, source=source, blocking=blocking, content=content) for at, source, blocking, content in [(2, "b", False, "y"), (1, "a", True, "x"), (3, None, False, "y")]]
    out = list(paper.handleInputRows(("p",), iter(rows), None))
    assert [(r.source, r.status, r.name, r.superseded_note) for r in out] == [("a", "needs-fixes", "p_REVIEW", None), ("b", "formatted", "p", "p_REVIEW"), (None, "recovered", "p", None)]
