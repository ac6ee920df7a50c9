"""Marks queries: an order stands for a paper, its return flag for a section, the line number for a question, the quantity for marks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import marks as M
from .registry import query, table


def _questions(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", F.col("l_quantity").cast("decimal(12,2)").alias("marks"))
    return M.question_marks(rows, ["l_orderkey", "l_returnflag", "l_linenumber"])


_Q = "SELECT l_orderkey, l_returnflag, l_linenumber, max(CAST(l_quantity AS DECIMAL(12,2))) AS q_marks, sum(CAST(l_quantity AS DECIMAL(12,2))) AS part_sum, count(*) AS parts FROM lineitem GROUP BY 1, 2, 3"


@query("marks_audit", f"SELECT l_orderkey, CAST(sum(q_marks) AS DOUBLE) AS paper_sum, CAST(sum(part_sum) AS DOUBLE) AS header_marks, sum(q_marks) <> sum(part_sum) AS blocking FROM ({_Q}) GROUP BY 1")
def marks_audit(spark, d):
    """AG-01, AG-03, R09: do the questions of each paper add up to its header?"""
    return _questions(spark, d).groupBy("l_orderkey").agg(F.sum("q_marks").cast("double").alias("paper_sum"), F.sum("part_sum").cast("double").alias("header_marks"), (F.sum("q_marks") != F.sum("part_sum")).alias("blocking"))


@query("marks_audit_counts", f"SELECT blocking, count(*) AS papers FROM (SELECT l_orderkey, sum(q_marks) <> sum(part_sum) AS blocking FROM ({_Q}) GROUP BY 1) GROUP BY 1")
def marks_audit_counts(spark, d):
    return marks_audit(spark, d).groupBy("blocking").agg(F.count("*").alias("papers"))


@query(
    "section_totals_orders",
    f"""SELECT l_orderkey, l_returnflag, CAST(sum(q_marks) AS DOUBLE) AS total, count(*) AS n_questions, count(*) FILTER (WHERE q_marks > 45) AS n_high,
    CASE WHEN sum(q_marks) <> sum(part_sum) THEN CASE WHEN count(*) FILTER (WHERE q_marks > 45) > 0 AND sum(q_marks) < sum(part_sum) THEN 'add the missing marks' ELSE 'blocking' END ELSE 'fine' END AS verdict
    FROM ({_Q}) GROUP BY 1, 2""",
)
def section_totals_orders(spark, d):
    """AG-02, R03-R05."""
    q = _questions(spark, d).groupBy("l_orderkey", "l_returnflag").agg(F.sum("q_marks").alias("t"), F.sum("part_sum").alias("e"), F.count("*").alias("n_questions"), F.count_if(F.col("q_marks") > 45).alias("n_high"))
    return q.select("l_orderkey", "l_returnflag", F.col("t").cast("double").alias("total"), "n_questions", "n_high", M.marks_verdict(F.col("t"), F.col("e"), F.col("n_high")).alias("verdict"))


@query(
    "expected_totals",
    """WITH p AS (SELECT l_orderkey, l_returnflag, l_linenumber, max(CASE WHEN l_partkey % 3 <> 0 THEN l_quantity END) AS stated FROM lineitem GROUP BY 1, 2, 3)
    SELECT l_orderkey, l_returnflag, CASE WHEN bool_and(stated IS NOT NULL) THEN sum(stated) ELSE arg_min(stated, l_linenumber) FILTER (WHERE stated IS NOT NULL) END AS expected FROM p GROUP BY 1, 2""",
)
def expected_totals(spark, d):
    """AG-04."""
    p = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linenumber").agg(F.max(F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity"))).alias("stated"))
    return M.expected_total(p, ["l_orderkey", "l_returnflag"], "stated", "l_linenumber")


@query(
    "choice_group_totals",
    """WITH g AS (SELECT l_orderkey, l_linestatus, sum(l_quantity) AS s, count(*) AS offered, bool_and(l_quantity <= 45) AS complete FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, l_linestatus, CASE WHEN complete AND offered >= 2 THEN 10.0 ELSE s END AS worth FROM g""",
)
def choice_group_totals(spark, d):
    """AG-02: a group 'any 2' worth ten marks."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linestatus").agg(F.sum("l_quantity").alias("s"), F.count("*").alias("offered"), F.bool_and(F.col("l_quantity") <= 45).alias("complete"))
    return g.select("l_orderkey", "l_linestatus", M.choice_group_worth(F.lit(10.0), F.col("s"), F.col("complete"), F.lit(2), F.col("offered")).alias("worth"))


@query("sub_sum_alternatives", "SELECT l_orderkey, sum(best) AS sub_sum, count(*) AS labels FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS best FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def sub_sum_alternatives(spark, d):
    """AG-05."""
    return M.sum_of_alternatives(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", "l_quantity")


@query(
    "any_n_of",
    """SELECT o_custkey, count(*) AS offered, CASE WHEN min(m) = max(m) AND max(n) <= count(*) THEN max(n) * max(m) END AS worth
    FROM (SELECT o_custkey, o_orderkey % 2 + 1 AS m, o_custkey % 3 + 1 AS n FROM orders) GROUP BY 1""",
)
def any_n_of(spark, d):
    """M5."""
    rows = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey") % 2 + 1).alias("m"), (F.col("o_custkey") % 3 + 1).alias("k"))
    return M.any_n_worth(rows, ["o_custkey"], "m", F.max("k"))


@query(
    "factor_swap",
    """WITH s AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS questions, max(l_suppkey % 6) AS per, max(l_partkey % 6) AS cnt, bool_and(l_discount < 0.1) AS unmarked FROM lineitem GROUP BY 1)
    SELECT l_orderkey, CASE WHEN questions = per AND per <> cnt AND questions >= 2 AND unmarked THEN cnt ELSE per END AS per, CASE WHEN questions = per AND per <> cnt AND questions >= 2 AND unmarked THEN per ELSE cnt END AS cnt FROM s""",
)
def factor_swap(spark, d):
    """M1, AG-11."""
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").alias("questions"), F.max(F.col("l_suppkey") % 6).alias("a"), F.max(F.col("l_partkey") % 6).alias("b"), F.bool_and(F.col("l_discount") < 0.1).alias("unmarked"))
    swap = M.swapped_factors(F.col("a"), F.col("b"), F.col("questions"), F.col("unmarked"))
    return s.select("l_orderkey", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("per"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("cnt"))


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_discount", "l_tax"]


@query(
    "or_twin",
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN l_quantity END AS m, {', '.join(_ORDER[1:])} FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, coalesce(m, CASE WHEN lag(l_linenumber) OVER w = l_linenumber THEN lag(m) OVER w END, CASE WHEN lead(l_linenumber) OVER w = l_linenumber THEN lead(m) OVER w END) AS twin_marks
    FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)})""",
)
def or_twin(spark, d):
    """M8, JN-07."""
    rows = table(spark, d, "lineitem").select("l_orderkey", *_ORDER, F.when(F.col("l_partkey") % 2 == 0, F.col("l_quantity")).alias("m"))
    return M.or_twin(rows, "l_orderkey", _ORDER, "l_linenumber", "m").select("l_orderkey", "l_linenumber", "l_partkey", "twin_marks")


@query(
    "marks_inference",
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 1.0 END AS own, CASE WHEN o_orderkey % 5 = 0 THEN 2.0 END AS grp, CASE WHEN o_custkey % 5 = 0 THEN 3.0 END AS ab, CASE WHEN o_custkey % 7 = 0 THEN 4.0 END AS anyn,
      CASE WHEN o_orderkey % 3 = 0 THEN 5.0 END AS subs, CASE WHEN o_custkey % 3 = 0 THEN 6.0 END AS twin, CASE WHEN o_orderkey % 2 = 0 THEN 7.0 END AS sec FROM orders)
    SELECT CASE WHEN own IS NOT NULL THEN 'paper' WHEN grp IS NOT NULL THEN 'group instruction' WHEN ab IS NOT NULL THEN 'alternative A/B' WHEN anyn IS NOT NULL THEN 'any N' WHEN subs IS NOT NULL THEN 'sum of sub-parts'
      WHEN twin IS NOT NULL THEN 'OR twin' WHEN sec IS NOT NULL THEN 'section' END AS source, sum(coalesce(own, grp, ab, anyn, subs, twin, sec)) AS marks, count(*) AS questions FROM r GROUP BY 1""",
)
def marks_inference(spark, d):
    """M2-M9, AG-19."""
    on = lambda test, v: F.when(test, F.lit(float(v)))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    none = F.lit(None).cast("double")
    got = M.inferred(on(k % 7 == 0, 1), group=on(k % 5 == 0, 2), alternatives=on(c % 5 == 0, 3), stem_and_subs=none, any_n=on(c % 7 == 0, 4), subs=on(k % 3 == 0, 5), inner=none, twin=on(c % 3 == 0, 6), section=on(k % 2 == 0, 7))
    return table(spark, d, "orders").select(got.alias("m")).groupBy(F.col("m.source").alias("source")).agg(F.sum("m.marks").alias("marks"), F.count("*").alias("questions"))


@query(
    "paper_known_flag",
    "SELECT o_custkey, bool_and(p IS NOT NULL) AS all_known, sum(p) AS paper_sum, count(*) AS questions, count(DISTINCT o_orderstatus) AS sections FROM (SELECT o_custkey, o_orderstatus, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 10 END AS p FROM orders) GROUP BY 1",
)
def paper_known_flag(spark, d):
    """AG-03, AG-16."""
    rows = table(spark, d, "orders").select("o_custkey", "o_orderstatus", F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderkey") % 10).alias("p"))
    return rows.groupBy("o_custkey").agg(F.bool_and(F.col("p").isNotNull()).alias("all_known"), F.sum("p").alias("paper_sum"), F.count("*").alias("questions"), F.count_distinct("o_orderstatus").alias("sections"))
