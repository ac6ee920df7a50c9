"""Marks: what questions, sections and papers are worth, and how missing marks are inferred.

Questions come as rows (paper, section, number, marks, ...). All of it is aggregation and windows over the
paper; nothing needs more than one paper's rows together, so one shuffle by paper serves a whole plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def question_marks(rows: DataFrame, keys: list[str], marks: str = "marks") -> DataFrame:
    """AG-01: parts of one question are alternatives, so it is worth the most of them; null if none is marked. part_sum is what all parts add up to."""
    return rows.groupBy(*keys).agg(F.max(marks).alias("q_marks"), F.sum(marks).alias("part_sum"), F.count("*").alias("parts"))


def section_totals(questions: DataFrame, paper: str, section: str) -> DataFrame:
    """AG-02: sum, number of questions and of unmarked ones by section."""
    return questions.groupBy(paper, section).agg(F.coalesce(F.sum("q_marks"), F.lit(0)).alias("total"), F.count("*").alias("n_questions"), F.count_if(F.col("q_marks").isNull()).alias("n_missing"))


def choice_group_worth(total: Column, sum_: Column, complete: Column, asked: Column, offered: Column) -> Column:
    """AG-02: 'any 4 of 6' counts its stated total once all six are marked and enough are offered."""
    return F.when(complete & total.isNotNull() & (offered >= asked), total).otherwise(sum_)


def expected_total(parts: DataFrame, keys: list[str], total: str, order: str) -> DataFrame:
    """AG-04: parts' stated totals add up if all state one; else the first that is known counts."""
    return parts.groupBy(*keys).agg(
        F.when(F.bool_and(F.col(total).isNotNull()), F.sum(total)).otherwise(F.min_by(total, F.when(F.col(total).isNotNull(), F.col(order)))).alias("expected")
    )


def marks_verdict(sum_: Column, expected: Column, missing: Column) -> Column:
    """R03-R05: what a section's sum against its heading calls for."""
    return (
        F.when(expected.isNotNull() & (sum_ != expected), F.when((missing > 0) & (sum_ < expected), "add the missing marks").otherwise("blocking"))
        .when(expected.isNull() & (missing > 0), "no total and marks missing")
        .otherwise("fine")
    )


def sum_of_alternatives(rows: DataFrame, keys: list[str], label: str, marks: str) -> DataFrame:
    """AG-05: sub-parts with the same label are alternatives; the question is worth the sum of their most."""
    return rows.groupBy(*keys, label).agg(F.max(marks).alias("best")).groupBy(*keys).agg(F.sum("best").alias("sub_sum"), F.count("*").alias("labels"))


def any_n_worth(rows: DataFrame, keys: list[str], marks: str, n: Column) -> DataFrame:
    """M5: 'any N' of equally marked sub-parts is worth N times the mark; null otherwise."""
    return rows.groupBy(*keys).agg(F.min(marks).alias("low"), F.max(marks).alias("high"), F.count("*").alias("offered"), n.alias("n")).select(
        *keys, "offered", F.when((F.col("low") == F.col("high")) & (F.col("n") <= F.col("offered")), F.col("n") * F.col("high")).alias("worth")
    )


def swapped_factors(per: Column, count: Column, distinct: Column, unmarked: Column) -> Column:
    """M1: a heading '5x2' over five unmarked questions means two marks each: factors trade places."""
    return (distinct == per) & (per != count) & (distinct >= 2) & unmarked


def or_twin(rows: DataFrame, paper: str, order: list[str], number: str, marks: str) -> DataFrame:
    """M8, JN-07: an unmarked question shares the mark of a neighbour with its number, the one before first."""
    w = Window.partitionBy(paper).orderBy(*order)
    near = lambda f: F.when(f(number).over(w) == F.col(number), f(marks).over(w))
    return rows.withColumn("twin_marks", F.coalesce(F.col(marks), near(F.lag), near(F.lead)))


def inferred(own: Column, *, group: Column, alternatives: Column, stem_and_subs: Column, any_n: Column, subs: Column, inner: Column, twin: Column, section: Column) -> Column:
    """M2-M9: the mark and where it comes from, by the first rule that gives one."""
    ladder = [(own, "paper"), (group, "group instruction"), (alternatives, "alternative A/B"), (stem_and_subs, "stem and sub-parts"), (any_n, "any N"), (subs, "sum of sub-parts"), (inner, "paper (inner line)"), (twin, "OR twin"), (section, "section")]
    out = F.when(ladder[0][0].isNotNull(), F.struct(ladder[0][0].cast("double").alias("marks"), F.lit(ladder[0][1]).alias("source")))
    for value, source in ladder[1:]:
        out = out.when(value.isNotNull(), F.struct(value.cast("double").alias("marks"), F.lit(source).alias("source")))
    return out
