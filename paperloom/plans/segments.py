"""Ordered-sequence queries, over events of a user, turns of a conversation or lines of an order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segments as S
from .registry import query, table

_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query("numbering_gaps", "WITH q AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem), n AS (SELECT l_orderkey, l_linenumber, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS nx FROM q) SELECT l_orderkey, unnest(range(l_linenumber + 1, nx)) AS missing FROM n WHERE nx > l_linenumber + 1")
def numbering_gaps(spark, d):
    return S.gaps(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("numbering_dups", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def numbering_dups(spark, d):
    return S.repeats(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("numbering_start", "SELECT l_orderkey, min(l_linenumber) AS first_number FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1")
def numbering_start(spark, d):
    """R17: papers whose numbering does not begin at 1."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_number")).where("first_number <> 1")


_ISLANDS = f"""WITH s AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type THEN 1 ELSE 0 END AS st FROM events WINDOW w AS {_W}),
    i AS (SELECT *, sum(st) OVER {_W} AS island FROM s)"""


@query("question_islands", f"{_ISLANDS} SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n FROM i GROUP BY 1, 2")
def question_islands(spark, d):
    """WN-01."""
    return S.runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@query("match_pairs_runs", f"{_ISLANDS} SELECT user_id, CAST(island AS BIGINT) AS island, min(event_type) AS event_type, count(*) AS n FROM i GROUP BY 1, 2 HAVING count(*) >= 3")
def match_pairs_runs(spark, d):
    """WN-08: three and more neighbours make a table."""
    return S.runs(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type", least=3)


@query(
    "choice_groups",
    f"""WITH u AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER {_W} AS unit FROM events)
    SELECT event_id, CAST(unit AS BIGINT) AS unit, max(CASE WHEN event_type = 'signup' THEN value END) OVER (PARTITION BY user_id, unit) AS unit_group FROM u""",
)
def choice_groups(spark, d):
    """WN-02."""
    return S.choice_units(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("value")).select("event_id", "unit", "unit_group")


@query("group_mark_carried", f"SELECT event_id, last_value(CASE WHEN event_type = 'signup' AND value > 50 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS group_mark FROM events")
def group_mark_carried(spark, d):
    """WN-19: only the next note with a group takes over."""
    mark = F.when((F.col("event_type") == "signup") & (F.col("value") > 50), F.col("value"))
    return S.carry_forward(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], mark, "group_mark").select("event_id", "group_mark")


@query("forward_fill_heading", "SELECT conv_id, turn, sha256(last_value(CASE WHEN role <> 'assistant' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS heading FROM conversations")
def forward_fill_heading(spark, d):
    """WN-12."""
    return S.carry_forward(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.when(F.col("role") != "assistant", F.col("text")), "heading").select("conv_id", "turn", F.sha2("heading", 256).alias("heading"))


@query("restart_segments", f"WITH r AS (SELECT *, CASE WHEN event_id % 10 <= lag(event_id % 10) OVER w THEN 1 ELSE 0 END AS st FROM events WINDOW w AS {_W}) SELECT event_id, CAST(sum(st) OVER {_W} AS BIGINT) AS segment FROM r")
def restart_segments(spark, d):
    """WN-14."""
    return S.restarts(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_id") % 10).select("event_id", "segment")


@query(
    "header_prefix",
    """WITH s AS (SELECT conv_id, turn, length(text) AS chars, min(CASE WHEN role = 'assistant' AND length(text) > 300 THEN turn END) OVER (PARTITION BY conv_id) AS stop FROM conversations)
    SELECT conv_id, turn, chars FROM s WHERE turn < coalesce(stop, 2147483647) AND turn < 4""",
)
def header_prefix(spark, d):
    """WN-13, SRT-04."""
    rows = table(spark, d, "conversations").withColumn("chars", F.char_length("text"))
    return S.prefix_until(rows, ["conv_id"], "turn", (F.col("role") == "assistant") & (F.col("chars") > 300), 4).select("conv_id", "turn", F.col("chars").cast("long"))


@query("option_window", "SELECT conv_id, turn, role = 'user' AND count(*) FILTER (WHERE role = 'user') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) >= 3 AS option_like FROM conversations")
def option_window(spark, d):
    """WN-18."""
    return S.option_like(table(spark, d, "conversations"), ["conv_id"], ["turn"], F.col("role") == "user").select("conv_id", "turn", "option_like")


@query(
    "or_without_alternative",
    f"SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN lead(event_id % 3) OVER w IS NULL THEN 'nothing follows' WHEN lead(event_id % 3) OVER w = event_id % 3 THEN 'twin' ELSE 'another number' END END AS or_verdict FROM events WINDOW w AS {_W}",
)
def or_without_alternative(spark, d):
    """WN-22, R18, R19."""
    return S.or_verdict(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", F.col("event_id") % 3).select("event_id", "or_verdict")


@query(
    "toc_drop",
    """SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem a WHERE l_quantity < 5 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = a.l_returnflag AND b.l_linenumber > a.l_linenumber)""",
)
def toc_drop(spark, d):
    """JN-06: empty sections stay only if their letter does not come again."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_quantity")
    return rows.withColumn("later", S.later_same(rows, ["l_orderkey"], "l_returnflag", "l_linenumber")).where("l_quantity < 5 and not later").select("l_orderkey", "l_returnflag").distinct()


@query(
    "section_letters",
    """WITH s AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'signup' THEN chr(CAST(65 + event_id % 5 AS INT)) END AS letter FROM events),
    k AS (SELECT *, last_value(letter IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last, count(letter) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS known FROM s),
    c AS (SELECT *, ascii(coalesce(last, '@')) + row_number() OVER (PARTITION BY user_id, known ORDER BY ts, event_id) - CASE WHEN known > 0 THEN 1 ELSE 0 END AS code FROM k)
    SELECT event_id, coalesce(letter, CASE WHEN code <= 72 THEN chr(CAST(code AS INT)) ELSE 'A' END) AS lettered FROM c""",
)
def section_letters(spark, d):
    """WN-20."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_type") == "signup", F.chr(F.lit(65) + F.col("event_id") % 5)).alias("letter"))
    return S.successor_letters(rows, ["user_id"], ["ts", "event_id"], "letter").select("event_id", "lettered")


@query("section_parts", f"SELECT event_id, event_type = lag(event_type) OVER w AND lag(value) OVER w > 10 AS is_part FROM events WINDOW w AS {_W}")
def section_parts(spark, d):
    """WN-21: a heading with the letter of the one right before it is another part of that section."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", ((F.col("event_type") == F.lag("event_type").over(w)) & (F.lag("value").over(w) > 10)).alias("is_part"))


@query("label_sequence", "SELECT l_orderkey, list_sort(list_distinct(list(chr(CAST(96 + l_linenumber AS INT))))) AS labels, max(l_linenumber) <> count(DISTINCT l_linenumber) AS broken FROM lineitem WHERE l_linenumber <= 8 GROUP BY 1")
def label_sequence(spark, d):
    """WN-23, R23: do sub-part labels run a, b, c, ...?"""
    from ..functions.text import list_letter

    labels = F.array_sort(F.collect_set(list_letter(F.col("l_linenumber"))))
    return table(spark, d, "lineitem").where("l_linenumber <= 8").groupBy("l_orderkey").agg(labels.alias("labels")).withColumn("broken", F.col("labels") != F.transform(F.sequence(F.lit(1), F.size("labels")), list_letter))
