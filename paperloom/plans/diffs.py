"""Ordered differences between documents and edited copies: lines moved, doubled, changed and left out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import diff as D
from .registry import query, stored, table

_OLD = "SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS place FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
_NEW = f"""SELECT doc_id, CASE WHEN place % 7 = 3 THEN line || '!' ELSE line END AS line, CASE WHEN place = 0 AND doc_id % 4 = 0 THEN 1000000000 ELSE place * 2 END AS place FROM ({_OLD}) WHERE place % 13 <> 6
UNION ALL SELECT doc_id, line, place * 2 + 1 FROM ({_OLD}) WHERE place % 11 = 5"""
#: A row of the table of common lengths for each line of the old version.
_LENGTHS = f"""WITH RECURSIVE a AS (SELECT doc_id, list(line ORDER BY place) AS a FROM ({_OLD}) GROUP BY doc_id), b AS (SELECT doc_id, list(line ORDER BY place) AS b FROM ({_NEW}) GROUP BY doc_id),
t AS (SELECT doc_id, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda k: 0::BIGINT) AS r FROM a JOIN b USING (doc_id)
UNION ALL SELECT doc_id, a, b, i + 1, list_reduce(list_prepend([0::BIGINT], list_transform(range(1, len(b) + 1), lambda k: [k::BIGINT])), lambda n, e: list_append(n, CASE WHEN a[i + 1] = b[e[1]] THEN r[e[1]] + 1 ELSE greatest(r[e[1] + 1], n[-1]) END)) FROM t WHERE i < len(a))"""


def versions(spark, d):
    old = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    kept = old.where("place % 13 <> 6").select("doc_id", F.when((F.col("place") == 0) & (F.col("doc_id") % 4 == 0), 1000000000).otherwise(F.col("place") * 2).alias("place"), F.when(F.col("place") % 7 == 3, F.concat("line", F.lit("!"))).otherwise(F.col("line")).alias("line"))
    return old, kept.unionAll(old.where("place % 11 = 5").select("doc_id", F.col("place") * 2 + 1, "line"))


@query("ordered_diff")
def ordered_diff(spark, d):
    """SET-05: the script itself; there are several shortest ones, so tests compare with brute force."""
    return D.ordered_diff(*versions(spark, d), "doc_id")


@query("ordered_diff_sizes", f"{_LENGTHS} SELECT doc_id, len(a) - r[-1] AS removed, len(b) - r[-1] AS added FROM t WHERE i = len(a) AND len(a) + len(b) > 2 * r[-1]")
def ordered_diff_sizes(spark, d):
    """SET-05, SRC-14: how long the shortest script is."""
    return D.diff_sizes(D.ordered_diff(*versions(spark, d), "doc_id"), "doc_id")


@query("ordered_diff_applied", f"SELECT doc_id, md5(string_agg(line, chr(10) ORDER BY place)) AS digest FROM ({_NEW}) GROUP BY doc_id")
def ordered_diff_applied(spark, d):
    """SET-05: the old version without the removed lines, and with the added ones between those that are left, is the new one."""
    old, new = versions(spark, d)
    old = stored(old)
    script = stored(D.ordered_diff(old, new, "doc_id", anchored=True))
    return D.patched(old, script, "doc_id").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("number", "line"))).alias("l")).select("doc_id", F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("digest"))
