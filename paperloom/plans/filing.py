"""Names free in two lists, a log of moves over events, and papers filed by a stream with state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import filing as O
from ..streaming import filing as S
from .registry import query, shared_dir, stored, table

_LISTED = """SELECT 'p' || o_custkey AS base, v FROM (SELECT DISTINCT o_custkey FROM orders), (SELECT unnest([1, 2, 3, 5]) AS v)
WHERE (v = 2 AND o_custkey % 2 = 0) OR (v = 3 AND o_custkey % 3 = 0) OR (v = 1 AND o_custkey % 5 = 0) OR (v = 5 AND o_custkey % 7 = 0)"""


@query(
    "free_names_two_lists",
    f"""WITH r AS (SELECT o_orderkey, 'p' || o_custkey AS base, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
    c AS (SELECT base, unnest(range(1, n + 5)) AS v FROM (SELECT DISTINCT base, n FROM r)), f AS (SELECT c.base, c.v, row_number() OVER (PARTITION BY c.base ORDER BY c.v) AS rn FROM c ANTI JOIN ({_LISTED}) t ON t.base = c.base AND t.v = c.v)
    SELECT o_orderkey, CASE WHEN v = 1 THEN r.base ELSE r.base || '_v' || v END AS free_name FROM r JOIN f ON f.base = r.base AND f.rn = r.rn""",
)
def free_names_two_lists(spark, d):
    """SET-04: a document's name and its review's are free at once; some versions of either are in the folder already."""
    orders = table(spark, d, "orders")
    base, k = F.concat(F.lit("p"), F.col("o_custkey").cast("string")), F.col("o_custkey")
    keys = orders.select("o_custkey").distinct()
    documents = keys.where("o_custkey % 2 = 0").select(F.concat(base, F.lit("_v2.docx")).alias("name")).unionAll(keys.where("o_custkey % 5 = 0").select(F.concat(base, F.lit(".docx"))))
    reviews = keys.where("o_custkey % 3 = 0").select(F.concat(base, F.lit("_v3_REVIEW.docx")).alias("name")).unionAll(keys.where(k % 7 == 0).select(F.concat(base, F.lit("_v5_REVIEW.docx"))))
    held = (O.held_versions(x, "name", ["_REVIEW.docx", ".docx"]) for x in (documents, reviews))
    return O.free_names(orders.withColumn("base", base), "base", ["o_orderdate", "o_orderkey"], *held).select("o_orderkey", "free_name")


@query("retired_names", "WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) SELECT o_orderkey, 'p' || o_custkey || '_REVIEW_superseded' || CASE WHEN v = 1 THEN '' ELSE '_v' || v END || '.docx' AS archived FROM (SELECT *, CASE WHEN o_custkey % 2 = 0 THEN rn + 1 WHEN o_custkey % 3 = 0 AND rn > 1 THEN rn + 1 ELSE rn END AS v FROM r)")
def retired_names(spark, d):
    """JN-05: review notes that go to the archive under a new name; some names are there."""
    orders = table(spark, d, "orders")
    name = F.concat(F.lit("p"), F.col("o_custkey").cast("string"), F.lit("_REVIEW"))
    there = orders.select("o_custkey").distinct().withColumn("n", name)
    archive = there.where("o_custkey % 2 = 0").select(F.concat("n", F.lit("_superseded.docx")).alias("name")).unionAll(there.where("o_custkey % 2 <> 0 and o_custkey % 3 = 0").select(F.concat("n", F.lit("_superseded_v2.docx")))).unionAll(there.select(F.concat("n", F.lit("_superseded_v3.pdf"))))
    return O.retired(orders.withColumn("name", F.concat(name, F.lit(".docx"))), archive, ["o_orderkey"]).select("o_orderkey", "archived")


#: Rounds of the SQL below; more change nothing on these tables.
ROUNDS = 14
_MOVES = "SELECT event_id AS t, event_id * 7 % 2003 AS file, event_type AS folder, 'n' || (event_id * 7919 % 1500) AS name FROM events"
_ROUND = """l{n} AS MATERIALIZED (SELECT *, coalesce(prev = slot, false) AS same FROM (SELECT *, (folder, name) AS slot, last_value(CASE WHEN accepted THEN (folder, name) END IGNORE NULLS) OVER (PARTITION BY file ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM a{n})),
c{n} AS (SELECT slot, t, 1 AS here FROM l{n} WHERE NOT same UNION ALL SELECT prev, t, 0 FROM l{n} WHERE accepted AND NOT same AND prev IS NOT NULL),
d{n} AS (SELECT *, sum(1 - here) OVER (PARTITION BY slot ORDER BY t) AS gone FROM c{n}),
f{n} AS (SELECT slot, t, row_number() OVER (PARTITION BY slot, gone ORDER BY t) = 1 AS first FROM d{n} WHERE here = 1),
a{m} AS MATERIALIZED (SELECT l.t, file, folder, name, coalesce(first, true) AS accepted FROM l{n} l LEFT JOIN f{n} f ON f.slot = l.slot AND f.t = l.t)"""
_SETTLED = f"WITH a0 AS (SELECT *, true AS accepted FROM ({_MOVES})), " + ", ".join(_ROUND.format(n=n, m=n + 1) for n in range(ROUNDS))


def moves(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(e.alias("t"), (e * 7 % 2003).alias("file"), F.col("event_type").alias("folder"), F.concat(F.lit("n"), (e * 7919 % 1500).cast("string")).alias("name"))


@query("moves_settled", f"{_SETTLED} SELECT t, accepted FROM a{ROUNDS}")
def moves_settled(spark, d):
    """SNK-01, SNK-02: names that another file holds at the time are refused, by arrival."""
    return O.settle(moves(spark, d), order=("t",)).select("t", "accepted")


@query(
    "held_when",
    f"""{_SETTLED}, h AS (SELECT file, folder, name, t AS since, lead(t) OVER (PARTITION BY file ORDER BY t) AS until FROM a{ROUNDS} WHERE accepted)
    SELECT o_orderkey, (SELECT max(file) FROM h WHERE h.folder = p.folder AND h.name = p.name AND h.since <= p.t AND (h.until IS NULL OR h.until > p.t)) AS holder
    FROM (SELECT o_orderkey, o_orderkey % (SELECT max(event_id) FROM events) AS t, CASE o_orderkey % 2 WHEN 0 THEN (SELECT min(event_type) FROM events) ELSE (SELECT max(event_type) FROM events) END AS folder, 'n' || (o_custkey % 1500) AS name FROM orders) p""",
)
def held_when(spark, d):
    """JN-05, SNK-02: which file had a paper's name when the paper arrived."""
    events = table(spark, d, "events").agg(F.min("event_type").alias("a"), F.max("event_type").alias("b"), F.max("event_id").alias("n"))
    papers = table(spark, d, "orders").join(F.broadcast(events)).select("o_orderkey", (F.col("o_orderkey") % F.col("n")).alias("t"), F.when(F.col("o_orderkey") % 2 == 0, F.col("a")).otherwise(F.col("b")).alias("folder"), F.concat(F.lit("n"), (F.col("o_custkey") % 1500).cast("string")).alias("name"))
    return O.held_when(papers, O.intervals(O.settle(moves(spark, d), order=("t",)), at="t"), "t").select("o_orderkey", "holder")


@query("folders_at", f"{_SETTLED}, h AS (SELECT file, folder, name, t AS since, lead(t) OVER (PARTITION BY file ORDER BY t) AS until FROM a{ROUNDS} WHERE accepted) SELECT file, folder, name FROM h WHERE since <= 5000 AND (until IS NULL OR until > 5000)")
def folders_at(spark, d):
    """SNK-02: the folders as they were at a time."""
    return O.listing_at(O.intervals(O.settle(moves(spark, d), order=("t",)), at="t"), F.lit(5000)).select("file", "folder", "name")


@query("filing_stream")
def filing_stream(spark, d):
    """STR-02, STR-03: orders of a customer as attempts at one paper, in two batches with state; tests compare with a loop."""
    k = F.col("o_orderkey")
    note = F.concat(F.lit("# Review\nSource: "), k.cast("string"), F.lit("\n\n- point "), (k % 3).cast("string"))
    papers = table(spark, d, "orders").select(F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("base"), k.cast("long").alias("at"), F.concat(k.cast("string"), F.lit(".docx")).alias("source"), (k % 5 < 3).alias("blocking"), note.alias("note"))
    root = shared_dir(spark)
    middle = papers.agg(F.expr("percentile_approx(at, 0.5)")).first()[0]
    for part, test in enumerate((F.col("at") <= middle, F.col("at") > middle)):
        papers.where(test).coalesce(4).write.parquet(f"{root}/in/part={part}")
        S.file_all(spark, f"{root}/in/part=*", papers.schema, f"{root}/log", f"{root}/out")
    return stored(spark.read.parquet(f"{root}/out/results").select("at", "source", "status", "name"))
