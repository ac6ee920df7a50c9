"""Layout queries, over boxes and pieces made from events and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import layout as L
from ..operators import pages as G
from .registry import query, table


@query(
    "width_per_line",
    """WITH w AS (SELECT p_partkey, p_name, length(p_name) AS n, length(regexp_replace(p_name, '[^iljtfrI.,;:''!|()\\[\\] ]', '', 'g')) AS narrow, length(regexp_replace(p_name, '[^mwMWQO@%]', '', 'g')) AS wide FROM part),
    t AS (SELECT *, round((narrow * 300 + wide * 850 + (n - narrow - wide) * 520) * 0.22, 2) AS width FROM w)
    SELECT p_partkey, width, CASE WHEN n <= 23 AND width <= 2400 THEN 4 WHEN p_partkey % 4 = 3 AND n <= 29 AND width <= 3240 THEN 3 WHEN n <= 46 AND width <= 4920 THEN 2 ELSE 1 END AS per_line FROM t""",
)
def width_per_line(spark, d):
    """FN-20, LAY-08, AG-18."""
    rows = table(spark, d, "part").select("p_partkey", F.round(T.text_width(F.col("p_name")), 2).alias("width"), F.char_length("p_name").alias("n"))
    return rows.select("p_partkey", "width", T.options_per_line((F.col("p_partkey") % 4), F.col("n"), F.col("width")).alias("per_line"))


@query("image_sizes", "SELECT p_partkey, CAST(floor(w * least(1.0, 500.0 / w) + 0.5) AS BIGINT) AS w, CAST(floor(h * least(1.0, 500.0 / w) + 0.5) AS BIGINT) AS h FROM (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 150.0 ELSE CAST(p_size AS DOUBLE) * 16 * 4 / 3 END AS w, CAST(p_size AS DOUBLE) * 9 * 4 / 3 AS h FROM part)")
def image_sizes(spark, d):
    """FN-21, FN-22."""
    size = T.image_size(F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("double") * 16), F.col("p_size").cast("double") * 9)
    return table(spark, d, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.w", "s.h")


_PIECES = "SELECT event_id, user_id AS page, CAST(event_id * 37 % 400 AS DOUBLE) AS x0, CAST(event_id * 53 % 700 AS DOUBLE) AS y0, CAST(event_id * 37 % 400 + 40 AS DOUBLE) AS x1, CAST(event_id * 53 % 700 + 10 AS DOUBLE) AS y1, event_type AS text FROM events"
_BOXES = "SELECT DISTINCT user_id AS page, 100.0 AS x0, 200.0 AS y0, 300.0 AS x1, 500.0 AS y1 FROM events WHERE user_id % 2 = 0"


def pieces(spark, d):
    e = F.col("event_id")
    x, y = (e * 37 % 400).cast("double"), (e * 53 % 700).cast("double")
    return table(spark, d, "events").select("event_id", F.col("user_id").alias("page"), x.alias("x0"), y.alias("y0"), (x + 40).alias("x1"), (y + 10).alias("y1"), F.col("event_type").alias("text"))


@query(
    "bbox_anti",
    f"""WITH p AS ({_PIECES}), b AS ({_BOXES}) SELECT event_id FROM p WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.page = p.page AND least(p.x1, b.x1) > greatest(p.x0, b.x0) AND least(p.y1, b.y1) > greatest(p.y0, b.y0)
    AND (least(p.x1, b.x1) - greatest(p.x0, b.x0)) * (least(p.y1, b.y1) - greatest(p.y0, b.y0)) > 200)""",
)
def bbox_anti(spark, d):
    """JN-08."""
    boxes = table(spark, d, "events").where("user_id % 2 = 0").select(F.col("user_id").alias("page")).distinct().select("page", F.lit(100.0).alias("x0"), F.lit(200.0).alias("y0"), F.lit(300.0).alias("x1"), F.lit(500.0).alias("y1"))
    return L.outside_boxes(pieces(spark, d), boxes, "page").select("event_id")


@query("page_numbers", f"SELECT event_id FROM ({_PIECES}) WHERE NOT (event_id % 3 = 0 AND (y0 < 50 OR y1 > 750))")
def page_numbers(spark, d):
    """FLT-06."""
    rows = pieces(spark, d).withColumn("text", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Page "), (F.col("event_id") % 90 + 1).cast("string"))).otherwise(F.col("text")))
    return L.without_page_numbers(rows, F.lit(800.0)).select("event_id")


#: The first piece beyond each place's tolerance (places are whole points), and from each page's first piece on the anchors that follow one another.
_ANCHORS = """p AS (SELECT * FROM ({pieces})), n AS (SELECT DISTINCT page, y0, min(y0) OVER (PARTITION BY page ORDER BY y0 RANGE BETWEEN {beyond} FOLLOWING AND UNBOUNDED FOLLOWING) AS following FROM p),
r AS (SELECT page, 0 AS no, min(y0) AS anchor FROM p GROUP BY page UNION ALL SELECT r.page, no + 1, following FROM r JOIN n ON n.page = r.page AND n.y0 = r.anchor WHERE following IS NOT NULL),
g AS (SELECT p.*, r.no FROM p JOIN (SELECT *, lead(anchor) OVER (PARTITION BY page ORDER BY no) AS till FROM r) r ON p.page = r.page AND p.y0 >= anchor AND (till IS NULL OR p.y0 < till))"""
_ROWS = _ANCHORS.format(pieces=_PIECES, beyond=4) + """, t AS (SELECT *, x0 - lag(x1) OVER (PARTITION BY page, no ORDER BY x0, x1, y1, text, event_id) AS gap FROM g),
o AS (SELECT page, no AS row_no, min(y0) AS y0, min(x0) AS x0, max(x1) AS x1, max(y1) AS y1, string_agg(CASE WHEN gap IS NULL THEN '' WHEN gap > 14 THEN chr(9) ELSE ' ' END || text, '' ORDER BY x0, x1, y1, text, event_id) AS text FROM t GROUP BY page, no)"""


@query("row_group", f"WITH RECURSIVE {_ROWS} SELECT * FROM o")
def row_group(spark, d):
    """WN-05: anchored on a row's first piece."""
    return G.rows_of_pieces(pieces(spark, d), "page")


_LINES = _ROWS + """, w AS (SELECT page, row_no, 0 AS line_no, x0, x1, y1, text FROM o WHERE row_no = 0 UNION ALL
SELECT page, row_no, CASE WHEN mark OR wrapped THEN line_no ELSE line_no + 1 END, CASE WHEN mark OR wrapped THEN lx0 ELSE x0 END, CASE WHEN mark THEN lx1 WHEN wrapped THEN greatest(lx1, x1) ELSE x1 END, y1, CASE WHEN mark THEN ltext || chr(9) || text WHEN wrapped THEN ltext || ' ' || text ELSE text END
FROM (SELECT o.*, line_no, w.x0 AS lx0, w.x1 AS lx1, w.text AS ltext, regexp_matches(o.text, '(?i)^\\s*(\\d+\\s*M(arks?)?|\\[\\d+\\])\\s*$') AND o.y0 - w.y1 < 8 AS mark,
  w.x1 >= 60 AND NOT regexp_matches(o.text, '(?i)^\\s*(\\d+[.)]|OR\\b|Section\\b|Note)') AND NOT regexp_matches(w.text, '(?i)^\\s*(Section\\b|Date\\s*:|OR\\s*$)') AND o.y0 - w.y1 < 6 AND o.x0 - w.x0 BETWEEN -12 AND 24 AND w.x0 < 60 AND NOT regexp_matches(w.text, '\\d\\s*M\\s*$') AS wrapped
  FROM w JOIN o ON o.page = w.page AND o.row_no = w.row_no + 1))"""
_KINDS = ["Explain why", "the sky 5", "M", "3M", "Section B", "OR", "2. Next", "[4]", " ", "note it"]


@query("wrapped_lines", f"WITH RECURSIVE {_LINES.replace(_PIECES, 'SELECT event_id, user_id AS page, CAST(event_id * 37 % 60 AS DOUBLE) AS x0, CAST(event_id * 53 % 700 AS DOUBLE) AS y0, CAST(event_id * 37 % 60 + 40 AS DOUBLE) AS x1, CAST(event_id * 53 % 700 + 10 AS DOUBLE) AS y1, ' + str(_KINDS) + '[event_id % 10 + 1] AS text FROM events')} SELECT page, line_no, last(text ORDER BY row_no) AS text FROM w GROUP BY page, line_no")
def wrapped_lines(spark, d):
    """WN-07: each join decides the next; texts of all kinds that matter."""
    e = F.col("event_id")
    kinds = F.array(*map(F.lit, _KINDS))
    rows = pieces(spark, d).select("page", (e * 37 % 60).cast("double").alias("x0"), "y0", (e * 37 % 60 + 40).cast("double").alias("x1"), "y1", F.get(kinds, (e % 10).cast("int")).alias("text"))
    return G.join_wrapped(G.rows_of_pieces(rows, "page"), "page", right=60.0, left=0.0).select("page", "line_no", "text")


_A, _B = "(o_custkey % 89 + 1)", "(o_orderkey % 97 + 2)"
_FRACTIONS = f"""SELECT o_orderkey AS page, unnest(CASE o_orderkey % 7
  WHEN 0 THEN ['a) Simplify ' || {_A} || '/' || {_B} || ' to its lowest form.'] WHEN 1 THEN ['Add ' || {_A} || '/' || {_B} || ' and 5 kg'] WHEN 2 THEN ['Add ' || {_A}, {_B}::VARCHAR] WHEN 3 THEN [{_A} || '/' || {_B}]
  WHEN 4 THEN [{_A}::VARCHAR, {_B}::VARCHAR] WHEN 5 THEN ['Find ' || {_A} || '/' || {_B} || '  of 8/9'] ELSE ['x ' || {_A} || '/' || {_B} || chr(9) || '7/8 y'] END) AS text FROM orders"""


def printed(spark, d):
    """Lines as a page prints them: by the order's key a number above, below or far from another."""
    k = F.col("o_orderkey")
    a, b = (F.col("o_custkey") % 89 + 1).cast("string"), (k % 97 + 2).cast("string")
    span = lambda text, x0, x1: F.struct((F.lit(text) if isinstance(text, str) else text).alias("text"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit(False).alias("sup"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"))
    line = lambda y0, y1, *spans: F.struct(F.lit(float(y0)).alias("y0"), F.lit(float(y1)).alias("y1"), F.array(*spans).alias("spans"))
    number = [
        F.array(line(96, 104, span(a, 110, 116)), line(100, 111, span("a) Simplify", 40, 104)), line(107, 116, span(b, 109, 117)), line(107, 118, span("to its lowest form.", 125, 200))),
        F.array(line(100, 108, span("Add ", 40, 60), span(a, 62, 68), span(" and 5 kg", 70, 110)), line(112, 120, span(b, 61, 69))),
        F.array(line(100, 108, span("Add ", 40, 60), span(a, 62, 68)), line(112, 120, span(b, 90, 98))),
        F.array(line(100, 108, span(a, 62, 68)), line(118, 126, span(b, 63, 69))),
        F.array(line(100, 108, span(a, 62, 68)), line(121, 129, span(b, 63, 69))),
        F.array(line(100, 108, span("Find ", 40, 60), span(a, 62, 68)), line(112, 120, span(b, 61, 69), span(" of ", 72, 80), span("8", 82, 86)), line(122, 130, span("9", 82, 86))),
        F.array(line(100, 108, span("x ", 50, 60), span(a, 62, 68)), line(100, 108, span("7", 90, 94), span(" y", 96, 99)), line(112, 120, span(b, 61, 69)), line(123, 130, span("8", 90, 95))),
    ]
    lines = F.explode(F.element_at(F.array(*number), (k % 7 + 1).cast("int"))).alias("l")
    rows = table(spark, d, "orders").select(k.alias("page"), lines).select("page", "l.y0", "l.y1", "l.spans")
    return rows.select("page", F.get("spans", F.lit(0))["x0"].alias("x0"), "y0", F.array_max(F.transform("spans", lambda s: s["x1"])).alias("x1"), "y1", F.array_join(F.transform("spans", lambda s: s["text"]), "").alias("text"), "spans")


@query("inline_fractions", _FRACTIONS)
def inline_fractions(spark, d):
    """JN-09, WN-25, SNK-12: numbers over one another within lines, one or two rows on, and the rest of the lower row behind them."""
    rows = G.rows_of_pieces(printed(spark, d), "page")
    return G.inline_fractions(rows, "page").select("page", "text")


@query(
    "stacked_fractions",
    """WITH p AS (SELECT o_custkey AS page, o_orderkey AS k, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) * 10 AS DOUBLE) AS y0, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE CAST(o_orderkey % 10 AS VARCHAR) END AS text FROM orders),
    o AS (SELECT *, coalesce(regexp_matches(text, '^[0-9]+$') AND regexp_matches(lead(text) OVER w, '^[0-9]+$'), false) AS over, lead(text) OVER w AS below FROM p WINDOW w AS (PARTITION BY page ORDER BY y0)),
    t AS (SELECT *, coalesce(lag(over) OVER (PARTITION BY page ORDER BY y0), false) AS taken FROM o)
    SELECT page, k, CASE WHEN over THEN text || '/' || below ELSE text END AS text FROM t WHERE NOT taken OR over""",
)
def stacked_fractions(spark, d):
    """JN-09, WN-25."""
    from pyspark.sql import Window

    y = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) * 10.0
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("k"), y.alias("y0"), F.lit(10.0).alias("x0"), F.lit(16.0).alias("x1"), F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise((F.col("o_orderkey") % 10).cast("string")).alias("text"))
    return L.stacked_fractions(rows, "page").select("page", "k", "text")


@query("table_candidates", "SELECT p_partkey FROM part WHERE p_size * 40.0 >= 400 AND 2 + p_partkey % 3 >= 2 AND p_partkey % 5 >= 2 AND p_size * 40.0 <= 0.35 * 5000 AND p_partkey % 7 >= greatest(2, floor((p_partkey % 5) / 2)) AND p_partkey % 200 <= 120")
def table_candidates(spark, d):
    """FLT-07."""
    k = F.col("p_partkey")
    return table(spark, d, "part").where(L.good_table(F.col("p_size") * 40.0, F.lit(5000.0), 2 + k % 3, k % 5, k % 7, k % 200)).select("p_partkey")
