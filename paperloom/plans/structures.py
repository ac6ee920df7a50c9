"""Queries of document parts, over lines of orders and events of users."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rules as R
from ..operators import structures as S
from ..sources.write_docx import to_docx
from ..operators.pages import side_by_side as side_by_side_groups
from .layouts import _ANCHORS, _PIECES, pieces
from .registry import query, table

_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query("picture_bytes", "SELECT o_orderkey, n_name AS data FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 3 <> 0 LEFT JOIN nation ON n_nationkey = c_nationkey AND n_nationkey % 2 = 0")
def picture_bytes(spark, d):
    """JN-01."""
    refs = table(spark, d, "orders").select("o_orderkey", F.lit(1).alias("paper"), F.col("o_custkey").alias("rid"))
    rels = table(spark, d, "customer").where("c_custkey % 3 <> 0").select(F.lit(1).alias("paper"), F.col("c_custkey").alias("rid"), F.col("c_nationkey").alias("target"))
    media = table(spark, d, "nation").where("n_nationkey % 2 = 0").select(F.lit(1).alias("paper"), F.col("n_nationkey").alias("target"), F.col("n_name").alias("data"))
    return S.picture_bytes(refs, rels, media, "paper").select("o_orderkey", "data")


@query("inherited_styles", "SELECT a.o_orderkey AS style, coalesce(CASE WHEN a.o_orderkey % 2 = 0 THEN a.o_custkey END, CASE WHEN b.o_orderkey % 2 = 0 THEN b.o_custkey END) AS num FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey // 3")
def inherited_styles(spark, d):
    """JN-02, JN-03."""
    styles = table(spark, d, "orders").select(F.lit(1).alias("paper"), F.col("o_orderkey").alias("style"), F.floor(F.col("o_orderkey") / 3).alias("based_on"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("num"))
    return S.inherited_styles(styles, "paper").select("style", "num")


@query(
    "list_counters",
    f"""WITH r AS (SELECT user_id, event_id, ts, event_id % 3 AS lv, count(*) FILTER (WHERE event_id % 3 < 1) OVER {_W} AS r1, count(*) FILTER (WHERE event_id % 3 < 2) OVER {_W} AS r2 FROM events)
    SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, lv, CASE lv WHEN 0 THEN 0 WHEN 1 THEN r1 ELSE r2 END ORDER BY ts, event_id) AS INT) AS counter FROM r""",
)
def list_counters(spark, d):
    """WN-04."""
    rows = table(spark, d, "events").withColumn("level", (F.col("event_id") % 3).cast("int"))
    return S.list_counters(rows, ["user_id"], ["ts", "event_id"], "level").select("event_id", "counter")


@query("placeholder_images", f"WITH r AS (SELECT *, sum(event_id % 3) OVER {_W} AS s FROM events) SELECT event_id, list_transform(range(CAST(s - event_id % 3 + 1 AS BIGINT), CAST(s + 1 AS BIGINT)), lambda k: 'img' || k) AS line_images FROM r")
def placeholder_images(spark, d):
    """JN-12."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", F.repeat(F.lit("a￼"), (F.col("event_id") % 3).cast("int")).alias("text"))
    # a user's pictures: as many as their lines call for, and two that no line takes
    pictures = table(spark, d, "events").groupBy("user_id").agg((F.sum(F.col("event_id") % 3) + 2).alias("n")).select("user_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("place"))
    pictures = pictures.withColumn("image", F.concat(F.lit("img"), F.col("place").cast("string")))
    return S.placeholder_images(rows, pictures, ["user_id"], ["ts", "event_id"], "text", "place", "image").select("event_id", "line_images")


_RUN = "SELECT l_orderkey, l_linenumber, chr(CAST(96 + l_linenumber AS INT)) AS label, max(CASE WHEN l_partkey % 5 = 0 THEN l_quantity END) AS marks FROM lineitem GROUP BY 1, 2"


@query(
    "option_runs",
    f"""WITH s AS ({_RUN}), f AS (SELECT *, CASE WHEN ascii(label) = ascii(lag(label) OVER w) + 1 AND marks IS NULL AND lag(marks) OVER w IS NULL THEN 0 ELSE 1 END AS st FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
    r AS (SELECT *, sum(st) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM f)
    SELECT l_orderkey, l_linenumber, min(label) OVER (PARTITION BY l_orderkey, run) = 'a' AND count(*) OVER (PARTITION BY l_orderkey, run) >= 3 AND marks IS NULL AS is_option FROM r""",
)
def option_runs(spark, d):
    """WN-09, WN-10."""
    subs = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max(F.when(F.col("l_partkey") % 5 == 0, F.col("l_quantity"))).alias("marks")).withColumn("label", T.list_letter(F.col("l_linenumber")))
    return S.option_runs(subs, ["l_orderkey"], ["l_linenumber"], "label", "marks").select("l_orderkey", "l_linenumber", "is_option")


@query(
    "label_with_next",
    f"""WITH c AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 3 = 0 THEN 'a)' ELSE event_type END AS text, event_id % 3 = 0 AS lone FROM events),
    t AS (SELECT *, coalesce(lone AND NOT lead(lone) OVER {_W}, false) AS takes, lead(text) OVER {_W} AS nx FROM c), u AS (SELECT *, coalesce(lag(takes) OVER {_W}, false) AS used FROM t)
    SELECT event_id, CASE WHEN takes THEN text || ' ' || nx ELSE text END AS text FROM u WHERE NOT used""",
)
def label_with_next(spark, d):
    """JN-15, JN-16."""
    rows = table(spark, d, "events").select("user_id", "event_id", "ts", F.when(F.col("event_id") % 3 == 0, "a)").otherwise(F.col("event_type")).alias("text"))
    return S.label_with_next(rows, ["user_id"], ["ts", "event_id"], "text").select("event_id", "text")


@query("bold_cleared", "SELECT p_partkey, length(p_name) - length(replace(p_name, ' ', '')) >= 0 AND p_size % 2 = 0 AND (length(replace(p_name, ' ', '')) < 0.9 * (length(replace(p_name, ' ', '')) + p_size)) AS bold FROM part")
def bold_cleared(spark, d):
    """AG-08."""
    runs = F.array(F.struct(F.col("p_name").alias("text"), (F.col("p_size") % 2 == 0).alias("bold")), F.struct(F.repeat(F.lit("x"), F.col("p_size")).alias("text"), F.lit(False).alias("bold")))
    return table(spark, d, "part").select("p_partkey", F.get(S.bold_cleared(runs), F.lit(0))["bold"].alias("bold"))


@query(
    "ordered_distinct",
    """WITH f AS (SELECT l_orderkey, l_partkey % 9 AS v, min(l_linenumber * 1000000 + l_partkey) AS pos FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, list_slice(list(CAST(v AS VARCHAR) ORDER BY pos), 1, 3) AS shown, CAST(greatest(count(*) - 3, 0) AS INT) AS more FROM f GROUP BY 1""",
)
def ordered_distinct(spark, d):
    """AG-12, SRT-04, PRJ-12."""
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_partkey") % 9).cast("string").alias("v"), (F.col("l_linenumber") * 1_000_000 + F.col("l_partkey")).alias("at"))
    return S.ordered_distinct(rows, "l_orderkey", "at", "v", most=3)


@query("entry_contents", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS images, count(*) FILTER (WHERE event_type = 'view') AS tables, CAST(coalesce(sum(CASE WHEN event_type = 'purchase' THEN event_id % 5 END), 0) AS BIGINT) AS options, bool_or(event_type IN ('click', 'view')) AS has_figure FROM events GROUP BY 1")
def entry_contents(spark, d):
    """AG-13, AG-14."""
    kind = F.when(F.col("event_type") == "click", "image").when(F.col("event_type") == "view", "table").when(F.col("event_type") == "purchase", "opts").otherwise("stem")
    return S.entry_contents(table(spark, d, "events").select("user_id", kind.alias("item"), (F.col("event_id") % 5).alias("n_options")), ["user_id"])


@query(
    "header_findings",
    """WITH h AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'VII' ELSE 'X' END AS cls, CASE WHEN c_custkey % 3 = 0 THEN 'Maths' ELSE 'Science' END AS subject, CASE WHEN c_custkey % 4 = 0 THEN 'Annual Exam' ELSE 'Half Yearly' END AS exam,
      CASE WHEN c_custkey % 5 = 0 THEN '____' WHEN c_custkey % 5 = 1 THEN '' ELSE '1/2/2026' END AS date, c_custkey % 6 = 0 AS no_marks FROM customer)
    SELECT c_custkey, rule FROM (SELECT c_custkey, 'R11' AS rule FROM h WHERE exam = 'Annual Exam' UNION ALL SELECT c_custkey, 'R13' FROM h WHERE cls = 'X' UNION ALL SELECT c_custkey, 'R14' FROM h WHERE subject = 'Maths'
      UNION ALL SELECT c_custkey, 'R15a' FROM h WHERE no_marks UNION ALL SELECT c_custkey, 'R15b' FROM h WHERE date = '' UNION ALL SELECT c_custkey, 'R15c' FROM h UNION ALL SELECT c_custkey, 'R15e' FROM h WHERE cls = 'X' UNION ALL SELECT c_custkey, 'R16' FROM h WHERE date = '____')""",
)
def header_findings(spark, d):
    """R11-R16, FLT-16."""
    k = F.col("c_custkey")
    h = table(spark, d, "customer").select("c_custkey", F.when(k % 2 == 0, "VII").otherwise("X").alias("cls"), F.when(k % 3 == 0, "Maths").otherwise("Science").alias("subject"), F.when(k % 4 == 0, "Annual Exam").otherwise("Half Yearly").alias("exam"), F.when(k % 5 == 0, "____").when(k % 5 == 1, "").otherwise("1/2/2026").alias("date"), F.lit("").alias("time"), F.when(k % 6 != 0, 80).alias("marks"), F.lit(None).cast("boolean").alias("roll_no"), T.file_name_parts(F.lit("Science_7_HYE_2026-27.docx")).alias("file"))
    return R.findings(h, "c_custkey", S.header_rules(h)).select("c_custkey", "rule")


@query("change_log", "SELECT p_partkey, concat_ws('; ', CASE WHEN p_size % 3 > 0 THEN (p_size % 3) || ' pictures carried over' END, CASE WHEN p_size % 2 > 0 THEN (p_size % 2) || ' tables re-laid' END) AS changes FROM part")
def change_log(spark, d):
    """R34-R37."""
    stats = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 3).alias("a"), (F.col("p_size") % 2).alias("b"))
    return S.change_log(stats, "p_partkey", {"a": "pictures carried over", "b": "tables re-laid"})


@query("new_uploads", "SELECT o_orderkey, o_custkey % 4 <> 0 OR o_orderkey % 2 = 1 AS filed FROM orders")
def new_uploads(spark, d):
    """SNK-01, SNK-02: a name that the folder holds is refused."""
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("folder"), F.col("o_orderkey").alias("name"))
    filed, refused = S.new_uploads(rows, rows.where("folder = 0 and name % 2 = 0").select("folder", "name"), "folder", "name")
    return filed.select("o_orderkey", F.lit(True).alias("filed")).unionByName(refused.select("o_orderkey", F.lit(False).alias("filed")))


@query("docx_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS paper_id, 2 AS paragraphs, 'Section A' || chr(10) || '1. ' || c_name || ' & <co>' || chr(9) || '5M' AS text FROM customer")
def docx_round_trip(spark, d):
    """SNK-05, SRC-03: Word files are written and read back."""
    from ..sources.docx import read_blocks

    one = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("paper_id"), "c_name")
    plan = one.select("paper_id", F.lit(1).alias("seq"), F.lit("heading").alias("style"), F.lit(0).alias("indent"), F.lit(True).alias("keep_next"), F.lit("Section A").alias("text")).unionByName(
        one.select("paper_id", F.lit(2).alias("seq"), F.lit("question").alias("style"), F.lit(360).alias("indent"), F.lit(False).alias("keep_next"), F.concat(F.lit("1. "), "c_name", F.lit(" & <co>\t5M")).alias("text"))
    )
    blocks = read_blocks(to_docx(plan).select(F.col("paper_id").alias("path"), "content"))
    return blocks.groupBy("paper_id").agg(F.count("*").cast("int").alias("paragraphs"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_pos", "text"))), lambda x: x["text"]), "\n").alias("text"))


@query("only_named", "SELECT o_orderkey FROM orders WHERE 'paper' || o_custkey = 'paper7'")
def only_named(spark, d):
    """FLT-02."""
    return table(spark, d, "orders").where(F.concat(F.lit("paper"), F.col("o_custkey").cast("string")) == "paper7").select("o_orderkey")


@query("side_by_side", f"WITH RECURSIVE {_ANCHORS.format(pieces=_PIECES, beyond=5)} SELECT page, no AS group_no, string_agg(event_id, ',' ORDER BY y0, x0, y1, event_id) AS ids FROM g GROUP BY page, no")
def side_by_side(spark, d):
    """WN-17: groups hang on their first picture; all are ten points high here."""
    groups = side_by_side_groups(pieces(spark, d).select("page", "x0", "y0", "y1", F.col("event_id").alias("id")), "page")
    return groups.withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("shown_and_rest", "WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS no, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, CAST(no AS INT) AS no, CASE WHEN no <= 10 THEN event_type ELSE (n - 10) || ' more' END AS line FROM r WHERE no <= 11")
def shown_and_rest(spark, d):
    """SRT-05."""
    return S.shown_and_rest(table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("line")), "user_id", "event_id", 10)


_PARTS = "SELECT p_partkey, p_partkey % 4 AS subs, p_partkey % 3 AS subs_marked, p_partkey % 5 = 0 AS has_or, CASE WHEN p_partkey % 2 = 0 THEN p_size END AS or_mark, p_partkey % 7 AS stated, p_partkey % 6 AS found FROM part"


@query(
    "part_marks_findings",
    f"""WITH q AS ({_PARTS}) SELECT p_partkey, 'R06' AS rule, 'heading says ' || stated || ' questions, paper has ' || found AS message FROM q WHERE stated <> found
    UNION ALL SELECT p_partkey, 'R07', 'mark shown on some parts only' FROM q WHERE subs_marked > 0 AND subs_marked < subs AND NOT has_or UNION ALL SELECT p_partkey, 'R08', 'the mark sits on the OR line' FROM q WHERE has_or AND or_mark IS NOT NULL""",
)
def part_marks_findings(spark, d):
    """R06-R08."""
    k = F.col("p_partkey")
    q = table(spark, d, "part").select("p_partkey", (k % 4).alias("subs"), (k % 3).alias("subs_marked"), (k % 5 == 0).alias("has_or"), F.when(k % 2 == 0, F.col("p_size")).alias("or_mark"), (k % 7).alias("stated"), (k % 6).alias("found"))
    return R.findings(q, "p_partkey", S.part_marks_rules(q)).select("p_partkey", "rule", "message")


@query("broken_lines", "WITH l AS (SELECT doc_id, generate_subscripts(s, 1) AS no, unnest(s) AS line FROM (SELECT doc_id, string_split(text, ', ') AS s FROM documents)), n AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY no) AS nx FROM l) SELECT doc_id, count(*) AS broken FROM n WHERE regexp_matches(line, '[A-Za-z,;]$') AND regexp_matches(nx, '^[a-z]') GROUP BY 1")
def broken_lines(spark, d):
    """FN-19."""
    from pyspark.sql import Window

    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", ", ")).alias("no", "line"))
    nxt = F.lead("line").over(Window.partitionBy("doc_id").orderBy("no"))
    return lines.withColumn("nx", nxt).where(S.fragment(F.col("line"), F.col("nx"))).groupBy("doc_id").agg(F.count("*").alias("broken"))


@query("conversion_stats", "SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS paragraphs, count(*) FILTER (WHERE event_type = 'click') AS images, count(*) FILTER (WHERE event_type = 'purchase') AS tables, count(DISTINCT event_id % 7) AS pages FROM events GROUP BY 1")
def conversion_stats(spark, d):
    """AG-20."""
    kind = F.col("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(kind == "view").alias("paragraphs"), F.count_if(kind == "click").alias("images"), F.count_if(kind == "purchase").alias("tables"), F.count_distinct(F.col("event_id") % 7).alias("pages"))
