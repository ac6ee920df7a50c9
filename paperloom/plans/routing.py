"""Routing queries: orders stand for papers of a customer (owner), pages for files in an inbox."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import routing as R
from ..operators.filing import free_names
from .registry import query, table

_FILES = """SELECT page_id AS id, 'f' || page_id || CASE page_id % 5 WHEN 0 THEN '.DOCX' WHEN 1 THEN '.pdf' WHEN 2 THEN '.doc' WHEN 3 THEN '.png' ELSE '' END AS name,
  CASE WHEN page_id % 10 = 4 THEN 'application/pdf' ELSE 'application/octet-stream' END AS mime, length(html) AS size FROM pages"""


def files(spark, d):
    k = F.col("page_id") % 5
    name = F.concat(F.lit("f"), F.col("page_id").cast("string"), F.when(k == 0, ".DOCX").when(k == 1, ".pdf").when(k == 2, ".doc").when(k == 3, ".png").otherwise(""))
    return table(spark, d, "pages").select(F.col("page_id").alias("id"), name.alias("name"), F.when(F.col("page_id") % 10 == 4, "application/pdf").otherwise("application/octet-stream").alias("mime"), F.char_length("html").cast("long").alias("size"))


_PAPER = "(regexp_matches(lower(name), '\\.(docx?|pdf)$') OR mime IN ('application/pdf', 'application/msword'))"


@query("inbox_papers", f"SELECT * FROM ({_FILES}) WHERE {_PAPER}")
def inbox_papers(spark, d):
    """FLT-01, SRC-13."""
    return R.split_inbox(files(spark, d))[0]


@query("inbox_others", f"SELECT * FROM ({_FILES}) WHERE NOT {_PAPER}")
def inbox_others(spark, d):
    """SET-01."""
    return R.split_inbox(files(spark, d))[1]


@query("pending_counts", f"SELECT count(*) AS papers, count(*) FILTER (WHERE name LIKE '%.doc') AS doc, count(*) FILTER (WHERE name LIKE '%.pdf' OR mime = 'application/pdf') AS pdf FROM ({_FILES}) WHERE {_PAPER}")
def pending_counts(spark, d):
    """SNK-11."""
    return inbox_papers(spark, d).agg(F.count("*").alias("papers"), F.count_if(F.col("name").endswith(".doc")).alias("doc"), F.count_if(F.col("name").endswith(".pdf") | (F.col("mime") == "application/pdf")).alias("pdf"))


@query("listing_lines", f"SELECT id, row_number() OVER (ORDER BY size DESC, id) <= 20 AS shown, rpad(name, 12, ' ') || lpad(size || ' ch', 10, ' ') AS line, CASE WHEN name LIKE '%.DOCX' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' WHEN name LIKE '%.pdf' THEN 'application/pdf' WHEN name LIKE '%.doc' THEN 'application/msword' ELSE 'application/octet-stream' END AS mime FROM ({_FILES})")
def listing_lines(spark, d):
    """SNK-10, SRT-01, FN-26: the twenty largest are shown."""
    rows = files(spark, d)
    top = rows.orderBy(F.desc("size"), "id").limit(20).select("id", F.lit(True).alias("s"))
    out = rows.join(F.broadcast(top), "id", "left")
    return out.select("id", F.coalesce("s", F.lit(False)).alias("shown"), F.concat(F.rpad("name", 12, " "), F.lpad(F.concat(F.col("size").cast("string"), F.lit(" ch")), 10, " ")).alias("line"), T.mime_type(F.col("name")).alias("mime"))


_NAME = "['Maths','Science','English'][CAST(o_orderkey % 3 + 1 AS INT)] || '_' || ['VII','X','13','LKG'][CAST(o_custkey % 4 + 1 AS INT)] || '_HYE' || CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE '_2026-27' END"


def _name():
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))
    return F.concat(pick(["Maths", "Science", "English"], F.col("o_orderkey") % 3), F.lit("_"), pick(["VII", "X", "13", "LKG"], F.col("o_custkey") % 4), F.lit("_HYE"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise("_2026-27"))


@query("name_parts", f"SELECT o_orderkey, split_part(n, '_', 1) AS subject, split_part(n, '_', 2) AS cls, split_part(n, '_', 3) AS exam, split_part(n, '_', 4) AS session FROM (SELECT o_orderkey, {_NAME} AS n FROM orders)")
def name_parts(spark, d):
    """PRJ-04."""
    return table(spark, d, "orders").select("o_orderkey", R.name_parts(_name()).alias("p")).select("o_orderkey", "p.*")


@query("class_folder", f"SELECT o_orderkey, CASE WHEN split_part(n, '_', 2) IN ('VII', 'X') AND folder <> 'inbox' THEN folder || '/Class-' || split_part(n, '_', 2) ELSE folder END AS dest FROM (SELECT o_orderkey, {_NAME} AS n, CASE o_orderstatus WHEN 'F' THEN 'formatted' WHEN 'O' THEN 'needsfixes' ELSE 'inbox' END AS folder FROM orders)")
def class_folder(spark, d):
    """PRJ-05."""
    folder = F.when(F.col("o_orderstatus") == "F", "formatted").when(F.col("o_orderstatus") == "O", "needsfixes").otherwise("inbox")
    return table(spark, d, "orders").select("o_orderkey", R.destination(folder, _name()).alias("dest"))


@query("canonical_name", "SELECT o_orderkey, ['Maths','SocialScience','Paper'][CAST(o_orderkey % 3 + 1 AS INT)] || '_' || CASE WHEN o_custkey % 2 = 0 THEN 'VII' ELSE 'Class' END || '_HYE_2026-27' || CASE WHEN o_orderkey % 4 = 0 THEN '_v2' ELSE '' END AS name FROM orders")
def canonical_name(spark, d):
    """PRJ-09, FN-09, FN-10."""
    subject = F.element_at(F.array(F.lit("Maths Std"), F.lit("Social Studies"), F.lit("(x) 12")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    version = T.file_name_parts(F.concat(F.lit("A_VII_HYE_2026-2027"), F.when(F.col("o_orderkey") % 4 == 0, "_v2").otherwise(""), F.lit(".docx")))
    return table(spark, d, "orders").select("o_orderkey", T.canonical_name(subject, F.when(F.col("o_custkey") % 2 == 0, "VII").otherwise(""), F.lit("HYE"), F.lit("2026-2027"), version["version"]).alias("name"))


@query("free_name", "WITH r AS (SELECT o_orderkey, 'paper' || o_custkey AS base, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) SELECT o_orderkey, CASE WHEN rn = 1 THEN base ELSE base || '_v' || rn END AS free_name FROM r")
def free_name(spark, d):
    """SET-04, SRT-02."""
    rows = table(spark, d, "orders").withColumn("base", F.concat(F.lit("paper"), F.col("o_custkey").cast("string")))
    return free_names(rows, "base", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "free_name")


@query("free_name_taken", "WITH r AS (SELECT o_orderkey, 'paper' || o_custkey AS base, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders), v AS (SELECT *, rn + CASE WHEN o_custkey % 2 = 0 AND rn >= 2 THEN 1 ELSE 0 END AS version FROM r) SELECT o_orderkey, CASE WHEN version = 1 THEN base ELSE base || '_v' || version END AS free_name FROM v")
def free_name_taken(spark, d):
    """SET-04: with version 2 of every other name in the folder already."""
    base = F.concat(F.lit("paper"), F.col("o_custkey").cast("string"))
    rows = table(spark, d, "orders").withColumn("base", base)
    taken = rows.where("o_custkey % 2 = 0").select("base", F.lit(2).alias("version")).distinct()
    return free_names(rows, "base", ["o_orderdate", "o_orderkey"], taken).select("o_orderkey", "free_name")


@query("superseded", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 1 AS superseded FROM orders")
def superseded(spark, d):
    """STR-03."""
    return R.latest(table(spark, d, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_orderkey", "superseded")


@query("superseded_notes", "SELECT c_custkey, o_orderkey AS file_id FROM customer JOIN orders ON o_orderkey = c_custkey * 3")
def superseded_notes(spark, d):
    """JN-05, FN-31: a note names its source file; the listing may hold it again."""
    note = F.concat(F.lit("# Review\nSource: paper_"), (F.col("c_custkey") * 3).cast("string"), F.lit(".docx\n\n## Marks\n"))
    notes = table(spark, d, "customer").select("c_custkey", T.source_file(note).alias("source"))
    listed = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("paper_"), F.col("o_orderkey").cast("string"), F.lit(".docx")).alias("name"))
    return R.superseded_notes(notes, listed).select("c_custkey", "file_id")


@query("name_taken_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def name_taken_semi(spark, d):
    """JN-04."""
    listing = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.taken_names(table(spark, d, "customer").select("c_custkey"), listing, "c_custkey")


@query("name_free_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def name_free_anti(spark, d):
    listing = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.taken_names(table(spark, d, "customer").select("c_custkey"), listing, "c_custkey", taken=False)


@query("files_in_tree", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey IN (1, 2) OR (n_regionkey = 2 AND n_name LIKE 'N%')")
def files_in_tree(spark, d):
    """JN-14: a file's parent, or its class folder's parent, is a pipeline folder."""
    folders = table(spark, d, "nation").select(F.col("n_nationkey").alias("folder_id"), F.col("n_regionkey").alias("parent_id"), F.col("n_name").alias("name"))
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("parent"))
    return R.in_tree(rows, F.broadcast(folders), F.col("parent").isin(1, 2) | ((F.col("grandparent") == 2) & F.col("folder_name").startswith("N"))).select("c_custkey")


_STATUS = "CASE WHEN o_orderkey % 11 = 0 THEN 'error' WHEN o_orderkey % 7 = 0 THEN 'unreadable' WHEN o_orderkey % 5 = 0 THEN 'recovered' WHEN o_totalprice > 200000 THEN 'needs-fixes' ELSE 'formatted' END"


def _status():
    k = F.col("o_orderkey")
    return F.when(k % 11 == 0, "error").when(k % 7 == 0, "unreadable").when(k % 5 == 0, "recovered").when(F.col("o_totalprice") > 200000, "needs-fixes").otherwise("formatted")


@query("run_summary", f"SELECT count(*) AS processed, count(*) FILTER (WHERE s = 'formatted') AS formatted, count(*) FILTER (WHERE s = 'needs-fixes') AS needs_fixes, count(*) FILTER (WHERE s = 'recovered') AS recovered, count(*) FILTER (WHERE s = 'unreadable') AS unreadable, count(*) FILTER (WHERE s = 'error') AS errors FROM (SELECT {_STATUS} AS s FROM orders)")
def run_summary(spark, d):
    """AG-09, SNK-08."""
    return R.run_summary(table(spark, d, "orders").select(_status().alias("status")))


@query(
    "tracker_row",
    f"""WITH q AS (SELECT l_orderkey, count(*) AS questions, count(DISTINCT l_returnflag) AS sections, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS marks FROM lineitem GROUP BY 1), r AS (SELECT *, {_STATUS} AS s FROM orders)
    SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, 'order_' || o_orderkey AS paper, '' AS class, '' AS subject, '' AS exam, '' AS session, CASE s WHEN 'needs-fixes' THEN 'Needs fixes' ELSE upper(left(s, 1)) || substr(s, 2) END AS status,
    coalesce(CAST(marks AS VARCHAR), '') AS marks, '' AS header_marks, coalesce(CAST(sections AS VARCHAR), '') AS sections, coalesce(CAST(questions AS VARCHAR), '') AS questions, '' AS blocking, '' AS other_points, '' AS filed_in, c_name AS owner, '' AS link, '' AS note
    FROM r LEFT JOIN q ON l_orderkey = o_orderkey LEFT JOIN customer ON c_custkey = o_custkey""",
)
def tracker_row(spark, d):
    """PRJ-02, PRJ-03, SNK-03."""
    q = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("questions"), F.count_distinct("l_returnflag").alias("sections"), F.sum(F.col("l_quantity").cast("long")).alias("marks"))
    rows = table(spark, d, "orders").join(q, "o_orderkey", "left").join(table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey", "left")
    values = {"date": F.date_format("o_orderdate", "yyyy-MM-dd"), "paper": F.concat(F.lit("order_"), F.col("o_orderkey").cast("string")), "status": R.status_label(_status()), "marks": F.col("marks"), "sections": F.col("sections"), "questions": F.col("questions"), "owner": F.col("c_name")}
    return R.tracker_rows(rows, values)


@query(
    "outbox_mails",
    f"""WITH r AS (SELECT o_orderkey, 'p' || o_orderkey AS n, {_STATUS} AS s, o_custkey % 3 AS more FROM orders) SELECT o_orderkey, CASE s WHEN 'formatted' THEN 'Your paper ' || n || ' has been formatted.' || CASE WHEN more > 0 THEN chr(10) || more || ' other points are in the review note.' ELSE '' END
    WHEN 'needs-fixes' THEN 'Your paper ' || n || ' needs these fixes:' || chr(10) || '- marks' || chr(10) || '- OR' || CASE WHEN more > 0 THEN chr(10) || more || ' other points are in the review note.' ELSE '' END WHEN 'unreadable' THEN 'Your paper ' || n || ' could not be read as text.' WHEN 'recovered' THEN 'Your paper ' || n || ' had been filed before.' END AS mail FROM r WHERE s <> 'error'""",
)
def outbox_mails(spark, d):
    """PRJ-07, SNK-04: messages are rows of an outbox table; errors have none."""
    mail = R.compose_mail(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")), _status(), F.array(F.lit("marks"), F.lit("OR")), F.col("o_custkey") % 3)
    return table(spark, d, "orders").select("o_orderkey", mail.alias("mail")).where("mail is not null")


@query("uploaded_link", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'https://files.invalid/' || o_orderkey END AS link, 'a' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN '.docx' ELSE '.md' END AS first_upload FROM orders")
def uploaded_link(spark, d):
    """PRJ-06, FN-27: the first upload with a suffix."""
    key = F.col("o_orderkey").cast("string")
    uploads = F.array(F.struct(F.concat(F.lit("a"), key, F.when(F.col("o_orderkey") % 2 == 0, ".docx").otherwise(".md")).alias("name"), F.concat(F.lit("https://files.invalid/"), key).alias("link")))
    rows = table(spark, d, "orders").select("o_orderkey", uploads.alias("u"))
    return rows.select("o_orderkey", F.get(F.filter("u", lambda x: x["name"].endswith(".docx")), F.lit(0))["link"].alias("link"), F.get("u", F.lit(0))["name"].alias("first_upload"))


@query("regress_diff", "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'removed' WHEN a.doc_id IS NULL THEN 'added' ELSE 'changed' END AS change FROM documents a FULL JOIN (SELECT CASE WHEN doc_id % 11 = 0 THEN -1 - doc_id ELSE doc_id END AS doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents) b ON a.doc_id = b.doc_id WHERE a.n_chars IS DISTINCT FROM b.n_chars")
def regress_diff(spark, d):
    """JN-10: all documents against a run in which some have other ids and some other lengths."""
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    new = docs.select(F.when(F.col("doc_id") % 11 == 0, -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"))
    return R.table_diff(docs, new, "doc_id", "n_chars")


_LINES = "SELECT unnest(string_split(text, chr(10))) AS line FROM documents"
_EDITED = "SELECT CASE WHEN length(line) % 7 = 0 THEN line || '!' ELSE line END AS line FROM (" + _LINES + ")"


@query("line_diff", f"(SELECT line, '-' AS side FROM (({_LINES}) EXCEPT ALL ({_EDITED}))) UNION ALL (SELECT line, '+' FROM (({_EDITED}) EXCEPT ALL ({_LINES})))")
def line_diff(spark, d):
    """SET-05: all lines against a run that ends some of them in another way."""
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("line"))
    edited = lines.select(F.when(F.char_length("line") % 7 == 0, F.concat("line", F.lit("!"))).otherwise(F.col("line")).alias("line"))
    return R.line_diff(lines, edited)
