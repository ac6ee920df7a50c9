"""Text queries: scalar functions and wording rules, over documents and over strings made from keys on both engines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import rules as R
from .registry import query, table


def _part(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")


@query("line_split", "SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, length(unnest(l)) AS chars FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)")
def line_split(spark, d):
    """FN-13."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    return lines.select("doc_id", F.col("no").cast("long").alias("line_no"), F.char_length("line").cast("long").alias("chars"))


@query("empty_lines_dropped", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, len(string_split(text, chr(10))) AS n FROM documents) SELECT doc_id, count(*) AS lines FROM l WHERE trim(line) <> '' OR n = 1 GROUP BY 1")
def empty_lines_dropped(spark, d):
    """FLT-03."""
    from pyspark.sql import Window

    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"), F.size(F.split("text", "\n")).alias("n"))
    return lines.where((F.trim("line") != "") | (F.col("n") == 1)).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query("whitespace_normalise", r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x{200b}\x{200c}\x{200d}\x{feff}]', '', 'g'), ' *\t[ \t]*| {3,}', chr(9), 'g'), '[ \r\n\f]+', ' ', 'g'), '^[ \t]+|[ \t]+$', '', 'g'), '([(\[])\t', '\1      ', 'g'), '\t([)\]])', '      \1', 'g') AS line FROM documents")
def whitespace_normalise(spark, d):
    """FN-11."""
    return table(spark, d, "documents").select("doc_id", T.normalize_space(F.col("text")).alias("line"))


@query("readable_ratio", r"WITH t AS (SELECT doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) AS a, length(regexp_replace(text, '[^ \t\n]', '', 'g')) AS b FROM documents) SELECT doc_id, round(CAST(a AS DOUBLE) / (a + b), 6) AS ratio, a < 50 OR CAST(a AS DOUBLE) / (a + b) < 0.45 AS unreadable FROM t WHERE a + b > 0")
def readable_ratio(spark, d):
    """AG-06, FLT-10."""
    text = F.col("text")
    letters = F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    rows = table(spark, d, "documents").select("doc_id", T.readable_ratio(text).alias("r"), letters.alias("a"))
    return rows.where("r is not null").select("doc_id", F.round("r", 6).alias("ratio"), ((F.col("a") < 50) | (F.col("r") < 0.45)).alias("unreadable"))


@query("no_end_punctuation", "SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Za-z0-9]$')")
def no_end_punctuation(spark, d):
    """R32."""
    return table(spark, d, "documents").where(F.col("text").rlike(r"[A-Za-z0-9]\z")).select("doc_id")


_REPEAT = "|".join(rf"\b{w}\s+{w}\b" for w in R.REPEATABLE)


@query("repeated_word", f"SELECT doc_id FROM documents WHERE regexp_matches(text, '(?i){_REPEAT}')")
def repeated_word(spark, d):
    """R31."""
    rule = next(r for r in R.wording_rules(F.col("text")) if r[0] == "R31")
    return table(spark, d, "documents").where(rule[2]).select("doc_id")


# A stem from each part's name, with one of several faults put in by its key.
_STEM_SQL = """SELECT p_partkey, CASE p_partkey % 12 WHEN 0 THEN '. ' || p_name WHEN 1 THEN p_name || ' (marks)' WHEN 2 THEN 'Angle of ' || p_size || ' o is drawn' WHEN 3 THEN 'the result Is wrong. ' || p_name || '?'
  WHEN 4 THEN 'It cost Rs. ' || p_size || ' in all.' WHEN 5 THEN 'A bag of 5 Kg rice.' WHEN 6 THEN 'A tank of 4 m. 3 volume.' WHEN 7 THEN 'In the given figure find ' || p_name || '.' WHEN 8 THEN 'Draw a diagram of ' || p_name || '.'
  WHEN 9 THEN 'He bought a pen for ' || (p_size + 10) || ' yesterday.' WHEN 10 THEN '' ELSE 'WHAT IS ' || p_name END AS stem FROM part"""


def stems(spark, d):
    k, n, s = F.col("p_partkey") % 12, F.col("p_name"), F.col("p_size").cast("string")
    text = [F.concat(F.lit(". "), n), F.concat(n, F.lit(" (marks)")), F.concat(F.lit("Angle of "), s, F.lit(" o is drawn")), F.concat(F.lit("the result Is wrong. "), n, F.lit("?")), F.concat(F.lit("It cost Rs. "), s, F.lit(" in all.")), F.lit("A bag of 5 Kg rice."), F.lit("A tank of 4 m. 3 volume."), F.concat(F.lit("In the given figure find "), n, F.lit(".")), F.concat(F.lit("Draw a diagram of "), n, F.lit(".")), F.concat(F.lit("He bought a pen for "), (F.col("p_size") + 10).cast("string"), F.lit(" yesterday.")), F.lit("")]
    out = F.when(k == 0, text[0])
    for i, t in enumerate(text[1:], 1):
        out = out.when(k == i, t)
    return _part(spark, d).select("p_partkey", out.otherwise(F.concat(F.lit("WHAT IS "), n)).alias("stem"))


_RULES_SQL = f"""WITH s AS ({_STEM_SQL}), f AS (
  SELECT p_partkey, 'R21' AS rule, 'structure' AS category, 'question has no text' AS message, true AS blocking FROM s WHERE trim(stem) = ''
  UNION ALL SELECT p_partkey, 'R22', 'wording', 'starts with a stray "' || left(stem, 1) || '"', false FROM s WHERE regexp_matches(stem, '^[.,;:]')
  UNION ALL SELECT p_partkey, 'R26', 'marks', '"(marks)" placeholder', false FROM s WHERE regexp_matches(stem, '(?i)\\(\\s*marks?\\s*\\)')
  UNION ALL SELECT p_partkey, 'R27', 'wording', 'degree written with the letter "o"', false FROM s WHERE regexp_matches(stem, '\\b(\\d+)\\s*[oO]\\b') AND NOT contains(stem, '°')
  UNION ALL SELECT p_partkey, 'R28a', 'wording', '"Is" for "is"', false FROM s WHERE regexp_matches(stem, '\\b[a-z]+\\s+Is\\s')
  UNION ALL SELECT p_partkey, 'R28b', 'wording', '"IS" in capitals', false FROM s WHERE regexp_matches(stem, '\\b[A-Z]{{2,}}\\s+IS\\b|\\sIS_+')
  UNION ALL SELECT p_partkey, 'R29a', 'wording', '"Rs" for the rupee sign', false FROM s WHERE regexp_matches(stem, '\\bRs\\.?\\s*\\d')
  UNION ALL SELECT p_partkey, 'R29b', 'wording', 'money amount without a sign', false FROM s WHERE regexp_matches(stem, '(?i)\\bfor\\s+\\d{{2,}}\\s') AND regexp_matches(stem, '(?i)\\bbought\\b')
  UNION ALL SELECT p_partkey, 'R30a', 'wording', 'unit power written with a dot', false FROM s WHERE regexp_matches(stem, '\\b\\d+\\s*(?:m|cm|kg|g|km)\\s*\\.\\s*\\d\\b')
  UNION ALL SELECT p_partkey, 'R30b', 'wording', '"Kg" for kg', false FROM s WHERE regexp_matches(stem, '\\bKg\\b')
  UNION ALL SELECT p_partkey, 'R31', 'wording', 'repeated word', false FROM s WHERE regexp_matches(stem, '(?i){_REPEAT}')
  UNION ALL SELECT p_partkey, 'R32', 'wording', 'no punctuation at the end of the question', false FROM s WHERE regexp_matches(stem, '[A-Za-z0-9]$')
  UNION ALL SELECT p_partkey, 'R33', 'figures', 'refers to a figure', true FROM s WHERE regexp_matches(stem, '(?i)figure|diagram') AND NOT regexp_matches(stem, '(?i)\\bdraw\\b'))
""".replace("\\\\", "\\")


def _findings(spark, d):
    return R.findings(stems(spark, d), "p_partkey", R.wording_rules(F.col("stem")))


@query("wording_findings", _RULES_SQL + "SELECT * FROM f")
def wording_findings(spark, d):
    """R21-R33 in one pass."""
    return _findings(spark, d)


@query("finding_counts", _RULES_SQL + "SELECT rule, count(*) AS n FROM f GROUP BY 1")
def finding_counts(spark, d):
    return _findings(spark, d).groupBy("rule").agg(F.count("*").alias("n"))


@query("finding_verdicts", _RULES_SQL + "SELECT p_partkey, coalesce(list(message ORDER BY message) FILTER (WHERE blocking), []) AS blocking, count(*) FILTER (WHERE NOT blocking) AS others FROM f GROUP BY 1")
def finding_verdicts(spark, d):
    """AG-10."""
    return R.verdicts(_findings(spark, d), "p_partkey")


_NOTE_SQL = _RULES_SQL + """, sec AS (SELECT p_partkey, category, CASE category WHEN 'marks' THEN 2 WHEN 'structure' THEN 4 WHEN 'wording' THEN 5 WHEN 'figures' THEN 6 END AS no,
  CASE category WHEN 'marks' THEN 'Marks' WHEN 'structure' THEN 'Numbering and structure' WHEN 'wording' THEN 'Wording' WHEN 'figures' THEN 'Figures' END AS heading,
  string_agg('- ' || CASE WHEN blocking THEN '**[blocking]** ' ELSE '' END || message, chr(10) ORDER BY '- ' || CASE WHEN blocking THEN '**[blocking]** ' ELSE '' END || message) AS lines FROM f GROUP BY 1, 2)
SELECT p_partkey, '# Paper ' || p_partkey || chr(10) || 'Source: part_' || p_partkey || '.docx' || chr(10) || chr(10) || string_agg('## ' || heading || chr(10) || lines, chr(10) || chr(10) ORDER BY no) AS note FROM sec GROUP BY 1"""


@query("review_note_text", _NOTE_SQL)
def review_note_text(spark, d):
    """SNK-06, AG-15."""
    key = F.col("p_partkey").cast("string")
    return R.review_notes(_findings(spark, d), "p_partkey", F.concat(F.lit("Paper "), key), F.concat(F.lit("part_"), key, F.lit(".docx")))


@query("review_note_read_back", _RULES_SQL + "SELECT p_partkey, CASE category WHEN 'marks' THEN 'Marks' WHEN 'structure' THEN 'Numbering and structure' WHEN 'wording' THEN 'Wording' ELSE 'Figures' END AS heading, blocking, message FROM f")
def review_note_read_back(spark, d):
    """SRC-12: the findings read from the notes are those written."""
    return R.read_notes(review_note_text(spark, d), "p_partkey")


@query("degree_fix", "SELECT p_partkey, 'angle ' || p_size || '°, ' || p_size || 'of' AS fixed FROM part")
def degree_fix(spark, d):
    """FN-18."""
    s = F.col("p_size").cast("string")
    return _part(spark, d).select("p_partkey", T.fix_degrees(F.concat(F.lit("angle "), s, F.when(F.col("p_partkey") % 2 == 0, "o, ").otherwise(" O, "), s, F.lit("of"))).alias("fixed"))


@query(
    "marks_expr",
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 1 THEN p_size + 0.5 END AS per, CASE WHEN p_partkey % 4 < 2 THEN 4.0 END AS count,
    CASE p_partkey % 4 WHEN 0 THEN p_size * 4.0 WHEN 1 THEN (p_size + 0.5) * 4 ELSE CAST(p_size AS DOUBLE) END AS total FROM part""",
)
def marks_expr(spark, d):
    """FN-14."""
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 4
    text = F.when(k == 0, F.concat(F.lit("Section A ("), s, F.lit(" × 4 = "), (F.col("p_size") * 4).cast("string"), F.lit(" Marks)"))).when(k == 1, F.concat(F.lit("do ["), s, F.lit(".5 x 4]"))).when(k == 2, F.concat(F.lit("for "), s, F.lit(" marks"))).otherwise(F.concat(F.lit("[READING - "), s, F.lit("]")))
    return _part(spark, d).select("p_partkey", T.marks_expression(text).alias("m")).select("p_partkey", "m.per", "m.count", "m.total")


@query("trailing_mark", "SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN p_size END AS marks, CASE WHEN p_partkey % 4 < 3 THEN p_name ELSE p_name || ' [a] [' || p_size || ']' END AS text FROM part")
def trailing_mark(spark, d):
    """FN-15."""
    s, k, n = F.col("p_size").cast("string"), F.col("p_partkey") % 4, F.col("p_name")
    text = F.when(k == 0, F.concat(n, F.lit(" ["), s, F.lit("]"))).when(k == 1, F.concat(n, F.lit(" ("), s, F.lit(" marks)"))).when(k == 2, F.concat(n, F.lit(" "), s, F.lit("M "))).otherwise(F.concat(n, F.lit(" [a] ["), s, F.lit("]")))
    return _part(spark, d).select("p_partkey", T.trailing_mark(text).alias("m")).select("p_partkey", "m.marks", "m.text")


@query("option_split", "SELECT p_partkey, list_transform(range(1, CAST(2 + p_partkey % 3 AS BIGINT) + 1), lambda k: '(' || chr(CAST(96 + k AS INT)) || ') ' || CAST(p_size + k AS VARCHAR)) AS options, CAST(2 + p_partkey % 3 AS INT) <> 4 AS odd FROM part")
def option_split(spark, d):
    """FN-16, AG-14, R24."""
    n = (2 + F.col("p_partkey") % 3).cast("int")
    letters = F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.when(F.col("p_partkey") % 2 == 0, "(").otherwise(""), F.chr(F.lit(96) + k), F.lit(") "), (F.col("p_size") + k).cast("string")))
    rows = _part(spark, d).select("p_partkey", F.array_join(letters, "  ").alias("row"))
    return rows.select("p_partkey", T.split_options(F.col("row")).alias("options"), (F.size(T.option_labels(F.col("row"))) != 4).alias("odd"))


@query("roman_class", "WITH n AS (SELECT c_custkey, CAST(c_custkey % 12 + 1 AS INT) AS k FROM customer), r AS (SELECT *, ['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII'][k] AS roman FROM n) SELECT c_custkey, roman AS from_digits, roman AS from_roman, k AS number, 'LKG' AS other FROM r")
def roman_class(spark, d):
    """FN-01, FN-02, FN-03."""
    k = (F.col("c_custkey") % 12 + 1).cast("int")
    roman = T.int_to_roman(k)
    return table(spark, d, "customer").select("c_custkey", T.normalize_class(F.concat(k.cast("string"), F.lit("th"))).alias("from_digits"), T.normalize_class(F.lower(roman)).alias("from_roman"), T.roman_to_int(roman).alias("number"), T.normalize_class(F.lit("lkg")).alias("other"))


@query("list_letters", "SELECT p_partkey, CASE WHEN p_size <= 26 THEN chr(CAST(96 + p_size AS INT)) ELSE chr(CAST(96 + (p_size - 1) // 26 AS INT)) || chr(CAST(97 + (p_size - 1) % 26 AS INT)) END AS label FROM part")
def list_letters(spark, d):
    """FN-04."""
    return _part(spark, d).select("p_partkey", T.list_letter(F.col("p_size")).alias("label"))


_EXAM = "['Pre-Board exam', 'Half Yearly Examination', 'Annual Exam', 'Periodic Test 1', 'PT-2', 'Unit Test II', 'Weekly Quiz'][CAST(c_custkey % 7 + 1 AS INT)]"


@query(
    "exam_code",
    f"""WITH e AS (SELECT c_custkey, {_EXAM} AS exam, ['PREBOARD','HYE','ANNUAL','PT1','PT2','PT2',NULL][CAST(c_custkey % 7 + 1 AS INT)] AS code FROM customer)
    SELECT c_custkey, code, CASE code WHEN 'PT1' THEN 'PERIODIC TEST 1' WHEN 'PT2' THEN 'PERIODIC TEST 2' WHEN 'HYE' THEN 'HALF-YEARLY EXAMINATION' WHEN 'PREBOARD' THEN 'PRE-BOARD EXAMINATION' WHEN 'ANNUAL' THEN 'ANNUAL EXAMINATION' ELSE 'EXAMINATION' END || ' – 2026-2027' AS name FROM e""",
)
def exam_code(spark, d):
    """FN-06, FN-07, FN-09."""
    exams = ["Pre-Board exam", "Half Yearly Examination", "Annual Exam", "Periodic Test 1", "PT-2", "Unit Test II", "Weekly Quiz"]
    exam = F.element_at(F.array(*map(F.lit, exams)), (F.col("c_custkey") % 7 + 1).cast("int"))
    code = T.exam_code(exam)
    return table(spark, d, "customer").select("c_custkey", code.alias("code"), T.exam_name(code, T.session(F.lit("2026_2027"))).alias("name"))


_SUBJECTS = ["Mathematics (041)", "S.S.T.", "English Lang", "Science", "Hindi", "Marathi", "Sanskrit", "Computer Science", "Environmental studies", "123"]
_SLUGS = ["Maths", "SocialScience", "English", "Science", "Hindi", "Marathi", "Sanskrit", "Computer", "Environmentalstudies", "Paper"]


@query("subject_slug", f"SELECT c_custkey, {_SLUGS}[CAST(c_custkey % 10 + 1 AS INT)] AS slug FROM customer")
def subject_slug(spark, d):
    """FN-08, SRT-06."""
    return table(spark, d, "customer").select("c_custkey", T.subject_slug(F.element_at(F.array(*map(F.lit, _SUBJECTS)), (F.col("c_custkey") % 10 + 1).cast("int"))).alias("slug"))


@query("human_sizes", "SELECT o_orderkey, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f', n / 1024.0) || ' KB' WHEN n < 1073741824 THEN printf('%.1f', n / 1048576.0) || ' MB' ELSE printf('%.1f', n / 1073741824.0) || ' GB' END AS size FROM (SELECT o_orderkey, o_orderkey * o_custkey AS n FROM orders)")
def human_sizes(spark, d):
    """FN-23."""
    return table(spark, d, "orders").select("o_orderkey", T.human_size(F.col("o_orderkey") * F.col("o_custkey")).alias("size"))


@query("ist_dates", "SELECT event_id, strftime(ts + INTERVAL 330 MINUTES, '%Y-%m-%d %H:%M') || ' IST' AS shown FROM events")
def ist_dates(spark, d):
    """FN-24."""
    return table(spark, d, "events").select("event_id", T.ist(F.col("ts")).alias("shown"))


@query("html_plain_text", r"SELECT page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g'))) AS chars, sha256(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped FROM pages")
def html_plain_text(spark, d):
    """FN-25, SRC-11."""
    plain = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"[ \t\r\n\f]+", " "))
    return table(spark, d, "pages").select("page_id", F.char_length(plain).cast("long").alias("chars"), F.sha2(T.html_escape(F.col("html")), 256).alias("escaped"))


@query("json_props", "SELECT event_id, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value, base64(encode(props)) AS encoded FROM events")
def json_props(spark, d):
    """FN-J1, FN-J2."""
    props = F.col("props")
    first = F.get(F.json_object_keys(props), F.lit(0))
    return table(spark, d, "events").select("event_id", F.element_at(F.from_json(props, "map<string,string>"), first).alias("first_value"), F.base64(props.cast("binary")).alias("encoded"))


#: Characters by code point: vowel signs with the two nasal ones, and what may stand before a sign.
_SIGN = "(unicode(s[{0}]) BETWEEN 2366 AND 2381 OR unicode(s[{0}]) IN (2305, 2306))"
_BASE = "(unicode(s[{0}]) BETWEEN 2309 AND 2361 OR unicode(s[{0}]) BETWEEN 2392 AND 2399 OR unicode(s[{0}]) BETWEEN 2366 AND 2381)"


@query(
    "devanagari_ratio",
    f"""WITH t AS (SELECT p_partkey, repeat(CASE WHEN p_partkey % 2 = 0 THEN chr(2366) || chr(2367) || 'क ' ELSE 'किताब ' END, p_size) AS s FROM part),
    c AS (SELECT p_partkey, len(list_filter(range(1, length(s) + 1), lambda i: {_SIGN.format('i')})) AS marks, len(list_filter(range(1, length(s) + 1), lambda i: {_SIGN.format('i')} AND (i = 1 OR NOT {_BASE.format('i - 1')}))) AS orphans FROM t)
    SELECT p_partkey, CAST(marks AS INT) AS marks, CAST(orphans AS INT) AS orphans, marks >= 20 AND CAST(orphans AS DOUBLE) / marks > 0.3 AS garbled FROM c""",
)
def devanagari_ratio(spark, d):
    """AG-07, FLT-11: the SQL looks at each character and the one before it."""
    text = F.when(F.col("p_partkey") % 2 == 0, F.repeat(F.lit("ािक "), F.col("p_size"))).otherwise(F.repeat(F.lit("किताब "), F.col("p_size")))
    m = T.devanagari_marks(text)
    return _part(spark, d).select("p_partkey", m["marks"].alias("marks"), m["orphans"].alias("orphans"), ((m["marks"] >= 20) & (m["orphans"] / m["marks"] > 0.3)).alias("garbled"))


@query("any_n_words", "SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 END AS INT) AS n, '12३' || 'x' AS same FROM part")
def any_n_words(spark, d):
    """FN-30, FN-05."""
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, "Answer any four of these").when(k == 1, "Attempt any 3 questions").otherwise("Answer all")
    return _part(spark, d).select("p_partkey", T.any_n(text).alias("n"), F.when(T.ascii_digits(F.lit("१२३")) == "123", "12३x").alias("same"))
