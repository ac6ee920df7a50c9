"""Scalar text functions of question papers, as Column expressions.

Word boundaries are ASCII, as in the rules these functions follow: Java's \\b also knows Devanagari letters,
so boundaries next to those are written as lookarounds. Non-breaking spaces are made blanks beforehand.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class numerals, exam codes and their names, words for numbers, MIME types.
ROMAN = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII"]
EXAM_NAMES = {"PT1": "PERIODIC TEST 1", "PT2": "PERIODIC TEST 2", "HYE": "HALF-YEARLY EXAMINATION", "PREBOARD": "PRE-BOARD EXAMINATION", "ANNUAL": "ANNUAL EXAMINATION"}
EXAM_PATTERNS = [
    (r"(?i)pre\s*-?\s*board", "PREBOARD"),
    (r"(?i)half\s*-?\s*year(ly)?|\bhye\b|mid\s*-?\s*term|अर्धवार्षिक", "HYE"),
    (r"(?i)annual|final|\bsa\s*-?\s*2\b", "ANNUAL"),
    (r"(?i)(periodic|pt|unit)\s*(test|assessment)?\s*-?\s*(1|i|one)\b|\bpt\s*-?\s*1\b", "PT1"),
    (r"(?i)(periodic|pt|unit)\s*(test|assessment)?\s*-?\s*(2|ii|two)\b|\bpt\s*-?\s*2\b", "PT2"),
]
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
MIME_TYPES = {"docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "doc": "application/msword", "pdf": "application/pdf", "md": "text/markdown", "json": "application/json", "txt": "text/plain"}
DEVANAGARI_DIGITS = "०१२३४५६७८९"


def nbsp_to_space(text: Column) -> Column:
    return F.translate(text, "\u00a0", " ")


def normalize_space(text: Column) -> Column:
    """FN-11: zero-width characters go, a tab or three blanks and more become one tab (six blanks at a bracket, as a place to tick), other white space one blank, ends are trimmed."""
    # one look tells whether any step has something to do
    uneven = "[\u00a0\u200b\u200c\u200d\ufeff\t\r\n\f]| {2}|^ | $"
    clean = F.regexp_replace(nbsp_to_space(text), "[\u200b\u200c\u200d\ufeff]", "")
    tabs = F.regexp_replace(clean, r" *\t[ \t]*| {3,}", "\t")
    ends = F.regexp_replace(F.regexp_replace(tabs, r"[ \r\n\f]+", " "), r"^[ \t]+|[ \t]+$", "")
    even = F.regexp_replace(F.regexp_replace(ends, r"([(\[])\t", "$1      "), r"\t(?=[)\]])", "      ")
    return F.when(text.rlike(uneven), even).otherwise(text)


def ascii_digits(text: Column) -> Column:
    """FN-05."""
    return F.translate(text, DEVANAGARI_DIGITS, "0123456789")


def roman_to_int(text: Column) -> Column:
    """FN-01: of I, V and X; null for other letters; a smaller numeral before a greater one counts negative."""
    value = lambda c: F.when(c == "I", 1).when(c == "V", 5).when(c == "X", 10)
    letters = F.split(F.upper(text), "")
    signed = F.transform(letters, lambda c, i: F.when(F.coalesce(value(F.get(letters, i + 1)), F.lit(0)) > value(c), -value(c)).otherwise(value(c)))
    return F.when(F.upper(text).rlike("^[IVX]+$"), F.aggregate(signed, F.lit(0), lambda a, x: a + x))


def int_to_roman(n: Column) -> Column:
    """FN-02: tens, then the unit's numeral; empty below one."""
    return F.when(n < 1, "").otherwise(F.concat(F.repeat(F.lit("X"), (n / 10).cast("int")), F.element_at(F.array(F.lit(""), *map(F.lit, ROMAN[:9])), (n % 10 + 1).cast("int"))))


def normalize_class(text: Column) -> Column:
    """FN-03: leading digits and Roman numerals become canonical numerals, anything else upper case."""
    digits = F.regexp_extract(text, r"^(\d{1,2})", 1)
    return F.when(text == "", None).when(digits != "", int_to_roman(F.try_element_at(F.array(digits.try_cast("int")), F.lit(1)))).otherwise(F.coalesce(int_to_roman(roman_to_int(text)), F.upper(text)))


def list_letter(n: Column) -> Column:
    """FN-04: a .. z, then aa, ab, ... as spreadsheet columns."""
    last = F.chr(F.lit(97) + (n - 1) % 26)
    more = ((n - 1) / 26).cast("int")
    return F.when(n < 1, "").when(more == 0, last).otherwise(F.concat(F.chr(F.lit(96) + more), last))


def exam_code(text: Column) -> Column:
    """FN-06: the first pattern that matches names the exam."""
    return F.coalesce(*[F.when(text.rlike(p), code) for p, code in EXAM_PATTERNS])


def exam_name(code: Column, session: Column) -> Column:
    """FN-07, JN-17."""
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in EXAM_NAMES.items() for x in kv]), code), F.lit("EXAMINATION"))
    return F.concat(name, F.when(F.coalesce(session, F.lit("")) != "", F.concat(F.lit(" – "), F.regexp_replace(session, r"^(\d{4})-(\d{2})$", "$1-20$2"))).otherwise(""))


def subject_slug(subject: Column) -> Column:
    """FN-08: the first rule that matches names the subject; else its own letters."""
    s = F.trim(F.regexp_replace(F.lower(subject), "[^a-z ]", " "))
    own = F.regexp_replace(F.regexp_replace(subject, r"\(.*?\)", ""), "[^A-Za-z]+", "")
    rules = [(s.rlike("^math"), "Maths"), (s.rlike(r"social|^s\s*s\s*t\b|^s\s*o\s*sci"), "SocialScience"), (s.rlike("^eng"), "English"), (s.rlike("^sci"), "Science"), (s.rlike("^hindi") | subject.rlike("हिन्दी|हिंदी"), "Hindi"), (s.rlike("^marathi") | subject.rlike("मराठी"), "Marathi"), (s.rlike("^sanskrit"), "Sanskrit"), (s.rlike("computer|^it$|information"), "Computer")]
    out = F.when(F.coalesce(subject, F.lit("")) == "", "Paper")
    for test, name in rules:
        out = out.when(test, name)
    return out.otherwise(F.when(own == "", "Paper").otherwise(F.concat(F.upper(F.substring(own, 1, 1)), F.substring(own, 2, 10_000))))


def session(text: Column) -> Column:
    """FN-09: 2026-2027 and 2026_2027 become 2026-27."""
    return F.regexp_replace(text, r"^(\d{4})[-_]\d{0,2}(\d{2})$", "$1-$2")


def file_name_parts(name: Column) -> Column:
    """FN-10: subject, class, exam and session of Subject_Class_Exam_Session.ext, and the number of a _vN suffix."""
    stem = F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")
    part = lambda k: F.regexp_extract(stem, r"^([^_]+)_([^_]+)_([^_]+)_(\d{4}[-_]\d{2,4})", k)
    return F.struct(part(1).alias("subject"), part(2).alias("cls"), part(3).alias("exam"), session(part(4)).alias("session"), F.regexp_extract(stem, r"(?i)_v(\d+)$", 1).alias("version"))


def canonical_name(subject: Column, cls: Column, exam: Column, session_: Column, version: Column | None = None) -> Column:
    """PRJ-09."""
    blank = lambda c, other: F.coalesce(F.when(c != "", c), F.lit(other))
    base = F.concat_ws("_", subject_slug(subject), blank(cls, "Class"), blank(exam, "EXAM"), blank(session(session_), "session"))
    return base if version is None else F.concat(base, F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("_v"), version)).otherwise(""))


def marks_expression(text: Column) -> Column:
    """FN-14: per, count and total of the first form that is there: per x count = total, a product in brackets, a total with its unit, a number that closes a bracket."""
    number = lambda p, k: F.regexp_extract(text, p, k)
    full = r"(?i)(\d+)\s*[×x*]\s*(\d+)\s*=\s*(\d+)\s*(?:marks?|m|अंक)?"
    product = r"(?i)[\[(]\s*(\d+(?:\.\d+)?)\s*[×x*]\s*(\d+(?:\.\d+)?)(?:\s*=\s*(\d+(?:\.\d+)?))?\s*(?:marks?|m|अंक)?\s*[\])]"
    only, closing = r"(?i)(\d+)\s*(?:marks?|m)\b", r"[\[(][^\])]*?[-–—:\s](\d+)\s*[\])]\s*$"
    triple = lambda a, b, c: F.struct(a.cast("double").alias("per"), b.cast("double").alias("count"), c.cast("double").alias("total"))
    none = F.lit(None).cast("double")
    p1, p2, p3 = (number(product, k) for k in (1, 2, 3))
    return (
        F.when(text.rlike(full), triple(number(full, 1), number(full, 2), number(full, 3)))
        .when(text.rlike(product), triple(p1, p2, F.when(p3 != "", p3.try_cast("double")).otherwise(p1.try_cast("double") * p2.try_cast("double"))))
        .when(text.rlike(only), triple(none, none, number(only, 1)))
        .when(text.rlike(closing), triple(none, none, number(closing, 1)))
    )


TRAILING_MARK = r"(?i)(?:^|\s)(?:\[\s*(\d+)\s*\]|\(\s*(\d+)\s*(?:marks?|m|अंक)\s*\)|(\d+)\s*(?:M(?:arks?)?|अंक))\s*$"


#: What a mark at the end of a text ends with.
MARK_ENDS = (*"])mMkKsSक", *" \t\n\v\f\r\u0085\u2028\u2029")


def trailing_mark(text: Column) -> Column:
    """FN-15: the mark at the end, and the text before it; none if it is bracketed and there are several brackets."""
    end = F.when(F.substring(text, -1, 1).isin(*MARK_ENDS), F.regexp_extract(text, TRAILING_MARK, 0)).otherwise("")
    mark = F.nullif(F.regexp_extract(end, r"\d+", 0), F.lit(""))
    several = end.contains("[") & (F.substring_index(text, "[", 2) != text)
    found = mark.isNotNull() & ~several
    rest = F.when(text.endswith(end), F.substring(text, F.lit(1), F.char_length(text) - F.char_length(end))).otherwise(F.regexp_replace(text, TRAILING_MARK, ""))
    return F.struct(F.when(found, mark.try_cast("int")).alias("marks"), F.when(found, rest).otherwise(text).alias("text"))


OPTION = r"(?<=^|\s)\(?([a-eA-E])[).](?=\s|$|[A-Z₹√(−\-\d])"


def option_labels(text: Column) -> Column:
    """FN-16: labels of options a, b, c, ... that run on from the start of the line; empty if it holds no such row."""
    found = F.transform(F.regexp_extract_all(text, F.lit(OPTION), 1), F.lower)
    kept = F.aggregate(found, F.array().cast("array<string>"), lambda a, x: F.when((F.size(a) == 0) | (F.ascii(x) == F.ascii(F.try_element_at(a, F.lit(-1))) + 1), F.concat(a, F.array(x))).otherwise(a))
    return F.when(text.rlike(r"^\(?[a-eA-E][).]") & (F.size(kept) >= 2), kept).otherwise(F.array().cast("array<string>"))


def split_options(text: Column) -> Column:
    """The options of a row, each with its label as (a)."""
    parts = F.split(text, r"(?:^|\s+)(?=\(?[a-eA-E][).](?:\s|$|[A-Z₹√(−\-\d]))")
    return F.transform(F.filter(parts, lambda p: F.trim(p) != ""), lambda p: F.regexp_replace(F.trim(p), r"^\(?([a-eA-E])[).]\s*", "($1) "))


def fix_degrees(text: Column) -> Column:
    """FN-18: 180o becomes 180°."""
    return F.regexp_replace(text, r"(\d)\s?[oO](?=[\s,.;:)\]]|$)", "$1°")


def human_size(n: Column) -> Column:
    """FN-23: ties go to the even digit."""
    scaled = lambda k, unit: F.concat(F.format_string("%.1f", F.bround(n / float(1024**k), 1)), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, scaled(1, "KB")).when(n < 1024**3, scaled(2, "MB")).otherwise(scaled(3, "GB"))


def ist(ts: Column, pattern: str = "yyyy-MM-dd HH:mm") -> Column:
    """FN-24: UTC time shown 330 minutes later."""
    return F.concat(F.date_format(ts + F.expr("INTERVAL 330 MINUTES"), pattern), F.lit(" IST"))


def html_escape(text: Column) -> Column:
    """FN-25."""
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def strip_bold(text: Column) -> Column:
    return F.regexp_replace(text, r"\*\*", "")


def mime_type(name: Column) -> Column:
    """FN-26."""
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME_TYPES.items() for x in kv]), extension), F.lit("application/octet-stream"))


def has_devanagari(text: Column) -> Column:
    """FN-28."""
    return text.rlike(r"[ऀ-ॿ]")


def mark_text(marks: Column) -> Column:
    """FN-29: whole marks without decimals."""
    return F.when(marks.isNotNull(), F.concat(F.regexp_replace(marks.cast("string"), r"\.0+$", ""), F.lit("M")))


def any_n(text: Column) -> Column:
    """FN-30: N of an instruction 'any N', in figures or words."""
    word = F.lower(F.nullif(F.regexp_extract(text, r"(?i)\bany\s+(\d+|one|two|three|four|five|six|seven|eight|nine|ten)\b", 1), F.lit("")))
    return F.coalesce(word.try_cast("int"), F.try_element_at(F.create_map(*[F.lit(x) for kv in NUMBER_WORDS.items() for x in kv]), word))


def source_file(note: Column) -> Column:
    """FN-31: the file that a review note names."""
    return F.regexp_extract(note, r"(?m)^Source:\s*(.+?)\s*$", 1)


def readable_ratio(text: Column) -> Column:
    """AG-06: letters and digits over those and blanks; other characters don't count."""
    letters, blanks = F.char_length(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), F.char_length(F.regexp_replace(text, r"[^ \t\n]", ""))
    return F.when(letters + blanks > 0, letters / (letters + blanks))


def devanagari_marks(text: Column) -> Column:
    """AG-07: vowel signs, and those that no letter or sign comes before."""
    signs = r"ा-्ंँ"
    return F.struct(F.regexp_count(text, F.lit(f"[{signs}]")).alias("marks"), F.regexp_count(text, F.lit(rf"(?<![अ-हक़-य़ा-्])[{signs}]")).alias("orphans"))


# Advance widths of a serif face in thousandths of an em, by groups of characters.
NARROW, WIDE = "iljtfrI.,;:'!|()[] ", "mwMWQO@%"


def text_width(text: Column) -> Column:
    """FN-20: width in twips at 11 points, by three groups of characters."""
    count = lambda chars: F.char_length(text) - F.char_length(F.translate(text, chars, ""))
    narrow, wide = count(NARROW), count(WIDE)
    return (narrow * 300 + wide * 850 + (F.char_length(text) - narrow - wide) * 520) * F.lit(0.22)


def options_per_line(n: Column, longest: Column, width: Column) -> Column:
    """LAY-08: four, three, two or one option on a line, by the longest text and its width."""
    return F.when((longest <= 23) & (width <= 2400), 4).when((n == 3) & (longest <= 29) & (width <= 3240), 3).when((longest <= 46) & (width <= 4920), 2).otherwise(1)


def image_size(width: Column, height: Column, most: float = 500.0) -> Column:
    """FN-21, FN-22: points to pixels, scaled down to the greatest width; 150 x 100 if unknown."""
    w, h = F.coalesce(width * 4 / 3, F.lit(150.0)), F.coalesce(height * 4 / 3, F.lit(100.0))
    scale = F.least(F.lit(1.0), F.lit(most) / w)
    return F.struct(F.floor(w * scale + 0.5).cast("long").alias("w"), F.floor(h * scale + 0.5).cast("long").alias("h"))
