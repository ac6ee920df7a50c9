"""Chat formatting: prefix-target expansion, by built-in functions only.

A turn is formatted as <s>role<r>text</s>. In roles and texts every backslash is doubled and every "<" gets
a backslash behind it, so no control string can stand inside a text, and unescaping gives the text back.
Each assistant turn becomes an example of its own: all earlier turns as context, and only its text under the
loss mask, given as a span of characters. One more row for each conversation, example_no null, holds all of
its turns without loss, so turns after the last reply are kept too.

A conversation's turns meet in one row, as any text that spans them must; the expansion repeats only prefixes.

Defined cases: null text or role counts as empty; turns are ordered by turn (nulls first), then role and
text, so ties and repeated rows have an order and all count; rows without conv_id make one conversation; a
conversation without assistant turns has only its row without loss; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BEGIN, ROLE_END, END = "<s>", "<r>", "</s>"
TRAINED = "assistant"
CLASHING = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("<\\"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(<)\\|(\\)\\", "$1$2")


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the formatted turns of each conversation in order, with role and escaped text."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    turn = F.struct(F.col("turn"), role.alias("role"), text.alias("text"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("rows"))

    def formatted(x: Column) -> Column:
        head = F.concat(F.lit(BEGIN), escape(x.role), F.lit(ROLE_END))
        return F.struct(F.concat(head, escape(x.text), F.lit(END)).alias("segment"), (x.role == TRAINED).alias("trained"), F.char_length(head).alias("head"))

    return ordered.select("conv_id", F.transform("rows", formatted).alias("turns"))


def expand(rows: DataFrame) -> DataFrame:
    """(conv_id, example_no, formatted, loss_start, loss_end): an example for each assistant turn, and a row with all turns and null example_no."""
    held = conversations(rows).select("conv_id", "turns", F.concat(F.filter(F.sequence(F.lit(1), F.size("turns")), lambda k: F.element_at("turns", k.cast("int")).trained), F.array(F.lit(None).cast("int"))).alias("targets"))
    each = held.select("conv_id", "turns", F.posexplode("targets").alias("no", "target"))
    last = F.coalesce("target", F.size("turns"))
    text = F.array_join(F.transform(F.slice("turns", F.lit(1), last), lambda x: x.segment), "")
    goal = F.element_at("turns", F.col("target"))
    end = F.when(F.col("example_no").isNotNull(), F.char_length("formatted") - len(END))
    return each.select("conv_id", F.when(F.col("target").isNotNull(), F.col("no")).alias("example_no"), text.alias("formatted"), (F.char_length(goal.segment) - goal["head"]).alias("tail")).select(
        "conv_id", "example_no", "formatted", (F.char_length("formatted") - F.col("tail")).alias("loss_start"), end.alias("loss_end")
    )


def read_turns(formatted: Column) -> Column:
    """Role, newline, text and newline of every turn of a formatted conversation."""
    segments = F.filter(F.split(formatted, END, -1), lambda s: s != "")
    body = lambda s: F.substring(s, len(BEGIN) + 1, 2**31 - 1)
    part = lambda s, k: unescape(F.split(body(s), ROLE_END, 2)[k])
    return F.array_join(F.transform(segments, lambda s: F.concat(part(s, 0), F.lit("\n"), part(s, 1), F.lit("\n"))), "")


def summary(examples: DataFrame) -> DataFrame:
    """What can be read back from the examples of each conversation."""
    loss = unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    whole = F.col("example_no").isNull()
    read = examples.select(
        "conv_id",
        F.when(~whole, F.struct("example_no", loss.alias("loss"))).alias("target"),
        F.when(whole, F.size(F.split("formatted", END, -1)) - 1).cast("long").alias("n_turns"),
        F.when(whole, F.sha2(read_turns(F.col("formatted")), 256)).alias("turns_sha256"),
        F.when(whole, F.char_length("formatted")).cast("long").alias("formatted_chars"),
    )
    back = read.groupBy("conv_id").agg(F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"), F.sort_array(F.collect_list("target")).alias("targets"), F.max("formatted_chars").alias("formatted_chars"))
    text = F.array_join(F.transform("targets", lambda x: x.loss), "")
    return back.select("conv_id", "n_turns", "turns_sha256", F.char_length(text).cast("long").alias("loss_chars"), F.sha2(text, 256).alias("loss_sha256"), "formatted_chars", F.size("targets").cast("long").alias("n_examples"))


def op1_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CLASHING).alias("text"))
    return summary(expand(rows.unionByName(more)))


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id,
  count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(10 + length(replace(replace(role, '\', '\\'), '<', '<\')) + length(replace(replace(text, '\', '\\'), '<', '<\'))) AS BIGINT) AS formatted_chars,
  count(*) FILTER (WHERE role = 'assistant') AS n_examples
FROM rows GROUP BY conv_id
"""
