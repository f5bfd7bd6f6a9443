"""Chat formatting by prefix-target expansion.

Every assistant turn of a conversation becomes an example of its own: all turns before it as context, the
reply as the only trainable part.  Turns after the last assistant turn, which belong to no example, make
a closing example without a target, so nothing of a conversation is lost.

The template marks a turn as ``<|role|>text</s>``.  In roles and texts the characters of which control
strings are made (``<``, ``[``, ``|`` and the escape character itself) are written as a backslash and a
letter, so each of them in the output comes from the template, a formatted text is read back by plain
splitting, and unescaping gives the texts back.

An example is stored as the conversation's formatted text up to the example's end, split where the
target begins.  Formatting is a projection by turn; an example's context is put together by a window over
the conversation's turns.  The output is as long as the expansion is: a conversation of n turns of which m
are the assistant's gives m prefixes.  A conversation is the unit of the format and is held in one task
while it is put together; conversations are spread by their id.

Edge cases: a null text is empty, a null role is an empty role; rows are put in order by turn, ties by
role and text, and all rows count; rows with a null conversation id form a conversation of their own;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm.common import table

OPEN, MIDDLE, CLOSE = "<|", "|>", "</s>"
TARGET_ROLE = "assistant"


#: Escapes, in the order in which they are made; they are undone from the last to the first.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\k"), ("|", "\\p"))


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def expand(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each example: key, example (from 0), context, target (null without one), tail.

    context + target + tail is the formatted example and target is the trainable part, still escaped.
    """
    head = F.concat(F.lit(OPEN), escaped(F.coalesce(F.col(role), F.lit(""))), F.lit(MIDDLE))
    body = escaped(F.coalesce(F.col(text), F.lit("")))
    turns = rows.select(F.col(key).alias("key"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"), head.alias("head"), body.alias("body"))
    order = Window.partitionBy("key").orderBy("turn", "role", "text")
    whole = Window.partitionBy("key")
    turns = turns.withColumn("place", F.row_number().over(order)).withColumn("turns", F.count(F.lit(1)).over(whole))
    before = F.array_join(F.collect_list(F.concat("head", "body", F.lit(CLOSE))).over(order.rowsBetween(Window.unboundedPreceding, -1)), "")
    turns = turns.withColumn("before", before)
    reply = F.col("role") == TARGET_ROLE
    examples = turns.where(reply | (F.col("place") == F.col("turns")))
    number = F.row_number().over(Window.partitionBy("key").orderBy("place")) - 1
    return examples.select(
        F.col("key").alias(key), number.alias("example"),
        F.when(reply, F.concat("before", "head")).otherwise(F.concat("before", "head", "body")).alias("context"),
        F.when(reply, F.col("body")).alias("target"), F.lit(CLOSE).alias("tail"),
    )


def read_back(examples: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, turns (array of role and text), targets (texts under the loss mask, in order) and formatted_chars, from the formatted examples alone."""
    formatted = F.concat("context", F.coalesce("target", F.lit("")), "tail")
    by = examples.groupBy(key).agg(
        F.max_by(formatted, "example").alias("longest"),
        F.sum(F.char_length(formatted)).alias("formatted_chars"),
        F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), F.struct("example", "target")))).alias("targets"),
    )
    pieces = F.filter(F.split("longest", CLOSE), lambda p: p != "")
    role = lambda p: F.substring_index(p, MIDDLE, 1).substr(F.lit(len(OPEN) + 1), F.char_length(p))
    text = lambda p: p.substr(F.instr(p, MIDDLE) + len(MIDDLE), F.char_length(p))
    turns = F.transform(pieces, lambda p: F.struct(unescaped(role(p)).alias("role"), unescaped(text(p)).alias("text")))
    return by.select(key, turns.alias("turns"), F.transform("targets", lambda x: unescaped(x["target"])).alias("targets"), "formatted_chars")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts consist of control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", probe), (-1, 1, TARGET_ROLE, probe)]
    return conversations.select("conv_id", "turn", "role", "text").unionByName(conversations.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def op4_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_back(expand(with_probe(table(spark, sf_dir, "conversations"))))
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("targets", "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(listed, 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.col("formatted_chars").cast("bigint").alias("formatted_chars"),
    )


#: The digests of the rows themselves; formatted_chars by adding up what the template writes.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place, count(*) OVER (PARTITION BY conv_id) AS turns,
    8 + length(regexp_replace(role, '[\\<\[|]', '--', 'g')) + length(regexp_replace(text, '[\\<\[|]', '--', 'g')) AS chars FROM c),
s AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY place) AS upto FROM p)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(coalesce(sum(upto) FILTER (role = 'assistant' OR place = turns), 0) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

QUERIES = {"op4_chat_prefix_targets": op4_chat_prefix_targets}
ORACLES = {"op4_chat_prefix_targets": ORACLE}
