r"""Chat formatting by prefix-target expansion.

Every assistant turn is the target of an example of its own: all turns before it are the context, and its reply alone
is trainable. Contexts of a conversation are prefixes of one formatted text: example_segments() has what each turn adds,
and examples() a row for each assistant turn with its whole text and loss span, cut from that text by its offset. A task
holds a conversation's turns once; the examples that it tells grow with the square of them, as they are whole.

Template: user [INST]text[/INST], assistant <s>text</s>, system [SYS]text[/SYS], any other role
[ROLE]role[TEXT]text[/ROLE]. Inside texts and role names the backslash becomes \b and the first character of a control
string \l or \a, so that no control string stands in a text; unescape() reverses it.

Defined cases: null texts are empty; a null role is the empty one; turns are ordered by turn (null first), role and
text, so that ties have one order; a row of a null conv_id is a conversation of its own (lone tells them apart), so that
they are never gathered; turns after the last reply form a segment that trains nothing; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import sha256_hex

CONTROLS = r"\[/?(?:INST|SYS|ROLE)\]|\[TEXT\]|</?s>"


def escape(text: Column) -> Column:
    text = F.regexp_replace(text, r"\\", r"\\b")
    text = F.regexp_replace(text, r"\[(?=/?(?:INST|SYS|ROLE)\]|TEXT\])", r"\\l")
    return F.regexp_replace(text, r"<(?=/?s>)", r"\\a")


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("[")), F.lit("\\a"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_turn(role: Column, text: Column) -> Column:
    body = escape(text)
    return (
        F.when(role == "user", F.concat(F.lit("[INST]"), body, F.lit("[/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s>"), body, F.lit("</s>")))
        .when(role == "system", F.concat(F.lit("[SYS]"), body, F.lit("[/SYS]")))
        .otherwise(F.concat(F.lit("[ROLE]"), escape(role), F.lit("[TEXT]"), body, F.lit("[/ROLE]")))
    )


def example_segments(conversations: DataFrame) -> DataFrame:
    """A row for each turn: conv_id, lone, n (place in the conversation), example, start, end, loss_start, loss_end, segment.

    example counts the replies before the turn, so that it is the first example whose text has the turn; start and end
    are the turn's place in the formatted conversation, and context of the example that ends with it is all before
    start. The loss span is null but for replies; lone is null but for rows of a null conv_id.
    """
    lone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("lone")
    turns = conversations.select("conv_id", lone, "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id", "lone").orderBy("turn", "role", "text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    reply = F.col("role") == "assistant"
    rows = turns.withColumn("segment", format_turn(F.col("role"), F.col("text"))).select(
        "conv_id",
        "lone",
        (F.row_number().over(order) - 1).alias("n"),
        F.coalesce(F.sum(reply.cast("long")).over(before), F.lit(0)).alias("example"),
        F.coalesce(F.sum(F.length("segment")).over(before), F.lit(0)).alias("start"),
        reply.alias("reply"),
        "segment",
    )
    end = F.col("start") + F.length("segment")
    return rows.select(
        "conv_id",
        "lone",
        "n",
        "example",
        "start",
        end.alias("end"),
        F.when(F.col("reply"), F.col("start") + len("<s>")).alias("loss_start"),
        F.when(F.col("reply"), end - len("</s>")).alias("loss_end"),
        "segment",
    )


def examples(segments: DataFrame) -> DataFrame:
    """conv_id, lone, n, example, text, loss_start, loss_end: a row for each assistant turn, with all turns up to it.

    Turns after the last reply (or of a conversation without one) have a last row that trains nothing: no loss span.
    """
    turn = F.struct("n", "example", "end", "loss_start", "loss_end", "segment")
    grouped = segments.groupBy("conv_id", "lone").agg(F.array_sort(F.collect_list(turn)).alias("said"))
    kept = F.filter("said", lambda x, i: x["loss_start"].isNotNull() | (i == F.size("said") - 1))
    offsets = F.transform(kept, lambda x: F.struct(*[x[c].alias(c) for c in ("n", "example", "end", "loss_start", "loss_end")]))
    whole = grouped.select("conv_id", "lone", F.array_join(F.transform("said", lambda x: x["segment"]), "").alias("whole"), offsets.alias("turns"))
    each = whole.select("conv_id", "lone", "whole", F.explode("turns").alias("t"))
    return each.select("conv_id", "lone", "t.n", "t.example", F.substring("whole", F.lit(1), F.col("t.end").cast("int")).alias("text"), "t.loss_start", "t.loss_end")


def whole_examples(segments: DataFrame) -> DataFrame:
    """conv_id, example, text, loss_start, loss_end of every assistant turn, with contexts written out."""
    return examples(segments).where(F.col("loss_start").isNotNull()).select("conv_id", "example", "text", "loss_start", "loss_end")


def read_back(segments: DataFrame) -> DataFrame:
    """conv_id, n, role, text, trained of every turn, from the formatted text and the loss spans alone."""
    s = F.col("segment")
    other = F.split(F.regexp_extract(s, r"(?s)^\[ROLE\](.*)\[/ROLE\]$", 1), r"\[TEXT\]", 2)
    role = F.when(s.startswith("[INST]"), "user").when(s.startswith("<s>"), "assistant").when(s.startswith("[SYS]"), "system").otherwise(unescape(other[0]))
    opening = F.when(s.startswith("[INST]"), len("[INST]")).when(s.startswith("<s>"), len("<s>")).otherwise(len("[SYS]"))
    closing = opening + 1
    body = F.when(s.startswith("[ROLE]"), F.get(other, F.lit(1))).otherwise(F.substring(s, opening + 1, F.length(s) - opening - closing))
    trained = F.substring(s, (F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return segments.select("conv_id", "n", role.alias("role"), unescape(body).alias("text"), unescape(trained).alias("trained"), F.length(s).alias("chars"))


#: A formatted turn; no control string stands inside.
TURN = r"(?s)\[INST\].*?\[/INST\]|<s>.*?</s>|\[SYS\].*?\[/SYS\]|\[ROLE\].*?\[/ROLE\]"


def turns_of(text: Column) -> Column:
    """Role and text of each turn of a formatted text, as an array."""

    def turn(s: Column) -> Column:
        other = F.split(F.substring(s, len("[ROLE]") + 1, F.length(s) - len("[ROLE][/ROLE]")), r"\[TEXT\]", 2)
        inside = lambda mark: F.substring(s, len(mark) + 1, F.length(s) - 2 * len(mark) - 1)
        role = F.when(s.startswith("[INST]"), "user").when(s.startswith("<s>"), "assistant").when(s.startswith("[SYS]"), "system").otherwise(unescape(other[0]))
        body = F.when(s.startswith("[INST]"), inside("[INST]")).when(s.startswith("<s>"), inside("<s>")).when(s.startswith("[SYS]"), inside("[SYS]")).otherwise(F.get(other, F.lit(1)))
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    return F.transform(F.regexp_extract_all(text, F.lit(TURN), 0), turn)


def digests(conversations: DataFrame) -> DataFrame:
    """Counts and digests of every conversation: turns read back from its last example, losses from the spans of all."""
    masked = F.substring("text", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    losses = F.array_sort(F.collect_list(F.struct("n", F.coalesce(unescape(masked), F.lit("")).alias("trained"))))
    grouped = examples(example_segments(conversations)).groupBy("conv_id", "lone").agg(losses.alias("l"), F.max_by("text", "n").alias("text"))
    grouped = grouped.select("conv_id", turns_of(F.col("text")).alias("t"), F.array_join(F.transform("l", lambda x: x["trained"]), "").alias("loss"), F.length("text").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return grouped.select("conv_id", F.size("t").cast("long").alias("n_turns"), sha256_hex(said).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha256_hex(F.col("loss")).alias("loss_sha256"), "formatted_chars")


def op8_chat_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are made of control strings."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return digests(table.unionByName(hard))


#: The formatted length: a turn's text with one more character for each backslash or control string, and its marks.
_ESCAPED = r"length(text) + length(regexp_replace(text, '[^\\]', '', 'g')) + len(regexp_extract_all(text, '\[/?(?:INST|SYS|ROLE)\]|\[TEXT\]|</?s>'))"
OP8_SQL = rf"""
WITH t AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS lone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({_ESCAPED} + CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 11 END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id, lone
"""
