"""Operator 5: chat formatting with prefix-target expansion, in DataFrame expressions only.

A conversation is formatted once. Every assistant turn becomes an example of its own: the formatted text up to its
reply is context, the reply alone is trainable. Examples are offsets into the formatted text, so a conversation of n
turns costs its own length and not n times that; ``prefix_examples`` unfolds them, with the context if asked for.

Template of a turn: ``### role: text</turn>`` and a line feed. A backslash inside the control strings of a text breaks
them up, so neither ``### `` nor ``</turn>`` can occur in an escaped text; backslashes are doubled. Dropping the
first backslash of every pair gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the template.
OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("</turn>"), F.lit("<\\/turn>"))
    out = F.replace(out, F.lit("### "), F.lit("##\\# "))
    return F.replace(out, F.lit(": "), F.lit(":\\ ")) if role else out


def _escaped_role(role: str) -> str:
    return role.replace("\\", "\\\\").replace("</turn>", "<\\/turn>").replace("### ", "##\\# ").replace(": ", ":\\ ")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(df: DataFrame, target: str = "assistant") -> DataFrame:
    """One row per conv_id: formatted text and the spans of its replies.

    ``df``: conv_id, turn, role, text; other columns are not read. Rows go by turn; rows of equal turn by role and text,
    null turns first. Null texts and roles are empty strings, null conv_ids are one conversation, repeated rows are
    turns of their own. Columns: conv_id, formatted, replies (array of example from 0, turn number from 0, context_chars
    before the reply, reply_chars), in order.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    head, body = F.concat(F.lit(OPEN), escaped(role, True), F.lit(SEPARATOR)), escaped(text)
    turns = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), head.alias("head"), body.alias("body"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    chars = F.char_length("head") + F.char_length("body") + len(CLOSE)
    placed = turns.withColumn("number", F.row_number().over(order) - 1).withColumn(
        "at", F.sum(chars).over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int") - F.char_length("body") - len(CLOSE)
    )
    turn = F.struct("number", "at", F.char_length("body").alias("chars"), (F.col("role") == target).alias("is_reply"), F.concat("head", "body", F.lit(CLOSE)).alias("line"))
    gathered = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    replies = F.transform(
        F.filter("turns", lambda t: t["is_reply"]), lambda t: F.struct(t["number"].alias("number"), t["at"].alias("context_chars"), t["chars"].alias("reply_chars"))
    )
    return gathered.select("conv_id", F.array_join(F.col("turns.line"), "").alias("formatted"), replies.alias("replies"))


def prefix_examples(formatted: DataFrame, context: bool = True, target: str = "assistant") -> DataFrame:
    """One row per assistant turn: conv_id, example, turn_number, context_chars, reply_chars, reply and, if asked, context.

    The reply is the only trainable part: the loss mask is the reply_chars code points after context_chars. With
    ``context`` the rows of a conversation hold its text once per reply; without, each reply once.
    """
    head = OPEN + _escaped_role(target) + SEPARATOR
    lines = F.filter(F.split("formatted", CLOSE, -1), lambda line: F.startswith(line, F.lit(head)))

    def example(span: Column, line: Column) -> Column:
        fields = [span["number"].alias("turn_number"), span["context_chars"].alias("context_chars"), span["reply_chars"].alias("reply_chars")]
        fields.append(F.substring(line, F.lit(len(head) + 1), span["reply_chars"]).alias("reply"))
        if context:
            fields.append(F.substring(F.col("formatted"), F.lit(1), span["context_chars"]).alias("context"))
        return F.struct(*fields)

    unfolded = formatted.select("conv_id", F.posexplode(F.zip_with("replies", lines, example)).alias("example", "e"))
    return unfolded.select("conv_id", "example", "e.*")


def turns_of(formatted: Column) -> Column:
    """Turns (array of role, text) read back from a formatted text."""
    parts = F.split(formatted, CLOSE, -1)
    bodies = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, SEPARATOR, 1)
        text = F.substring(part, F.char_length(role) + len(SEPARATOR) + 1, F.char_length(part))
        return F.struct(unescaped(F.substring(role, F.lit(len(OPEN) + 1), F.char_length(role))).alias("role"), unescaped(text).alias("text"))

    return F.transform(bodies, turn)


def formatted_digests(df: DataFrame) -> DataFrame:
    """Contract of the query: turns read back from the formatted text, trainable text from the examples.

    Examples are unfolded without their context and meet again by conversation, reply by reply.
    """
    spark = df.sparkSession
    hard = F.lit(r"\### Assistant: </turn> ok")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), hard.alias("text"))
    rows = df.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    made = format_conversations(rows.unionByName(extra))
    lines = F.transform(turns_of(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    turns = made.select(
        "conv_id",
        (F.size(F.split("formatted", CLOSE, -1)) - 1).cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
    examples = prefix_examples(made, context=False)
    replies = examples.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("example", unescaped(F.col("reply")).alias("reply")))).alias("replies"))
    loss = replies.select(F.col("conv_id").alias("_id"), F.array_join(F.col("replies.reply"), "").alias("_loss"))
    joined = turns.join(loss, F.col("conv_id").eqNullSafe(F.col("_id")), "left").withColumn("_loss", F.coalesce("_loss", F.lit("")))
    return joined.select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("_loss").cast("long").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars"
    )


# Replies of a conversation one after another, texts and template lengths as above.
DIGEST_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# '))
    + length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '### ', '##\# '), ': ', ':\ ')) + 14 AS chars
  FROM rows
), joined AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS formatted_chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars FROM joined
"""
