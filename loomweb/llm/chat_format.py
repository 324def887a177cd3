"""Operator 5, chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are the context and
only its reply is trainable.  Turns that follow the last reply form one more example without a
trainable part, so that a conversation can be read back whole from its last example.

Template: each turn is ``<s>`` + role + newline + text + ``</s>``.  Inside roles and texts a
backslash, ``<`` and ``[`` are written ``\\b``, ``\\l`` and ``\\o`` (in roles a newline is
``\\e``), hence no text can contain a control string such as ``</s>`` or ``[INST]``.

Defined results: null role or text: empty; turns tie: ordered by role, then text; repeated rows:
repeated turns; null conv_id: a conversation like others; no rows: no examples; other columns are
ignored.  One conversation is one training record, hence has to fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomweb.llm.shared import table

OPEN, CLOSE = "<s>", "</s>"
ESCAPES = [("\\", "\\b"), ("<", "\\l"), ("[", "\\o")]
ROLE_ESCAPES = [*ESCAPES, ("\n", "\\e")]


def escape(text: Column, pairs=ESCAPES) -> Column:
    for plain, escaped in pairs:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for plain, escaped in reversed(pairs):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def format_chat(conversations: DataFrame) -> DataFrame:
    """conv_id, example, n_turns, is_last, formatted, loss_start, loss_end (code points; null: nothing is trainable)."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    rendered = whole.select(
        "conv_id",
        F.size("turns").alias("n_turns"),
        F.transform("turns", lambda t: t["role"] == "assistant").alias("replies"),
        F.transform(
            "turns",
            lambda t: F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit("\n"), escape(t["text"]), F.lit(CLOSE)),
        ).alias("parts"),
    )
    # Only positions are exploded; each prefix is put together in its own row.
    at = rendered.select("*", F.explode(F.sequence(F.lit(1), F.col("n_turns"))).alias("example"))
    at = at.select("*", F.element_at("replies", F.col("example")).alias("is_reply")).filter(
        F.col("is_reply") | (F.col("example") == F.col("n_turns"))
    )
    examples = at.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("n_turns").cast("long").alias("n_turns"),
        (F.col("example") == F.col("n_turns")).alias("is_last"),
        "is_reply",
        F.array_join(F.slice("parts", F.lit(1), F.col("example")), "").alias("formatted"),
        F.char_length(F.element_at("parts", F.col("example"))).alias("part_chars"),
    )
    length = F.char_length("formatted")
    start = length - F.col("part_chars") + len(OPEN) + len("assistant\n")
    return examples.select(
        "conv_id",
        "example",
        "n_turns",
        "is_last",
        "formatted",
        F.when(F.col("is_reply"), start).alias("loss_start"),
        F.when(F.col("is_reply"), length - len(CLOSE)).alias("loss_end"),
    )


def parse_chat(formatted: Column) -> Column:
    """array<struct<role, text>> from a formatted example."""
    parts = F.filter(F.split(formatted, CLOSE), lambda p: p != "")
    body = lambda p: F.substr(p, F.lit(len(OPEN) + 1))
    cut = lambda p: F.instr(p, "\n")
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape(F.substr(body(p), F.lit(1), cut(body(p)) - 1), ROLE_ESCAPES).alias("role"),
            unescape(F.substr(body(p), cut(body(p)) + 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, unescaped."""
    return unescape(F.substr(formatted, start + 1, end - start))


def with_probe(conversations: DataFrame) -> DataFrame:
    """Adds conversation -1, whose texts look like control strings."""
    text = "</s>[INST] ok [/INST]"
    probe = conversations.sparkSession.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{text}'), (-1L, 1L, 'assistant', '{text}') AS probe(conv_id, turn, role, text)")
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = format_chat(with_probe(table(spark, sf_dir, "conversations")))
    reply = F.when(F.col("loss_start").isNotNull(), loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end")))
    read = examples.select(
        "conv_id",
        "example",
        "n_turns",
        F.when(F.col("is_last"), F.col("formatted")).alias("whole"),
        reply.alias("reply"),
        F.char_length("formatted").cast("long").alias("chars"),
    )
    by_conv = read.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"),
        F.max("whole").alias("whole"),
        F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("replies"),
        F.sum("chars").alias("formatted_chars"),
        F.count("reply").alias("n_examples"),
    )
    loss = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    turns = F.array_join(
        F.transform(parse_chat(F.col("whole")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    return by_conv.select(
        "conv_id",
        "n_turns",
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    sum(8 + length(role) + length(text)
      + (length(role) + length(text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '[', '')))
      + (length(role) - length(replace(role, chr(10), '')))) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS prefix
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, CAST(max(n_turns) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(prefix) FILTER (role = 'assistant' OR n = n_turns) AS BIGINT) AS formatted_chars,
  count(*) FILTER (role = 'assistant') AS n_examples
FROM numbered GROUP BY conv_id
"""
