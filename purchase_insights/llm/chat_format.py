"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted, adjacent turns of
one role are merged to a block, whose texts are aggregated, and the blocks are concatenated::

    <|im_start|>user\\n first text <|im_sep|> next text of the same role <|im_end|>\\n

(without the spaces). Texts and roles are escaped, ``&`` as ``&amp;`` and ``<|`` as
``&lt;|`` (and a line break in a role as ``&nl;``), so a control string in the
output is always one of the template's, and the output can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_runs.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. Order is
    by turn, then role and text; repeated rows are repeated turns. A missing text
    or role is empty, a missing turn comes first, and rows without a conv_id form
    the conversation NULL. No rows give no conversations.

    ``loss_runs`` covers ``formatted`` as runs of (chars, loss), in code points: for
    each turn what precedes its text, then its text; at last the closing mark. Runs
    with ``loss`` hold the texts of ``loss_role``, without marks between them.

    A conversation is one output value and is put together in one task; nothing
    else is gathered. Its blocks are slices between the turns whose role is new, so the
    time is in proportion to its length.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("&nl;"))
    turn = F.struct(
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        role.alias("header"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    positions = F.sequence(F.lit(0), F.size("turns") - 1)
    new_role = F.filter(positions, lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]))
    cut = grouped.select("conv_id", "turns", new_role.alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns")))
    merged = F.zip_with("starts", ends, lambda start, end: F.slice("turns", start + 1, end - start))
    blocks = cut.select("conv_id", merged.alias("blocks"))

    def text_of(block: Column) -> Column:
        texts = F.array_join(F.transform(block, lambda turn: escape(turn["text"])), SEPARATOR)
        return F.concat(F.lit(START), F.get(block, F.lit(0))["header"], F.lit("\n"), texts, F.lit(f"{END}\n"))

    def runs_of(block: Column, number: Column) -> Column:
        opening = F.when(number == 0, 0).otherwise(len(END) + 1) + len(START) + 1

        def runs(turn: Column, place: Column) -> Column:
            mark = F.when(place > 0, len(SEPARATOR)).otherwise(opening + F.char_length(turn["header"]))
            return F.array(_run(mark, F.lit(False)), _run(F.char_length(escape(turn["text"])), turn["role"] == loss_role))

        return F.flatten(F.transform(block, runs))

    closing = F.array(_run(F.lit(len(END) + 1), F.lit(False)))
    return blocks.select(
        "conv_id",
        F.array_join(F.transform("blocks", text_of), "").alias("formatted"),
        F.concat(F.flatten(F.transform("blocks", runs_of)), closing).alias("loss_runs"),
    )


def _run(chars: Column, loss: Column) -> Column:
    return F.struct(chars.cast("int").alias("chars"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns in a formatted text, unescaped: array of (role, text)."""
    blocks = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda block: block != "")

    def turns(block: Column) -> Column:
        header = F.substring_index(block, "\n", 1)
        # what is left when the header, its line break and the closing mark are cut off
        body = F.substr(block, F.char_length(header) + 2, F.char_length(block) - F.char_length(header) - len(END) - 2)
        role = unescape(F.replace(header, F.lit("&nl;"), F.lit("\n")))
        return F.transform(
            F.split(body, r"<\|im_sep\|>", -1),
            lambda text: F.struct(role.alias("role"), unescape(text).alias("text")),
        )

    return F.flatten(F.transform(blocks, turns))


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output of ``format_conversations``."""
    turns = formatted.select("conv_id", "formatted", "loss_runs", read_turns(F.col("formatted")).alias("turns"))
    under_loss = F.filter("turns", lambda turn, index: F.get("loss_runs", 2 * index + 1)["loss"])
    loss = F.array_join(F.transform(under_loss, lambda turn: turn["text"]), "")
    listed = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(listed, ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), marked AS (
  SELECT *, replace(replace(text, '&', '&amp;'), '<|', '&lt;|') AS escaped,
         replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;') AS header,
         COALESCE(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) = role, FALSE) AS merged
  FROM turns
)
SELECT conv_id, COUNT(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(SUM(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(COALESCE(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), ''))
         AS loss_sha256,
       CAST(SUM(length(escaped) + CASE WHEN merged THEN 10 ELSE 24 + length(header) END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
