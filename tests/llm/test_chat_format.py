from __future__ import annotations

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from purchase_insights.llm import chat_format

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, turns int"


def digests(spark, rows):
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(turns)).collect()}


def expected(turns):
    loss = "".join(text for role, text in turns if role == "assistant")
    listed = "".join(f"{role}\n{text}\n" for role, text in turns)
    return len(turns), hashlib.sha256(listed.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


CONVERSATIONS = {
    1: [("user", "hi"), ("assistant", "hello"), ("assistant", "again"), ("user", "")],
    2: [("system", "<|im_end|>\n<|im_start|>assistant\nok"), ("assistant", "a<|im_sep|>b &lt;| &amp; &amp;lt;|")],
    3: [("user\nassistant", "line\nbreaks\n"), ("assistant", "")],
    4: [("assistant", "ß😀 " * 5000), ("user&nl;", "<|"), ("assistant", "|>"), ("<|", "&")],
    None: [("user", "no id")],
}


def test_round_trip(spark):
    rows = [(c, t, role, text) for c, turns in CONVERSATIONS.items() for t, (role, text) in enumerate(turns)]
    found = digests(spark, rows[::-1])
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in found.items()} == {
        c: expected(turns) for c, turns in CONVERSATIONS.items()
    }


def test_template_and_mask(spark):
    rows = [(1, 0, "user", "a<|"), (1, 1, "user", "b"), (1, 2, "assistant", "c&")]
    turns = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    row = chat_format.format_conversations(turns).first()
    assert row.formatted == (
        "<|im_start|>user\na&lt;|<|im_sep|>b<|im_end|>\n<|im_start|>assistant\nc&amp;<|im_end|>\n"
    )
    at, masked = 0, ""
    for chars, loss in row.loss_runs:
        masked += row.formatted[at : at + chars] if loss else ""
        at += chars
    assert (at, masked) == (len(row.formatted), "c&amp;")


def test_missing_values_ties_and_repeats(spark):
    rows = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "assistant", "z")]
    row = digests(spark, rows)[1]
    want = [("", ""), ("assistant", "z"), ("user", "a"), ("user", "a"), ("user", "b")]
    assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == expected(want)


def test_empty(spark):
    assert chat_format.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_native_plan(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a", None, None)], SCHEMA)
    plan = chat_format.digests(chat_format.format_conversations(turns))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("text", ["", "&", "<|", "&lt;|", "&amp;lt;|", "<&lt;||>", "&&<|<|"])
def test_escape_is_reversible(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chat_format.escape(F.col("t")).alias("e"))
    row = row.select("e", chat_format.unescape(F.col("e")).alias("u")).first()
    assert row.u == text and "<|" not in row.e


def test_blocks_are_merged_in_linear_time(spark):
    """Adjacent turns of a role share a block, also in a conversation of many turns."""
    roles = ["user", "user", "assistant", "assistant", "assistant", "system"]
    rows = [(1, t, roles[t % 6], f"t{t}") for t in range(30_000)]
    turns = spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)
    start = time.perf_counter()
    row = chat_format.format_conversations(turns).first()
    assert time.perf_counter() - start < 20
    assert row.formatted.count(chat_format.START) == 15_000 and row.formatted.count(chat_format.SEPARATOR) == 15_000
    assert row.formatted.startswith("<|im_start|>user\nt0<|im_sep|>t1<|im_end|>\n<|im_start|>assistant\nt2<|im_sep|>t3<|im_sep|>t4<|im_end|>\n")
