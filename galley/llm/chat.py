"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns as context, and only that reply
trainable. Turns are rendered as ``<|turn|>role<|text|>text<|end|>``. Inside roles and texts a backslash is
doubled and one is put behind every ``<`` and ``[``, so no control string, of this template or another
(``[INST]``, ``</s>``), can stand there, and reading back restores every text.

All steps are DataFrame expressions. A conversation's turns meet in one row, as its rendering asks; its
examples are then prefixes of one array of rendered turns and stream out of that row one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
TARGET = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.replace(F.regexp_replace(text, r"([<\[])\\", "$1"), F.lit("\\\\"), F.lit("\\"))


def prefix_targets(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """Examples ``(conv, n_turns, text, loss_start, loss_end)``; the loss mask is a range of code points.

    ``n_turns`` counts the turns an example holds, its target being the last. Turns that no reply follows are
    kept as an example whose mask is empty, so that a conversation can be read back whole from its longest
    example. Turns go by their number, a null first, then by role and text; repeated rows are turns of their
    own, and null roles and texts are empty. Rows with a null conversation form one conversation.
    """
    rows = turns.select(
        F.col(conv), F.struct(
            F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("turn"))
    whole = rows.groupBy(conv).agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    rendered = whole.select(conv, F.transform("turns", lambda t: F.struct(
        t["role"].eqNullSafe(TARGET).alias("target"), F.length(escape(t["text"])).alias("size"),
        F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(END)).alias("shown"))).alias("turns"))
    last = F.size("turns")
    ends = F.filter(F.sequence(F.lit(1), last), lambda n: F.element_at("turns", n)["target"] | (n == last))
    examples = rendered.select(conv, "turns", F.explode(ends).alias("n_turns"))
    examples = examples.select(
        conv, F.col("n_turns").cast("bigint").alias("n_turns"), F.element_at("turns", F.col("n_turns")).alias("final"),
        F.array_join(F.transform(F.slice("turns", 1, F.col("n_turns")), lambda t: t["shown"]), "").alias("text"))
    stop = F.length("text") - len(END)
    return examples.select(
        conv, "n_turns", "text", F.when(F.col("final.target"), stop - F.col("final.size")).otherwise(stop).alias("loss_start"),
        stop.alias("loss_end"))


def read_turns(text: Column) -> Column:
    """Turns ``array<struct<role, text>>`` of a formatted text."""
    shown = F.slice(F.split(text, r"<\|turn\|>", -1), 2, F.size(F.split(text, r"<\|turn\|>", -1)) - 1)
    parts = F.transform(shown, lambda t: F.split(F.substring(t, F.lit(1), F.length(t) - len(END)), r"<\|text\|>", -1))
    return F.transform(parts, lambda p: F.struct(
        unescape(F.get(p, F.lit(0))).alias("role"), unescape(F.get(p, F.lit(1))).alias("text")))


def read_loss(text: Column, start: Column, end: Column) -> Column:
    """The trainable text of an example."""
    return unescape(F.substring(text, start + 1, end - start))
