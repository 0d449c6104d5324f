"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is ``<|im_start|>role\\ntext<|im_end|>\\n``. Each turn is first rendered as it is and read back by the parser; if
the parser does not recover it, its conflicting content is escaped (one backslash goes into every ``<|``, ``<\\|``,
``<\\\\|`` ...; the parser takes one out), after which it reads back identically. The parser splits at start marks, takes
the role up to the first line feed and the text up to the first end mark, and undoes the escapes. The loss mask is a list
of spans of the rendered text; the text under it is read from there, not from the turns.

Defined cases: null text and null role are empty; rows of a conversation go by turn, null turns first, then role and
text, so repeated rows stay and ties are settled; a null conv_id is a conversation of its own; a table without rows gives
none; columns other than the four named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelane.llm.arrays import blocks, let

START, END = "<|im_start|>", "<|im_end|>"
SPANS_TYPE = "array<struct<start:bigint,length:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def _role_out(role: Column) -> Column:
    """Roles stand on one line: a line feed becomes ~1, a tilde ~0."""
    return F.replace(F.replace(role, F.lit("~"), F.lit("~0")), F.lit("\n"), F.lit("~1"))


def _role_in(role: Column) -> Column:
    return F.replace(F.replace(role, F.lit("~1"), F.lit("\n")), F.lit("~0"), F.lit("~"))


def _render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END + "\n"))


def parse(formatted: Column) -> Column:
    """The turns that the grammar reads from a formatted conversation."""
    parts = F.split(formatted, r"<\|im_start\|>", -1)

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        body = F.substr(part, F.length(head) + 2)
        return F.struct(_role_in(unescape(head)).alias("role"), unescape(F.substring_index(body, END, 1)).alias("text"))

    return F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv, n_turns, formatted, loss_spans (start and length in code points of formatted),
    n_escaped (turns that had to be escaped), round_trip (the parser recovers every source turn)."""
    empty = F.lit("")
    turns = rows.select(
        F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(F.col(role).cast("string"), empty).alias("_role"), F.coalesce(F.col(text).cast("string"), empty).alias("_text")
    )
    plain = _render(_role_out(F.col("_role")), F.col("_text"))
    same = parse(plain) == F.array(F.struct(F.col("_role").alias("role"), F.col("_text").alias("text")))
    turns = turns.withColumn("_safe", same)
    role_out = F.when(F.col("_safe"), _role_out(F.col("_role"))).otherwise(escape(_role_out(F.col("_role"))))
    text_out = F.when(F.col("_safe"), F.col("_text")).otherwise(escape(F.col("_text")))
    turns = turns.withColumns({"_r": role_out, "_t": text_out}).withColumn("_out", _render(F.col("_r"), F.col("_t")))
    order = Window.partitionBy("_conv").orderBy(F.col("_turn").asc_nulls_first(), "_role", "_text")
    turns = turns.withColumns(
        {
            "_pos": F.row_number().over(order),
            "_off": F.coalesce(F.sum(F.length("_out")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        }
    )
    start = F.col("_off") + len(START) + F.length("_r") + 1
    turns = turns.withColumn("_span", F.when(F.col("_role") == trained_role, F.struct(start.alias("start"), F.length("_t").cast("long").alias("length"))))
    whole = turns.groupBy("_conv").agg(
        F.sort_array(F.collect_list(F.struct("_pos", "_out", "_role", "_text", "_span", "_safe"))).alias("_turns")
    )
    formatted = F.array_join(F.transform("_turns", lambda x: x["_out"]), "")
    source = F.transform("_turns", lambda x: F.struct(x["_role"].alias("role"), x["_text"].alias("text")))
    spans = F.filter(F.transform("_turns", lambda x: x["_span"]), lambda x: x.isNotNull())
    return whole.withColumn("_formatted", formatted).select(
        F.col("_conv").alias(conv),
        F.size("_turns").cast("long").alias("n_turns"),
        F.col("_formatted").alias("formatted"),
        spans.alias("loss_spans"),
        F.size(F.filter("_turns", lambda x: ~x["_safe"])).cast("long").alias("n_escaped"),
        (parse(F.col("_formatted")) == source).alias("round_trip"),
    )


def masked_text(formatted: Column, spans: Column) -> Column:
    """What the mask covers: the stretches at the spans (sorted, apart), unescaped each and joined with nothing between.

    A stretch is cut out of the part of the text that a block of spans lies in, so a span far on costs no walk from the
    start of the whole text."""

    def cut(part: Column) -> Column:
        first, last = F.get(part, F.lit(0)), F.get(part, F.size(part) - 1)
        piece = F.substr(formatted, (first["start"] + 1).cast("int"), (last["start"] + last["length"] - first["start"]).cast("int"))
        texts = lambda h: F.transform(part, lambda s: unescape(F.substr(h["piece"], (s["start"] - h["at"] + 1).cast("int"), s["length"].cast("int"))))
        return F.array_join(let(F.struct(first["start"].alias("at"), piece.alias("piece")), texts), "")

    return F.array_join(F.transform(blocks(spans), cut), "")


def read_chats(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Reads formatted conversations back: conv, turns by the parser, loss_text by the mask (the stretches of formatted at
    loss_spans, unescaped and joined)."""
    return formatted.withColumns({"turns": parse(F.col("formatted")), "loss_text": masked_text(F.col("formatted"), F.col("loss_spans"))})
