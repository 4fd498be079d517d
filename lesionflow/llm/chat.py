r"""Conversations as training text, in Spark expressions only.

Turns of a conversation are collected as structs, sorted by (turn, role, text), and adjacent turns of one
role become one block:

    <|im_start|>role<|im_sep|>text[<|im_cont|>text ...]<|im_end|>

Inside roles and texts ``\`` becomes ``\\`` and ``<|`` becomes ``<\|``, so no control string can occur
there and ``unescape`` restores them exactly. ``segments`` is the same output in pieces, each with its
place under the loss mask: assistant texts are under it, control strings and all else are not.

Null text and null role count as empty; a null turn sorts first; repeated turns stay, in the order of
their text; an empty table gives no rows; further columns are ignored. A conversation is one output row,
so its turns meet in one task; conversations themselves are spread by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, CONT, END = "<|im_start|>", "<|im_sep|>", "<|im_cont|>", "<|im_end|>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\([\\|])", "$1")


def format_chat(turns: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, segments array<struct<text, loss>>, formatted."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    rows = rows.withColumn("starts", F.expr("filter(sequence(1, size(turns)), i -> i = 1 OR turns[i - 1].role <> turns[i - 2].role)"))
    rows = rows.withColumn("blocks", F.expr("transform(starts, (s, k) -> struct(turns[s - 1].role AS role, slice(turns, s, coalesce(get(starts, k + 1), size(turns) + 1) - s) AS turns))"))

    def piece(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def block(b: Column) -> Column:
        head = F.array(piece(F.concat(F.lit(START), escape(b["role"]), F.lit(SEP)), F.lit(False)))
        body = F.flatten(F.transform(b["turns"], lambda t, i: F.array(piece(F.when(i > 0, CONT).otherwise(""), F.lit(False)), piece(escape(t["text"]), b["role"] == trained_role))))
        return F.concat(head, body, F.array(piece(F.lit(END), F.lit(False))))

    rows = rows.select("conv_id", F.flatten(F.transform("blocks", block)).alias("segments"))
    return rows.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def parse_chat(formatted: Column) -> Column:
    """The turns array<struct<role, text>> of a formatted conversation."""
    def quoted(x: str) -> str:
        return "\\Q" + x + "\\E"

    def turns(block: Column) -> Column:
        sides = F.split(F.substring(block, len(START) + 1, 2_147_483_647), quoted(SEP), -1)
        role = unescape(sides[0])
        return F.transform(F.split(sides[1], quoted(CONT), -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    blocks = F.split(formatted, quoted(END), -1)
    return F.flatten(F.transform(F.slice(blocks, 1, F.size(blocks) - 1), turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
