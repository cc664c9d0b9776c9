"""Chat formatting with typed content parts, in native column expressions.

A visitor over the parts of a message flattens text, image, audio and document parts into one string with ordered
placeholders, records every attachment with the token count its placeholder expands to, and the turns of a
conversation become one marked string with the spans that carry the loss.

Template: ``<|im_start|>role\\n`` content ``<|im_end|>\\n``. Inside texts and roles each ``<``, run of ``!``, ``|`` gets
one more ``!``, so no marker can come from data; unescaping takes it away again. Roles also have ``%`` and line feeds
percent-coded, as a line feed ends the role.

Work is one shuffle by conversation (window and grouping share it); a conversation is the unit of the result, so a
task holds one conversation at a time.

Defined cases: null text, role or parts count as empty; rows with equal turn are ordered by role, then content;
repeated rows are turns of their own; an empty table gives no conversations; other input columns are ignored; a null
conversation id forms a conversation; a conversation, however long its texts, is one row and is held by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


@dataclass(frozen=True)
class Expansion:
    """How many tokens a placeholder stands for."""

    patch: int = 14
    merge: int = 2
    audio_tokens_per_second: float = 12.5
    tokens_per_page: int = 256


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(!*)\|", r"<!$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<!(!*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def expanded_tokens(part: Column, e: Expansion = Expansion()) -> Column:
    """Tokens that a part's placeholder expands to: patches of an image, time slices of audio, pages of a document."""
    side = e.patch * e.merge
    grid = lambda n: F.ceil(F.coalesce(n, F.lit(side)) / side)
    return (
        F.when(part["type"] == "image", grid(part["width"]) * grid(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * e.audio_tokens_per_second))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(1)) * e.tokens_per_page)
        .otherwise(0)
        .cast("long")
    )


def visit(part: Column) -> Column:
    """A part as text: text parts escaped, attachments as typed placeholders, unknown types as nothing."""
    return (
        F.when(F.coalesce(part["type"], F.lit("text")) == "text", escape(F.coalesce(part["text"], F.lit(""))))
        .when(part["type"].isin("image", "audio", "document"), F.concat(F.lit("<|"), part["type"], F.lit("|>")))
        .otherwise("")
    )


def flatten_parts(parts: Column, e: Expansion = Expansion()) -> Column:
    """Struct of content, attachments (position, type, ref, n_tokens; in order) and expanded_tokens."""
    own = F.coalesce(parts, F.expr(f"cast(array() as {PARTS})"))
    kinds = F.filter(own, lambda p: p["type"].isin("image", "audio", "document"))
    attached = F.transform(kinds, lambda p, k: F.struct(k.alias("position"), p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p, e).alias("n_tokens")))
    return F.struct(
        F.array_join(F.transform(own, visit), "").alias("content"),
        attached.alias("attachments"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda a, x: a + x["n_tokens"]).alias("expanded_tokens"),
    )


def text_part(text: Column) -> Column:
    """A plain text as an array of one text part."""
    void = lambda kind: F.lit(None).cast(kind)
    part = F.struct(
        F.lit("text").alias("type"), text.alias("text"), void("string").alias("ref"), void("int").alias("width"),
        void("int").alias("height"), void("double").alias("seconds"), void("int").alias("pages"),
    )
    return F.array(part)


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: str = "assistant", e: Expansion = Expansion()) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start, length in code points), attachments, n_tokens_expanded.

    Spans cover the escaped content of ``trained`` turns, without markers; attachments of all turns are in order.
    """
    flat = df.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), flatten_parts(F.col(parts), e).alias("flat")
    ).select("conv_id", "turn", "role", F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")).alias("head"), "flat.content", "flat.attachments", "flat.expanded_tokens")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content", "attachments")
    size = F.length("head") + F.length("content") + len(END)
    placed = flat.withColumn("n", F.row_number().over(order)).withColumn(
        "at", F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long") + F.length("head")
    )
    turns = F.sort_array(F.collect_list(F.struct("n", "role", "head", "content", "at", "attachments", "expanded_tokens")))
    return placed.groupBy("conv_id").agg(turns.alias("turns")).select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["content"], F.lit(END))), "").alias("formatted"),
        F.transform(
            F.filter("turns", lambda t: t["role"] == trained), lambda t: F.struct(t["at"].alias("start"), F.length(t["content"]).cast("long").alias("length"))
        ).alias("loss_spans"),
        F.flatten(F.transform("turns", lambda t: t["attachments"])).alias("attachments"),
        F.aggregate("turns", F.lit(0).cast("long"), lambda a, t: a + t["expanded_tokens"]).alias("n_tokens_expanded"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) parsed back from a formatted conversation; placeholders of attachments stay in the text."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    whole = F.slice(pieces, 1, F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        body = F.substring(piece, F.lit(len(START) + 1), F.length(piece))
        cut = F.instr(body, "\n")
        return F.struct(
            unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(body, cut + 1, F.length(body))).alias("text"),
        )

    return F.transform(whole, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
