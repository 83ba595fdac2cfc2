"""Chat formatting with typed content parts, a reversible escape and a loss mask.

Everything here is built from DataFrame functions.

A conversation is written as one string. Each turn is
``<|turn|>role<|sep|>body<|end|>``; body is the turn's parts, visited in order: a text
part gives its escaped text, an image, audio or document part gives the placeholder
``<|image:k|>`` (``audio``, ``document``), where k numbers the conversation turn's
attachments from 0. An attachment's ``tokens`` is what the placeholder expands to.

Escape: texts and roles get one more backslash inside anything that looks like a
control string of this or another common template: ``<|``, ``<s>``, ``</s>``,
``[INST]``, ``[/INST]``, with any number of backslashes after the first character.
Unescaping takes one backslash out again, so that every text comes back as it was
and no formatted text holds a control string that the template did not write.

Defined results: a null text is an empty text and a null role an empty role; a null
list of parts, an empty list and null parts give an empty body; a part of unknown
kind counts as text. Turns are ordered by turn, then role, then body (ties and
repeated rows stay, side by side); null turns come last. A null conversation id is a
conversation of its own. Columns other than those named are ignored. A conversation
is one output string, so its turns meet in one task by definition of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SEP, END = "<|turn|>", "<|sep|>", "<|end|>"
CONTROL = r"([<\[])(\\*)(\||/?s>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|/?INST\])"

#: Expanded tokens of an attachment: pixels a side for an image patch, audio tokens
#: a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 256

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def text_part(text: Column) -> Column:
    """A turn that has only text, as a list of one part."""
    null = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("kind"), text.alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"),
            null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages"),
        )
    )


def _is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin("image", "audio", "document"), F.lit(False))


def _tokens(part: Column) -> Column:
    side = lambda name: F.ceil(F.coalesce(part[name], F.lit(0)) / PATCH)
    return (
        F.when(part["kind"] == "image", side("width") * side("height"))
        .when(part["kind"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE))
        .otherwise(F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS)
        .cast("long")
    )


def visit(parts: Column) -> tuple[Column, Column]:
    """The visitor over one turn's parts: (body, attachments).

    ``attachments`` are structs (position, kind, ref, tokens) in placeholder order.
    """
    some = F.filter(F.coalesce(parts, F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    held = F.filter(some, _is_attachment)
    attachments = F.transform(
        held, lambda p, k: F.struct(k.alias("position"), p["kind"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))
    )
    start = F.struct(F.lit("").alias("body"), F.lit(0).alias("n"))
    folded = F.aggregate(
        some,
        start,
        lambda acc, p: F.struct(
            F.concat(
                acc["body"],
                F.when(_is_attachment(p), F.concat(F.lit("<|"), p["kind"], F.lit(":"), acc["n"].cast("string"), F.lit("|>"))).otherwise(
                    escape(F.coalesce(p["text"], F.lit("")))
                ),
            ).alias("body"),
            (acc["n"] + _is_attachment(p).cast("int")).alias("n"),
        ),
        lambda acc: acc["body"],
    )
    return folded, attachments


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Formats ``turns`` (conv_id, turn, role, parts) into one row per conversation:
    conv_id, n_turns, formatted, loss_spans (start, length in code points of
    ``formatted``), attachments (with their turn's index) and n_attachment_tokens.
    """
    body, attachments = visit(F.col("parts"))
    rows = turns.select(
        "conv_id",
        F.struct(
            F.coalesce(F.col("turn").isNull(), F.lit(True)).alias("last"), F.col("turn").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"), body.alias("body"), attachments.alias("attachments"),
        ).alias("t"),
    )
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(SEP))
    length = lambda t: F.char_length(head(t)) + F.char_length(t["body"]) + len(END)
    ends = F.aggregate(
        "ts",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + length(t)).alias("at"),
            F.when(
                t["role"] == loss_role,
                F.concat(
                    acc["spans"],
                    F.array(
                        F.struct(
                            (acc["at"] + F.char_length(head(t))).cast("long").alias("start"), F.char_length(t["body"]).cast("long").alias("length")
                        )
                    ),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    listed = F.flatten(
        F.transform(
            "ts",
            lambda t, i: F.transform(
                t["attachments"],
                lambda a: F.struct(
                    i.alias("turn_index"), a["position"].alias("position"), a["kind"].alias("kind"), a["ref"].alias("ref"), a["tokens"].alias("tokens")
                ),
            ),
        )
    )
    return whole.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: F.concat(head(t), t["body"], F.lit(END))), "").alias("formatted"),
        ends.alias("loss_spans"),
        listed.alias("attachments"),
    ).withColumn("n_attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_turns(formatted: Column) -> Column:
    """Back from a formatted string: an array of structs (role, text), unescaped.

    Text holds an attachment's placeholder as it was written.
    """
    marked = F.filter(F.split(formatted, r"<\|turn\|>"), lambda s: s != "")
    halves = F.transform(marked, lambda s: F.split(s, r"<\|sep\|>"))
    return F.transform(
        halves,
        lambda h: F.struct(unescape(h[0]).alias("role"), unescape(F.regexp_replace(h[1], r"<\|end\|>\z", "")).alias("text")),
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, with nothing between."""
    return F.array_join(
        F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))), ""
    )
