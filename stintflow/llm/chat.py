"""Event-sourced chat formatting, in DataFrame functions only.

A log holds, per message, its opening (with the role), streamed deltas, edits and regenerations. Folding
keeps what counts at the end: everything from the last edit or regeneration on, in sequence. Messages are
folded one by one, so a conversation with a large part of all events is spread over many tasks; they are
rendered in parts of a conversation, and only finished parts meet in a row.

Template. A turn is one of

    [INST] text [/INST]                     user
    <s>text</s>                             assistant
    <<SYS>>role<<:>>text<</SYS>>            any other role

Control strings inside a text get one backslash after their first character (one more where backslashes
stand there already), so none of them occurs in an escaped text and taking one backslash out restores it.
The loss mask is a list of spans, in code points of the part, over the assistant's texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the control strings of the template, without their first character
REST = r"(s>|/s>|INST\]|/INST\]|<SYS>>|<:>>|</SYS>>)"
ESCAPE = r"([<\[])(\\*)" + REST
UNESCAPE = r"([<\[])\\(\\*)" + REST
TURN = r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>|<<SYS>>.*?<<:>>.*?<</SYS>>"
OPEN, DELTA, EDIT, REGENERATE = "open", "delta", "edit", "regenerate"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def fold_events(events: DataFrame, sequence: tuple[str, ...] = ("seq",)) -> DataFrame:
    """Final messages: ``conv_id, message_id, place, role, text``.

    ``events`` has ``conv_id, message_id, kind, role, text`` and the columns of ``sequence``, which sort the
    log. An edit replaces the text so far by its own, a regeneration by nothing; deltas append. An event
    delivered twice, equal in all columns, counts once. ``place`` is the sequence of the message's first
    event. The role is that of the first opening; none or null gives the empty role. Null texts are empty.
    Messages without text stay, empty logs give no rows, and further columns are ignored.
    """
    at = F.struct(*sequence)
    reset = F.col("kind").isin(EDIT, REGENERATE)
    text = F.coalesce(F.col("text"), F.lit(""))
    folded = events.groupBy("conv_id", "message_id").agg(
        F.min(at).alias("place"),
        F.max(F.when(reset, at)).alias("since"),
        F.min(F.when(F.col("kind") == OPEN, F.struct(at.alias("at"), F.coalesce("role", F.lit("")).alias("role")))).alias("opened"),
        F.collect_set(F.when(F.col("kind").isin(EDIT, DELTA), F.struct(at.alias("at"), "kind", text.alias("text")))).alias("pieces"),
    )
    counted = F.filter("pieces", lambda p: F.col("since").isNull() | (p["at"] >= F.col("since")))
    return folded.select(
        "conv_id",
        "message_id",
        "place",
        F.coalesce("opened.role", F.lit("")).alias("role"),
        F.array_join(F.transform(F.array_sort(counted), lambda p: p["text"]), "").alias("text"),
    )


def _turn(role: Column, text: Column) -> Column:
    return (
        F.when(role == "user", F.concat(F.lit("[INST] "), text, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s>"), text, F.lit("</s>")))
        .otherwise(F.concat(F.lit("<<SYS>>"), escape(role), F.lit("<<:>>"), text, F.lit("<</SYS>>")))
    )


def render(messages: DataFrame, part: Column | None = None) -> DataFrame:
    """Rendered parts of conversations: ``conv_id, part, formatted, loss_spans, n_turns``.

    ``part`` numbers the parts of a conversation; it must not fall along ``place`` and bounds how many
    messages are rendered in one row. By default a conversation is one part. Messages of equal place are
    ordered by role and text. ``loss_spans`` holds ``start, length`` in code points, start from 0, one per
    assistant message. A null conversation id is a conversation too.
    """
    part = F.lit(0) if part is None else part
    turns = messages.select(
        "conv_id", part.cast("bigint").alias("part"), F.struct("place", "role", escape(F.col("text")).alias("text")).alias("m")
    )
    parts = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(state: Column, m: Column) -> Column:
        begin = state["at"] + len("<s>")
        span = F.struct(begin.alias("start"), F.char_length(m["text"]).alias("length"))
        spans = F.when(m["role"] == "assistant", F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + F.char_length(_turn(m["role"], m["text"]))).alias("at"), spans.alias("spans"))

    return parts.select(
        "conv_id",
        "part",
        F.array_join(F.transform("ms", lambda m: _turn(m["role"], m["text"])), "").alias("formatted"),
        F.aggregate("ms", zero, step)["spans"].alias("loss_spans"),
        F.size("ms").cast("bigint").alias("n_turns"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a rendered part as an array of ``role, text``."""

    def parse(turn: Column) -> Column:
        inner = lambda head, tail: F.substring(turn, len(head) + 1, F.char_length(turn) - len(head) - len(tail))
        other = inner("<<SYS>>", "<</SYS>>")
        split = F.locate("<<:>>", other)
        role = F.when(turn.startswith("[INST] "), "user").when(turn.startswith("<s>"), "assistant").otherwise(
            unescape(F.substring(other, F.lit(1), split - 1))
        )
        text = (
            F.when(turn.startswith("[INST] "), inner("[INST] ", " [/INST]"))
            .when(turn.startswith("<s>"), inner("<s>", "</s>"))
            .otherwise(F.substring(other, split + len("<<:>>"), F.char_length(other)))
        )
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), parse)


def masked_text(formatted: Column, spans: Column) -> Column:
    """Unescaped texts under the loss mask, as an array."""
    return F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"])))


def digests(parts: DataFrame) -> DataFrame:
    """Read back the rendered parts: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    read = parts.withColumn("turns", read_turns(F.col("formatted"))).select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.char_length("formatted").cast("bigint").alias("chars"),
        F.struct(
            "part",
            F.array_join(F.transform("turns", line), "").alias("all"),
            F.array_join(masked_text(F.col("formatted"), F.col("loss_spans")), "").alias("loss"),
        ).alias("p"),
    )
    whole = read.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list("p")).alias("ps")
    )
    text = lambda name: F.array_join(F.transform("ps", lambda p: p[name]), "")
    loss = text("loss")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(text("all").cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def conversation_log(rows: DataFrame, piece: int = 160) -> DataFrame:
    """An event log that ends in exactly the given ``conv_id, turn, role, text`` rows.

    Each row becomes an opening and deltas of ``piece`` code points; by a hash of its place some start with
    a draft that a regeneration or an edit replaces, and some deliver every event twice. Equal rows are
    messages of their own. Sequence columns: ``turn, tie, copy, step``.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))

    def deltas(text: Column) -> Column:
        last = F.greatest(F.ceil(F.char_length(text) / piece).cast("int") - 1, F.lit(0))
        cut = F.transform(F.sequence(F.lit(0), last), lambda i: event(DELTA, F.substring(text, i * piece + 1, F.lit(piece))))
        return cut.cast("array<struct<kind:string,text:string>>")

    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    whole, half = F.col("text"), F.floor(F.char_length("text") / 2).cast("int")
    opened = F.array(event(OPEN, F.lit("")))
    events = (
        F.when(way == 0, F.concat(opened, deltas(F.reverse(whole)), F.array(event(REGENERATE, F.lit(""))), deltas(whole)))
        .when(
            way == 1,
            F.concat(
                opened,
                deltas(F.upper(whole)),
                F.array(event(EDIT, F.substring(whole, F.lit(1), half))),
                deltas(F.substring(whole, half + 1, F.char_length(whole))),
            ),
        )
        .otherwise(F.concat(opened, deltas(whole)))
    )
    copies = counted.select(
        "conv_id",
        "turn",
        F.md5(F.concat_ws("\n", "role", "text").cast("binary")).alias("tie"),
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("copy"),
        "role",
        events.alias("events"),
        F.when(way == 2, 2).otherwise(1).alias("times"),
    )
    log = copies.select("*", F.posexplode("events").alias("step", "e")).select(
        "conv_id",
        F.concat_ws("/", F.col("turn").cast("string"), "tie", F.col("copy").cast("string")).alias("message_id"),
        "turn",
        "tie",
        "copy",
        "step",
        "e.kind",
        "role",
        "e.text",
        F.explode(F.sequence(F.lit(1), F.col("times"))).alias("delivery"),
    )
    return log.drop("delivery")
