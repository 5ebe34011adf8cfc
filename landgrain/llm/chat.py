"""Chat formatting by event-sourced reconstruction.

A log holds events (conv_id, seq, turn, kind, role, text). Sorted by seq inside its turn, a ``message`` or ``edit``
sets the turn's text, a ``delta`` appends to it, a ``regenerate`` empties it, and a ``delete`` removes the turn. Each
turn is folded on its own, so that a long conversation is spread by turn; the final messages are then put in order
and rendered. All steps are DataFrame operations.

Rendered, a turn is ``### <role>: <text></turn>`` and a line end. Inside texts the escape sign and the control strings
are replaced reversibly; a role's colon and line ends too. The loss mask is a list of [start, end) code points of the
rendered string that cover the text of every assistant turn.

Defined results: a null text is empty, a null role is an empty role; events that tie in seq are folded in the order
of kind and text, and equal events count as often as they occur; events without conv_id form one conversation of
their own (null); a conversation whose turns were all deleted is not returned; an empty log gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
#: Replacements in order; each takes away what the later ones bring in, so the reverse order undoes them.
ESCAPES = (("\\", "\\b"), ("</turn>", "\\e"), ("###", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"), ("\n", "\\n"))
RESETS = ("message", "edit", "regenerate")
CHUNK = 128  # code points of a streamed delta


def escaped(text: Column, escapes: tuple = ESCAPES) -> Column:
    for plain, code in escapes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column, escapes: tuple = ESCAPES) -> Column:
    for plain, code in reversed(escapes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def events_of(rows: DataFrame) -> DataFrame:
    """A log with one ``message`` event per row of (conv_id, turn, role, text); rows of one turn stay apart."""
    order = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return rows.select("conv_id", "turn", "role", "text").select(
        "conv_id",
        F.lit(0).cast("long").alias("seq"),
        F.struct("turn", F.row_number().over(order).alias("copy")).alias("turn"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )


def logged(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The log that a chat service would have kept of (conv_id, turn, role, text), in no order of rows.

    An assistant's answer is streamed: a delta with a draft (the first half of the text), a regenerate, then deltas of
    ``chunk`` code points. Any other turn is a message with the draft, then an edit to the whole text.
    """
    text, n = F.coalesce("text", F.lit("")), F.char_length(F.coalesce("text", F.lit("")))
    event = lambda seq, kind, t: F.struct(seq.cast("long").alias("seq"), F.lit(kind).alias("kind"), t.alias("text"))
    draft = F.substr(text, F.lit(1), F.floor(n / 2).cast("int"))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(n / chunk) - 1, F.lit(0)).cast("int"))
    deltas = F.transform(starts, lambda k: event(k + 2, "delta", F.substr(text, k * chunk + 1, F.lit(chunk))))
    streamed = F.concat(F.array(event(F.lit(0), "delta", draft), event(F.lit(1), "regenerate", F.lit(""))), deltas)
    edited = F.array(event(F.lit(0), "message", draft), event(F.lit(1), "edit", text))
    events = F.when(F.col("role") == "assistant", streamed).otherwise(edited)
    return events_of(rows).select("conv_id", "turn", "role", F.explode(events).alias("e")).select(
        "conv_id", F.col("e.seq").alias("seq"), "turn", F.col("e.kind").alias("kind"), "role", F.col("e.text").alias("text")
    )


def folded(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final messages."""
    steps = events.groupBy("conv_id", "turn").agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), "role"))).alias("e")
    )
    kinds = F.transform("e", lambda x: x["kind"])
    found = [F.array_contains("kinds", k) for k in RESETS]
    starts = F.greatest(
        *(F.when(f, F.size("e") - F.array_position(F.reverse("kinds"), k)).otherwise(0) for f, k in zip(found, RESETS))
    )
    live = F.filter(
        F.slice("e", F.col("start").cast("int") + 1, F.size("e")), lambda x: x["kind"] != "regenerate"
    )
    return (
        steps.withColumn("kinds", kinds)
        .where(~F.array_contains("kinds", "delete"))
        .withColumn("start", starts)
        .select(
            "conv_id",
            "turn",
            F.array_max(F.transform("e", lambda x: F.coalesce(x["role"], F.lit("")))).alias("role"),
            F.array_join(F.transform(live, lambda x: x["text"]), "").alias("text"),
        )
    )


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): each conversation as one string with the spans of its loss mask."""
    part = F.concat(F.lit(HEAD), escaped(F.col("role"), ROLE_ESCAPES), F.lit(MIDDLE))
    parts = messages.select("conv_id", "turn", part.alias("head"), escaped(F.col("text")).alias("body"), "role")
    turns = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "head", "body", "role"))).alias("t"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.char_length(x["head"]) + F.char_length(x["body"]) + len(TAIL)).cast("long").alias("at"),
        F.when(
            x["role"] == "assistant",
            F.concat(
                acc["spans"],
                F.array(
                    F.struct(
                        (acc["at"] + F.char_length(x["head"])).cast("long").alias("start"),
                        (acc["at"] + F.char_length(x["head"]) + F.char_length(x["body"])).cast("long").alias("end"),
                    )
                ),
            ),
        )
        .otherwise(acc["spans"])
        .alias("spans"),
    )
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(TAIL))), "")
    return turns.select("conv_id", whole.alias("formatted"), F.aggregate("t", start, step)["spans"].alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text): the roles and texts parsed from the rendered strings, and the text under the mask."""
    pieces = F.split("formatted", TAIL.replace("\n", "\\n"))
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def parsed(x: Column) -> Column:
        role = F.substring_index(x, MIDDLE, 1)
        return F.struct(
            unescaped(F.substr(role, F.lit(len(HEAD) + 1)), ROLE_ESCAPES).alias("role"),
            unescaped(F.substr(x, F.char_length(role) + len(MIDDLE) + 1)).alias("text"),
        )

    under = F.transform(
        "loss", lambda s: F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    )
    return formatted.select(
        "*", F.transform(pieces, parsed).alias("turns"), F.array_join(F.transform(under, lambda x: unescaped(x)), "").alias("loss_text")
    )


def formatted(events: DataFrame) -> DataFrame:
    return rendered(folded(events))
