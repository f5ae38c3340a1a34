"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it are its
context, and only its text bears loss. A conversation that does not end with an
assistant turn yields one more row without a target, so that no turn is lost.

A formatted turn is `<s>[INST] role [/INST]text</s>`. Inside texts and roles a
control string is escaped by a backslash after its first character, and one that
already has backslashes there gets one more, so unescaping gives back every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN = "<s>[INST] "
MIDDLE = " [/INST]"
CLOSE = "</s>"
TARGET_ROLE = "assistant"


def escaped(text: Column) -> Column:
    angle = F.regexp_replace(text, r"<(\\*)(/?s>)", r"<\\$1$2")
    return F.regexp_replace(angle, r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescaped(text: Column) -> Column:
    angle = F.regexp_replace(text, r"<\\(\\*)(/?s>)", "<$1$2")
    return F.regexp_replace(angle, r"\[\\(\\*)(/?INST\])", "[$1$2")


def format_conversations(turns: DataFrame) -> DataFrame:
    """Examples of `turns(conv_id, turn, role, text)`.

    Returns conv_id, target_place (place of the target among the conversation's
    turns, from 1; NULL for the row without target), n_turns (turns in this example,
    the target included), text, loss_start and loss_chars (the target's escaped text
    in `text`, in code points from 0; NULL and 0 without target).

    NULL texts and roles count as empty. Turns are ordered by turn (NULL first), role
    and text, so repeated turn numbers and equal rows each stay, in a fixed order. A
    NULL conv_id is a conversation like any other. Other columns are ignored; an
    empty table gives an empty result. An example holds its whole context, so a
    conversation must fit into one row.
    """
    role = F.coalesce("role", F.lit(""))
    text = escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), escaped(role), F.lit(MIDDLE))
    formatted = turns.select(
        "conv_id",
        F.struct(
            "turn",
            role.alias("role"),
            text.alias("text"),
            head.alias("head"),
        ).alias("one"),
    )
    whole = formatted.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns")).select(
        "conv_id", "turns", F.size("turns").alias("n")
    )
    places = F.sequence(F.lit(1), F.col("n"))
    ends = F.filter(places, lambda i: (F.element_at("turns", i)["role"] == TARGET_ROLE) | (i == F.col("n")))
    example = whole.select("conv_id", "turns", F.explode(ends).alias("place"))
    target = F.element_at("turns", F.col("place"))
    is_target = target["role"] == TARGET_ROLE
    context = F.array_join(
        F.transform(
            F.slice("turns", F.lit(1), F.col("place") - 1), lambda t: F.concat(t["head"], t["text"], F.lit(CLOSE))
        ),
        "",
    )
    before = F.concat(context, target["head"])
    return example.select(
        "conv_id",
        F.when(is_target, F.col("place")).alias("target_place"),
        F.col("place").alias("n_turns"),
        before.alias("before"),
        target["text"].alias("last"),
        is_target.alias("is_target"),
    ).select(
        "conv_id",
        "target_place",
        "n_turns",
        F.concat("before", "last", F.lit(CLOSE)).alias("text"),
        F.when(F.col("is_target"), F.char_length("before")).alias("loss_start"),
        F.when(F.col("is_target"), F.char_length("last")).otherwise(0).alias("loss_chars"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text: an array of (role, text), unescaped."""
    pieces = F.filter(F.split(text, CLOSE, -1), lambda p: p != "")

    def turn(piece: Column) -> Column:
        cut = F.instr(piece, MIDDLE)
        return F.struct(
            unescaped(F.substring(piece, len(OPEN) + 1, cut - len(OPEN) - 1)).alias("role"),
            unescaped(F.substring(piece, cut + len(MIDDLE), F.length(piece))).alias("text"),
        )

    return F.transform(pieces, turn)


def read_target(example: DataFrame) -> Column:
    """The unescaped text under the loss mask."""
    return unescaped(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_chars")))
