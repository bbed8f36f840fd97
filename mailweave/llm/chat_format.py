"""Conversations as one training text each, written and read with Spark expressions only.

The turns of a conversation are collected as structs and sorted; runs of turns of one role
become one block, and blocks are concatenated::

    ### user:
    first text<next>second text</turn>
    ### assistant:
    answer</turn>

Texts and roles are escaped, so that none of these control strings can come from them: every
``\\`` becomes ``\\0`` and each control string becomes ``\\`` with a digit. Reading splits at the
control strings and undoes this; it gives back every single turn. ``loss_spans`` are the UTF-8
byte ranges of the texts of one role, without any control string.

A null role or text counts as empty, a null conversation id is a conversation of its own. Turns
are ordered by number (null first), ties by role and text; repeated rows stay repeated turns.
Other columns are not read; an empty table gives no rows. A conversation is one value, so it has
to fit a row, texts and all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.llm.common import let

OPEN, NEXT, CLOSE, HEAD_END = "### ", "<next>", "</turn>\n", ":\n"
# Strings that a text must not hold; roles must not hold the last two either.
CONTROL = ["\\", OPEN, CLOSE.strip(), NEXT]
ROLE_CONTROL = [*CONTROL, ":", "\n"]
PART = 256  # running sums are made in parts of so many values


def escape(c: Column, control: list[str] = CONTROL) -> Column:
    for i, mark in enumerate(control):
        c = F.replace(c, F.lit(mark), F.lit(f"\\{i}"))
    return c


def unescape(c: Column, control: list[str] = CONTROL) -> Column:
    for i in reversed(range(len(control))):
        c = F.replace(c, F.lit(f"\\{i}"), F.lit(control[i]))
    return c


def running_sums(values: Column) -> Column:
    """Running sums of a non-empty array, part by part, as appending to an array copies it."""

    def sums(part: Column) -> Column:
        return F.aggregate(
            part, F.expr("cast(array() as array<bigint>)"),
            lambda done, x: F.array_append(
                done, F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + x
            ),
        )

    last = F.floor((F.size(values) - 1) / PART).cast("int")
    parts = F.transform(
        F.sequence(F.lit(0), last), lambda p: sums(F.slice(values, p * PART + 1, PART))
    )

    def shifted(inside: Column) -> Column:
        return let(
            sums(F.transform(inside, lambda p: F.element_at(p, -1))),
            lambda ends: F.flatten(F.transform(inside, lambda p, i: F.transform(
                p, lambda x: x + F.coalesce(F.get(ends, i - 1), F.lit(0))
            ))),
        )

    return let(parts, shifted)


def format_chats(
    df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
    text_col: str = "text", loss_role: str = "assistant",
) -> DataFrame:
    """``(id_col, formatted, loss_spans array<struct<start, end>>)``, one row per conversation."""
    turn = F.struct(
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    sorted_turns = df.groupBy(F.col(id_col)).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    escaped = F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), escape(t["role"], ROLE_CONTROL).alias("name"),
        escape(t["text"]).alias("text"),
    ))
    heads = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (
        F.get("turns", i)["role"] != F.get("turns", i - 1)["role"]
    ))
    marked = sorted_turns.select(
        id_col, escaped.alias("turns"), heads.alias("heads"), F.size("turns").alias("n")
    )
    # A block reaches to the next head.
    blocks = F.zip_with(
        "heads", F.concat(F.slice("heads", F.lit(2), F.size("heads")), F.array("n")),
        lambda a, b: F.slice("turns", a + 1, F.greatest(b - a, F.lit(0))),
    )
    blocks = F.slice(blocks, F.lit(1), F.size("heads"))
    formatted = F.array_join(F.transform("blocks", lambda b: F.concat(
        F.lit(OPEN), F.get(b, F.lit(0))["name"], F.lit(HEAD_END),
        F.array_join(F.transform(b, lambda t: t["text"]), NEXT), F.lit(CLOSE),
    )), "")
    # What comes before a text since the text before it, and the text.
    before = F.flatten(F.transform("blocks", lambda b, k: F.transform(b, lambda t, i: F.struct(
        F.when(i > 0, len(NEXT)).otherwise(
            F.when(k > 0, len(CLOSE)).otherwise(0)
            + len(OPEN) + F.octet_length(t["name"]) + len(HEAD_END)
        ).cast("bigint").alias("before"),
        F.octet_length(t["text"]).cast("bigint").alias("size"),
        (t["role"] == loss_role).alias("loss"),
    ))))
    ends = running_sums(F.transform("places", lambda p: p["before"] + p["size"]))
    spans = F.transform(
        F.filter(
            F.zip_with("places", ends, lambda p, end: F.struct(
                (end - p["size"]).alias("start"), end.alias("end"), p["loss"].alias("loss")
            )),
            lambda s: s["loss"],
        ),
        lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")),
    )
    return (
        marked.select(id_col, blocks.alias("blocks"))
        .select(id_col, formatted.alias("formatted"), before.alias("places"))
        .select(id_col, "formatted", spans.alias("loss_spans"))
    )


def read_turns(formatted: Column) -> Column:
    """The single turns of a formatted text, ``array<struct<role, text>>``."""
    def block_turns(block: Column) -> Column:
        return let(F.split(block, HEAD_END, 2), lambda parts: let(
            unescape(F.substring(F.get(parts, F.lit(0)), len(OPEN) + 1, 1 << 30), ROLE_CONTROL),
            lambda role: F.transform(F.split(F.get(parts, F.lit(1)), NEXT, -1), lambda t: F.struct(
                role.alias("role"), unescape(t).alias("text")
            )),
        ))

    blocks = F.split(formatted, CLOSE, -1)
    return F.flatten(F.transform(
        F.slice(blocks, F.lit(1), F.size(blocks) - 1), block_turns
    ))


def read_spans(formatted: Column, spans: Column) -> Column:
    """The texts under ``spans``, unescaped."""
    return let(formatted.cast("binary"), lambda raw: F.transform(spans, lambda s: unescape(
        F.substring(raw, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        .cast("string")
    )))
