"""Thread order, latest message, and character-budgeted transcripts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailweave.functions import fixed, mail
from mailweave.operators import skew
from mailweave.operators.messages import message_parts
from mailweave.session import materialize

_GAP = 2  # blank line between two segments
# Text of one thread that a window may hold.
WINDOW_CHARS = 256_000_000


def thread_budget(max_chars: int | None) -> int:
    """Transcript size: default when unset, never below the minimum."""
    if max_chars is None:
        return fixed.THREAD_MAX_CHARS
    return max(fixed.MIN_THREAD_MAX_CHARS, max_chars)


def _sort_ms(undated: Column) -> Column:
    return F.when(undated, F.lit(0)).otherwise(F.col("date_ms"))


def order_messages(
    rows: DataFrame, measure: Column | None = None, hot_rows: int = skew.HOT_ROWS
) -> DataFrame:
    """Number the non-draft messages of each thread from 1.

    Order is by date when every message of the thread has a valid one, else the
    stored order for the whole thread; equal dates keep the stored order.
    ``rows`` needs ``thread_id, api_pos, date_ms``. Also adds ``running``, the
    inclusive sum of ``measure``.
    """
    hot = skew.hot_keys(rows, "thread_id", hot_rows)
    cold_rows, hot_part = skew.split_by_keys(rows, "thread_id", hot)
    order = [F.col("_sort_ms"), F.col("api_pos")]

    whole = Window.partitionBy("thread_id")
    undated = F.max(F.col("date_ms").isNull()).over(whole)
    out = skew.window_positions(
        cold_rows.withColumn("_sort_ms", _sort_ms(undated)),
        "thread_id",
        order,
        measure,
    )
    if hot_part is not None:
        flags = hot_part.groupBy("thread_id").agg(
            F.max(F.col("date_ms").isNull()).alias("_undated")
        )
        dated = (
            hot_part.join(flags, "thread_id")
            .withColumn("_sort_ms", _sort_ms(F.col("_undated")))
            .drop("_undated")
        )
        out = out.unionByName(skew.ranged_positions(dated, "thread_id", order, measure))
    return out.drop("_sort_ms")


def latest_anchors(messages: DataFrame, staff_domains: Sequence[str] = ()) -> DataFrame:
    """Newest non-draft message of every thread, with counts and staff flag.

    One aggregation with a map-side step, so a thread of any size is fine. A
    thread that holds drafts only gets an ``error`` and no anchor.
    """
    ms = mail.date_ms(F.col("internal_date"))
    live = ~mail.is_draft(F.col("label_ids"))
    sender = mail.header(F.col("headers"), "from")
    shown = [F.col("message_id"), sender.alias("sender")]
    by_date = F.struct(ms.alias("ms"), F.col("api_pos"), *shown)
    by_pos = F.struct(F.col("api_pos"), *shown)
    grouped = messages.groupBy("thread_id").agg(
        F.count(F.lit(1)).alias("raw_message_count"),
        F.count_if(live).alias("non_draft_message_count"),
        F.max(F.when(live, ms.isNull())).alias("_undated"),
        F.max(F.when(live, by_date)).alias("_dated_last"),
        F.max(F.when(live, by_pos)).alias("_stored_last"),
    )
    pick = lambda name: F.when(
        F.col("_undated"), F.col("_stored_last")[name]
    ).otherwise(F.col("_dated_last")[name])
    from_header = pick("sender")
    return grouped.select(
        "thread_id",
        pick("message_id").alias("anchor_id"),
        from_header.alias("sender"),
        mail.is_staff(from_header, staff_domains).alias("is_staff"),
        "raw_message_count",
        "non_draft_message_count",
        F.when(
            F.col("non_draft_message_count") == 0,
            F.lit("thread contains no non-draft messages"),
        ).alias("error"),
    )


def non_draft(messages: DataFrame) -> DataFrame:
    return messages.where(~mail.is_draft(F.col("label_ids")))


def through_anchor(
    messages: DataFrame, anchors: DataFrame, hot_rows: int = skew.HOT_ROWS
) -> DataFrame:
    """Messages up to and including ``anchors(thread_id, anchor_id)``, one each.

    Only ids and dates are put in order, once; the positions are written, and the
    messages join the rows that are kept. The anchor table has one row per thread;
    a thread with very many rows is the split side of the join, which adaptive
    execution divides.
    """
    rows = non_draft(messages)
    keys = ["thread_id", "message_id", "api_pos"]
    dated = rows.select(*keys, mail.date_ms(F.col("internal_date")).alias("date_ms"))
    ordered = order_messages(dated, hot_rows=hot_rows).select(*keys, "ordinal")
    placed = materialize(ordered, "positions")
    ends = placed.select(
        "thread_id", F.col("message_id").alias("anchor_id"), F.col("ordinal").alias("_end")
    ).join(anchors, ["thread_id", "anchor_id"])
    kept = placed.join(ends, "thread_id").where(F.col("ordinal") <= F.col("_end")).drop("_end")
    return rows.join(kept, keys)


def missing_anchors(messages: DataFrame, anchors: DataFrame) -> DataFrame:
    """Anchors that are not among the non-draft messages, with an error text."""
    known = non_draft(messages).select("thread_id", F.col("message_id").alias("anchor_id"))
    return anchors.join(known, ["thread_id", "anchor_id"], "left_anti").select(
        "thread_id",
        "anchor_id",
        F.lit("anchor message not found after draft filtering").alias("error"),
    )


def render(messages: DataFrame, max_chars: int) -> DataFrame:
    """Parsed messages with their rendered text.

    ``tail`` is cut to the budget from the right: a longer segment can only
    ever show its last ``max_chars`` characters. ``tail_chars`` is the uncut
    length.
    """
    tail = mail.segment_tail(
        F.col("received_at"), F.col("sender"), F.col("subject"), F.col("body")
    )
    return (
        message_parts(messages)
        .withColumn("_tail", tail)
        .withColumn("tail", F.right("_tail", F.lit(max_chars)))
        .withColumn("tail_chars", F.length("_tail"))
        .drop("_tail")
    )


def segment_rows(rendered: DataFrame) -> DataFrame:
    """What a transcript needs of every non-draft message."""
    return rendered.where(~F.col("is_draft")).select(
        "thread_id", "message_id", "api_pos", "date_ms", "tail", "tail_chars"
    )


def _segment_chars() -> Column:
    """Length of a segment once its ordinal is known."""
    head = len(mail.SEGMENT_HEAD_OPEN) + len(mail.SEGMENT_HEAD_CLOSE)
    return F.col("tail_chars") + head + F.length(F.col("ordinal").cast("string"))


def _ordinal_digits(n: Column) -> Column:
    """Digits needed to write the numbers 1 .. n."""
    d = F.length(n.cast("string"))
    power = F.rpad(F.lit("1"), d + 1, F.lit("0")).cast("bigint")
    return (n + 1) * d - (power - 1).cast("bigint") / F.lit(9)


def _segment_end() -> Column:
    """Characters of all segments up to this one, each with its gap."""
    head = len(mail.SEGMENT_HEAD_OPEN) + len(mail.SEGMENT_HEAD_CLOSE)
    fixed_part = F.col("running") + F.col("ordinal") * (head + _GAP)
    return (fixed_part + _ordinal_digits(F.col("ordinal"))).cast("bigint")


def _join_segments(rows: DataFrame, keys: Sequence[str], max_chars: int) -> DataFrame:
    """Kept segments to one text per key.

    ``rows`` has ``ordinal, tail, tail_chars, kept_of, whole``: ``whole`` says
    that all messages fit, else a banner with the kept count goes first and the
    text is cut from the left to the budget.
    """
    segment = F.concat(mail.segment_head(F.col("ordinal")), F.col("tail"))
    grouped = rows.groupBy(*keys).agg(
        F.array_join(
            F.transform(
                F.array_sort(
                    F.collect_list(F.struct(F.col("ordinal"), segment.alias("text")))
                ),
                lambda s: s["text"],
            ),
            "\n\n",
        ).alias("_body"),
        F.count(F.lit(1)).alias("kept_messages"),
        F.max("ordinal").alias("message_count"),
        F.first("whole").alias("_whole"),
    )
    lead = F.concat(mail.omission_banner(F.col("kept_messages")), F.lit("\n\n"))
    room = F.greatest(F.lit(0), F.lit(max_chars) - F.length(lead))
    return grouped.select(
        *keys,
        "message_count",
        "kept_messages",
        F.when(F.col("_whole"), F.col("_body"))
        .otherwise(F.concat(lead, F.right("_body", room)))
        .alias("transcript"),
    )


def _kept(kept: Column, joined_chars: Column, whole: Column, max_chars: int) -> Column:
    banner = F.length(mail.omission_banner(kept)) + _GAP
    return whole | (kept == 1) | (banner + joined_chars <= max_chars)


def latest_transcripts(
    messages: DataFrame,
    max_chars: int = fixed.THREAD_MAX_CHARS,
    hot_rows: int | None = None,
) -> DataFrame:
    """One transcript per thread, through its newest non-draft message.

    The usual threads take a single shuffle: the window and the final
    aggregation share the partitioning by thread, and only segments inside the
    budget are collected. Threads above ``hot_rows`` go through
    :func:`anchored_transcripts`, where no task sees a whole thread; unset, that
    is a thread whose segments of up to ``max_chars`` could exceed WINDOW_CHARS.
    """
    _check_budget(max_chars)
    limit = max(1, min(skew.HOT_ROWS, WINDOW_CHARS // max_chars)) if hot_rows is None else hot_rows
    hot = skew.hot_keys(messages, "thread_id", limit)
    cold, large = skew.split_by_keys(messages, "thread_id", hot)
    rows = segment_rows(render(cold, max_chars))

    whole = Window.partitionBy("thread_id")
    undated = F.max(F.col("date_ms").isNull()).over(whole)
    order = [F.col("_sort_ms"), F.col("api_pos")]
    placed = skew.window_positions(
        rows.withColumn("_sort_ms", _sort_ms(undated)),
        "thread_id",
        order,
        F.col("tail_chars"),
    ).withColumn("_end", _segment_end())
    joined = F.col("_total") - F.col("_end") + _segment_chars()
    kept = F.col("_count") - F.col("ordinal") + 1
    sized = placed.withColumns(
        {"_total": F.max("_end").over(whole), "_count": F.max("ordinal").over(whole)}
    ).withColumn("whole", F.col("_total") - _GAP <= max_chars)
    out = _join_segments(
        sized.where(_kept(kept, joined, F.col("whole"), max_chars)),
        ["thread_id"],
        max_chars,
    )
    if large is not None:
        anchors = latest_anchors(large).where("error is null").select("thread_id", "anchor_id")
        heavy = anchored_transcripts(large, anchors, max_chars, hot_rows or skew.HOT_ROWS)
        out = out.unionByName(heavy.drop("anchor_id"))
    return out


def anchored_transcripts(
    messages: DataFrame,
    anchors: DataFrame,
    max_chars: int = fixed.THREAD_MAX_CHARS,
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """Transcripts through any number of ``anchors(thread_id, anchor_id)``."""
    _check_budget(max_chars)
    segments = segment_rows(render(messages, max_chars))
    return transcripts_of(segments, anchors, max_chars, hot_rows)


def transcripts_of(
    segments: DataFrame,
    anchors: DataFrame,
    max_chars: int = fixed.THREAD_MAX_CHARS,
    hot_rows: int = skew.HOT_ROWS,
) -> DataFrame:
    """:func:`anchored_transcripts` over rows of :func:`segment_rows`.

    Every segment has a start offset in its thread's full text. Offsets are cut
    into buckets of the budget's length, so the text an anchor can show lies in
    at most two of them, and matching on ``(thread, bucket)`` never pairs an
    anchor with far-away messages. Numbering and matching move lengths only: the
    positions, a few dozen bytes per message, are written once and read from
    both sides of the match. Texts are joined to the rows that are kept.
    """
    _check_budget(max_chars)
    placed = materialize(
        order_messages(segments.drop("tail"), F.col("tail_chars"), hot_rows)
        .withColumn("_end", _segment_end())
        .withColumn("_start", F.col("_end") - _segment_chars() - _GAP)
        .select("thread_id", "message_id", "ordinal", "_start", "_end"),
        "positions",
    )
    # Two buckets at most: an anchor reaches back no further than the budget.
    reach = F.least(
        F.col("_start"), F.greatest(F.lit(0), F.col("_end") - _GAP - max_chars)
    )
    bucket = lambda c: F.floor(c / max_chars)
    ends = (
        placed.select(
            "thread_id", F.col("message_id").alias("anchor_id"), "ordinal", "_start", "_end"
        )
        .join(anchors.select("thread_id", "anchor_id").distinct(), ["thread_id", "anchor_id"])
        .select(
            "thread_id",
            "anchor_id",
            F.col("ordinal").alias("_last"),
            F.col("_end").alias("_last_end"),
            F.explode(F.sequence(bucket(reach), bucket(F.col("_start")))).alias("_bucket"),
        )
    )
    pairs = placed.withColumn("_bucket", bucket(F.col("_start"))).join(
        ends, ["thread_id", "_bucket"]
    )
    kept = F.col("_last") - F.col("ordinal") + 1
    chosen = (
        pairs.withColumn("whole", F.col("_last_end") - _GAP <= max_chars)
        .where(F.col("ordinal") <= F.col("_last"))
        .where(
            _kept(
                kept, F.col("_last_end") - F.col("_start") - _GAP, F.col("whole"), max_chars
            )
        )
        .select("thread_id", "anchor_id", "message_id", "ordinal", "whole")
    )
    texts = segments.select("thread_id", "message_id", "tail")
    return _join_segments(
        chosen.join(texts, ["thread_id", "message_id"]),
        ["thread_id", "anchor_id"],
        max_chars,
    )


def _check_budget(max_chars: int) -> None:
    if max_chars <= 0:
        raise ValueError(f"max_chars must be positive, got {max_chars}")
