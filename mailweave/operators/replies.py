"""Reply requests for threads picked by hand."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.functions import fixed, mail
from mailweave.operators.classify import Classifier, detect_language, stop_word_language
from mailweave.operators.messages import message_parts
from mailweave.operators.threads import latest_anchors, latest_transcripts


def answered_threads(messages: DataFrame, staff_domains: Sequence[str]) -> DataFrame:
    """Threads whose newest message is from staff: nothing to reply to."""
    anchors = latest_anchors(messages, staff_domains)
    return anchors.where(F.col("error").isNull() & F.col("is_staff")).select(
        "thread_id", "anchor_id"
    )


def manual_requests(
    messages: DataFrame,
    staff_domains: Sequence[str],
    *,
    max_chars: int = fixed.THREAD_MAX_CHARS,
    forced_language: str | None = None,
    classifier: Classifier = stop_word_language,
    hot_rows: int | None = None,
) -> DataFrame:
    """One request per thread that waits for a reply to its newest message.

    The language is the forced one, or detected on the transcript. The turn to
    answer is the message body, or its subject when the body is empty.
    """
    anchors = latest_anchors(messages, staff_domains)
    waiting = anchors.where(F.col("error").isNull() & ~F.col("is_staff")).select(
        "thread_id", F.col("anchor_id").alias("message_id")
    )
    turn = F.when(F.col("body") != "", F.col("body")).otherwise(F.col("subject"))
    asked = message_parts(messages.join(waiting, ["thread_id", "message_id"])).select(
        "thread_id",
        F.col("message_id").alias("anchor_id"),
        F.col("sender").alias("reply_to"),
        mail.reply_subject(F.col("subject")).alias("reply_subject"),
        F.col("message_id_header").alias("in_reply_to"),
        mail.reference_chain(F.col("references"), F.col("message_id_header")).alias(
            "reply_references"
        ),
        turn.alias("turn"),
    )
    open_threads = messages.join(waiting.select("thread_id"), "thread_id", "left_semi")
    transcripts = latest_transcripts(open_threads, max_chars, hot_rows)
    rows = asked.join(transcripts.select("thread_id", "transcript"), "thread_id")
    if forced_language is not None:
        return rows.withColumns(
            {"language": F.lit(forced_language), "error": F.lit(None).cast("string")}
        )
    return detect_language(rows, "transcript", classifier)
