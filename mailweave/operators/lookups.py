"""Lookups between messages, threads and the processed state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.functions import mail
from mailweave.operators.messages import message_parts


def unprocessed(messages: DataFrame, processed: DataFrame) -> DataFrame:
    """Messages without a stored outcome."""
    return messages.join(processed.select("message_id"), "message_id", "left_anti")


def outcomes(messages: DataFrame, processed: DataFrame) -> DataFrame:
    """Stored outcome per message, null when there is none."""
    return messages.join(processed.select("message_id", "outcome"), "message_id", "left")


def threads_with_draft(messages: DataFrame) -> DataFrame:
    """Ids of threads that hold at least one draft."""
    return (
        messages.where(mail.is_draft(F.col("label_ids"))).select("thread_id").distinct()
    )


def metadata(ids: DataFrame, messages: DataFrame) -> DataFrame:
    """Header fields for an ordered id list ``(pos, message_id)``.

    Order and repeats of the list are kept; an unknown id gets an ``error``.
    """
    parsed = message_parts(messages).select(
        "message_id",
        "subject",
        "sender",
        "recipient",
        "thread_id",
        "message_id_header",
        "references",
        "received_at",
    )
    return (
        ids.join(parsed, "message_id", "left")
        .withColumn("error", F.when(F.col("thread_id").isNull(), F.lit("not found")))
        .orderBy("pos")
    )
