"""Inbox listing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.functions import fixed, mail


def unread(messages: DataFrame, max_results: int | None = fixed.INBOX_BATCH) -> DataFrame:
    """Unread messages, newest first; ``None`` lists all of them."""
    found = messages.where(
        F.coalesce(F.array_contains("label_ids", "UNREAD"), F.lit(False))
    )
    if max_results is None:
        return found
    newest = [
        mail.date_ms(F.col("internal_date")).desc_nulls_last(),
        F.col("thread_id"),
        F.col("api_pos").desc(),
    ]
    return found.orderBy(*newest).limit(max_results)


def thread_messages(messages: DataFrame, thread_ids: DataFrame) -> DataFrame:
    """Every message of the given threads."""
    return messages.join(thread_ids.select("thread_id").distinct(), "thread_id", "left_semi")
