"""Message rows with their parsed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.functions import fixed, mail


def message_parts(messages: DataFrame) -> DataFrame:
    """Add subject, addresses, body, dates and draft flag to message rows."""
    ms = mail.date_ms(F.col("internal_date"))
    h = F.col("headers")
    return messages.select(
        "*",
        mail.header(h, "subject", fixed.DEFAULT_SUBJECT).alias("subject"),
        mail.header(h, "from").alias("sender"),
        mail.header(h, "to").alias("recipient"),
        mail.plain_body(F.col("parts")).alias("body"),
        mail.header(h, "message-id").alias("message_id_header"),
        mail.header(h, "references").alias("references"),
        ms.alias("date_ms"),
        mail.received_at(ms).alias("received_at"),
        mail.is_draft(F.col("label_ids")).alias("is_draft"),
    )
