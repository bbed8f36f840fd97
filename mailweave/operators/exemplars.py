"""Pool of example replies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.functions.redact import sanitize
from mailweave.sources.extract import Extractor, extract_text, usable


def exemplar_pool(
    files: DataFrame, extractors: dict[str, Extractor] | None = None
) -> DataFrame:
    """Readable, non-blank files, sanitized: ``(title, text, source_id)``.

    Files that cannot be read are left out; a pool may be empty.
    """
    texts = usable(extract_text(files, extractors))
    return texts.select(
        F.col("name").alias("title"),
        sanitize(F.col("text")).alias("text"),
        F.col("file_id").alias("source_id"),
    )


def in_title_order(pool: DataFrame) -> DataFrame:
    """Pool sorted the way it is numbered in a prompt."""
    return pool.orderBy(F.lower("title"), "source_id")
