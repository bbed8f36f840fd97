"""Text out of file contents, by MIME type."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.functions import fixed
from mailweave.functions.text import is_blank, strip
from mailweave.operators.chunking import chunk_documents

Extractor = Callable[[bytes], str]


def _plugged(extractors: dict[str, Extractor], mime: Column, content: Column) -> Column:
    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for mimes, contents in batches:
            out = []
            for kind, data in zip(mimes, contents):
                if kind not in extractors or data is None:
                    out.append((None, None))
                    continue
                try:
                    out.append((extractors[kind](bytes(data)), None))
                except Exception as exc:  # noqa: BLE001 - isolated per file
                    out.append((None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(out, columns=["text", "error"])

    # Only contents of the plugged types travel to Python.
    return run(mime, F.when(mime.isin(*extractors), content))


def extract_text(
    files: DataFrame, extractors: dict[str, Extractor] | None = None
) -> DataFrame:
    """Replace ``content`` by ``text`` and ``extract_error``.

    Text types are decoded as UTF-8 with replacement and trimmed. Other types go
    to their extractor; a type nobody handles gets an error, never an abort.
    """
    native = F.col("mime_type").isin(fixed.DOCUMENT_MIME, *fixed.TEXT_MIMES)
    decoded = F.make_valid_utf8(F.col("content").cast("string"))
    text, error = decoded, F.lit(None).cast("string")
    unsupported = F.concat(F.lit("Unsupported MIME type: "), F.col("mime_type"))
    if extractors:
        files = files.withColumn(
            "_plugged", _plugged(extractors, F.col("mime_type"), F.col("content"))
        )
        handled = F.col("mime_type").isin(*extractors)
        text = F.when(handled, F.col("_plugged")["text"]).otherwise(decoded)
        error = F.when(handled, F.col("_plugged")["error"])
        native = native | handled
    return (
        files.withColumn("text", F.when(native, strip(text)))
        .withColumn("extract_error", F.when(native, error).otherwise(unsupported))
        .drop("content", "_plugged")
    )


def usable(extracted: DataFrame) -> DataFrame:
    """Files that were read and hold text."""
    return extracted.where(F.col("extract_error").isNull() & ~is_blank(F.col("text")))


def skipped(extracted: DataFrame) -> DataFrame:
    """Files left out, with the reason."""
    failed = F.col("extract_error").isNotNull()
    return extracted.where(failed | is_blank(F.col("text"))).withColumn(
        "reason", F.when(failed, F.col("extract_error")).otherwise("empty text")
    )


def ingest_counts(extracted: DataFrame) -> DataFrame:
    """Listed, usable and skipped files in one row."""
    good = F.col("extract_error").isNull() & ~is_blank(F.col("text"))
    return extracted.agg(
        F.count(F.lit(1)).alias("listed_files"),
        F.count_if(good).alias("source_file_count"),
        F.count_if(~good).alias("skipped_files"),
    )


def chunk_files(extracted: DataFrame, **sizes: int) -> DataFrame:
    """Chunks of all usable files."""
    named = usable(extracted).select(
        F.col("file_id").alias("source_id"),
        F.col("name").alias("source_name"),
        F.col("path").alias("source_path"),
        "text",
    )
    return chunk_documents(named, **sizes)
