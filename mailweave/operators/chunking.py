"""Paragraph-aware chunking of document text."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.functions import fixed
from mailweave.functions.batches import by_row

_TEXTS = pa.list_(pa.string())
_BREAK = re.compile(fixed.PARAGRAPH_BREAK_PATTERN)


def _word_runs(paragraph: str, limit: int) -> Iterator[str]:
    """Fill lines of at most ``limit`` characters; a longer word stands alone."""
    if len(paragraph) <= limit:
        yield paragraph
        return
    tokens = paragraph.split()
    start = width = 0
    for i, token in enumerate(tokens):
        grown = width + len(token) + (i > start)
        if i > start and grown > limit:
            yield " ".join(tokens[start:i])
            start, width = i, len(token)
        else:
            width = grown
    yield " ".join(tokens[start:])


def _pieces(text: str, limit: int) -> Iterator[str]:
    for block in _BREAK.split(text.replace("\r\n", "\n").replace("\r", "\n")):
        block = block.strip()
        if block:
            yield from _word_runs(block, limit)


def _chunks(text: str, limit: int, overlap: int) -> list[str]:
    """Slices of the pieces joined by blank lines.

    A chunk with its repeated tail is one unbroken slice of that joined text, so it
    is enough to choose slice borders from the piece ends: the last end within
    ``limit`` of the slice's start, but at least one piece further than before.
    """
    pieces = list(_pieces(text, limit))
    whole = "\n\n".join(pieces)
    ends = [at - 2 for at in accumulate(len(piece) + 2 for piece in pieces)]
    out: list[str] = []
    start = first = 0
    while first < len(ends):
        after = max(first + 1, bisect_right(ends, start + limit))
        end = ends[after - 1]
        out.append(whole[start:end].strip())
        start = max(start, end - overlap) if overlap else end + 2
        first = after
    return out


def chunk_sizes(chunk_tokens: int, overlap_tokens: int) -> tuple[int, int]:
    """Chunk and overlap size in characters."""
    limit = max(1, chunk_tokens * fixed.CHARS_PER_TOKEN)
    overlap = overlap_tokens * fixed.CHARS_PER_TOKEN if overlap_tokens > 0 else 0
    return limit, min(overlap, limit - 1)


def split_oversized(paragraph: Column, max_chars: int) -> Column:
    """Word runs of one paragraph as ``ARRAY<STRING>``."""

    return by_row(lambda p: list(_word_runs(p, max_chars)), "array<string>", _TEXTS)(paragraph)


def chunk_texts(
    text: Column,
    chunk_tokens: int = fixed.CHUNK_TOKENS,
    overlap_tokens: int = fixed.OVERLAP_TOKENS,
) -> Column:
    """Chunk texts of one document as ``ARRAY<STRING>``.

    Packing is sequential inside a document and independent across documents,
    so it is an Arrow-batched function over rows and needs no shuffle.
    """
    limit, overlap = chunk_sizes(chunk_tokens, overlap_tokens)

    return by_row(lambda t: _chunks(t, limit, overlap), "array<string>", _TEXTS)(text)


def chunk_documents(
    documents: DataFrame,
    chunk_tokens: int = fixed.CHUNK_TOKENS,
    overlap_tokens: int = fixed.OVERLAP_TOKENS,
) -> DataFrame:
    """(source_id, source_name, source_path, text) rows to chunk rows.

    ``chunk_index`` counts from 0 inside a document; blank text gives no row.
    """
    return documents.select(
        "source_id",
        "source_name",
        "source_path",
        F.posexplode(chunk_texts(F.col("text"), chunk_tokens, overlap_tokens)).alias(
            "chunk_index", "text"
        ),
    )
