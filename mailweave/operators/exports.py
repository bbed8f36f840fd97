"""Tidying of exported mail threads."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.functions import fixed, tidy
from mailweave.functions.batches import by_row
from mailweave.functions.text import strip

_ENGLISH = re.compile(fixed.HEADER_ENGLISH_PATTERN, re.IGNORECASE)
_ORIGINAL = re.compile(fixed.HEADER_ORIGINAL_PATTERN, re.IGNORECASE)
_SPANISH_DATE = re.compile(fixed.HEADER_SPANISH_DATE_PATTERN, re.IGNORECASE)
_SPANISH_MARK = re.compile(fixed.HEADER_SPANISH_MARK_PATTERN, re.IGNORECASE)
_SPANISH_AFTER = re.compile(fixed.HEADER_SPANISH_AFTER_PATTERN_CASED)


def _is_header(line: str) -> bool:
    """Row-side twin of :func:`mailweave.functions.tidy.is_message_header`."""
    s = line.strip()
    if len(s) < fixed.HEADER_MIN_CHARS or not {"<", ">"} <= set(s):
        return False
    if len(s) < fixed.HEADER_MAX_CHARS_ENGLISH and _ENGLISH.search(s):
        return True
    marked = _SPANISH_MARK.search(s) or _SPANISH_AFTER.search(s)
    spanish = s.count(" de ") >= 2 and _SPANISH_DATE.search(s) and marked
    return bool(_ORIGINAL.search(s) or spanish)


def _join_once(lines: list[str]) -> list[str]:
    rest, out = iter([*lines, None]), []
    line = next(rest)
    while line is not None:
        following = next(rest, None)
        if following is not None and "<" in line and not _is_header(line):
            joined = f"{line} {following}".strip()
            if _is_header(joined):
                line, following = joined, next(rest, None)
        out.append(line)
        line = following
    return out


def _join_passes(lines: list[str]) -> list[str]:
    """Repeated joining, for headers split over three and more lines."""
    for _ in range(fixed.WRAPPED_HEADER_PASSES):
        joined = _join_once(lines)
        if len(joined) == len(lines):
            break
        lines = joined
    return lines


def join_wrapped_headers(
    df: DataFrame, lines: str, possible: Column | None = None
) -> DataFrame:
    """Put message headers that were split over several lines back together.

    Each pass depends on the one before, so it runs as an Arrow function; a
    built-in test picks the rows that need it and the others send a null.
    ``possible`` is a cheaper test made first.
    """

    join = by_row(_join_passes, "array<string>", pa.list_(pa.string()))
    needed = tidy.has_wrapped_header(F.col(lines))
    if possible is not None:
        needed = possible & needed
    picked = F.when(needed, F.col(lines))
    return (
        df.withColumn("_joined", join(picked))
        .withColumn(lines, F.coalesce("_joined", lines))
        .drop("_joined")
    )


def tidy_export(
    df: DataFrame,
    text: str = "text",
    *,
    print_titles: bool = True,
    messages: bool = True,
) -> DataFrame:
    """Readable plain text of pasted threads; '' stays ''."""
    out = df.withColumn("_norm", tidy.normalize_characters(F.col(text)))
    lines = tidy.export_lines(F.col("_norm"))
    if print_titles:
        lines = F.when(
            tidy.may_hold_print_titles(F.col("_norm")), tidy.elide_print_titles(lines)
        ).otherwise(lines)
    out = out.withColumn("_lines", lines)
    if messages:
        out = join_wrapped_headers(out, "_lines", tidy.may_hold_headers(F.col("_norm")))
    body = tidy.squeeze_blank_lines(F.array_join("_lines", "\n"))
    if messages:
        out = out.withColumn("_body", body)
        body = tidy.squeeze_blank_lines(tidy.mark_messages(F.col("_body")))
    empty = F.coalesce(F.col(text), F.lit("")) == ""
    done: Column = F.when(empty, F.lit("")).otherwise(F.concat(strip(body), F.lit("\n")))
    return out.withColumn(text, done).drop("_norm", "_lines", "_body")
