"""Cleaning of exported mail threads, line by line inside one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailweave.functions import fixed
from mailweave.functions.text import is_blank, let, rstrip, strip, unix_newlines

JAVA_FLAGS = "(?iU)"


def _matches(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def normalize_characters(c: Column) -> Column:
    """Unix newlines, plain spaces, no zero-width characters."""
    swapped = fixed.WIDE_SPACES + fixed.ZERO_WIDTH
    return F.translate(unix_newlines(c), swapped, " " * len(fixed.WIDE_SPACES))


def export_lines(c: Column) -> Column:
    """Lines of a normalized text without trailing white space."""
    return F.transform(F.split(c, "\n", -1), rstrip)


def normalize_export(c: Column) -> Column:
    return F.array_join(export_lines(normalize_characters(c)), "\n")


def is_print_title(line: Column) -> Column:
    """A page title that printing a mail thread repeats on every page."""
    s = strip(line)
    return (
        (F.length(s) > fixed.PRINT_TITLE_MIN_CHARS)
        & F.lower(s).startswith(fixed.PRINT_TITLE_PREFIX)
        & _matches(s, fixed.PRINT_TITLE_END_PATTERN)
        & _matches(s, fixed.PRINT_TITLE_DIGIT_PATTERN)
    )


def may_hold_print_titles(c: Column) -> Column:
    return F.contains(F.lower(c), F.lit(fixed.PRINT_TITLE_PREFIX))


def elide_print_titles(lines: Column) -> Column:
    """Turn each run of print titles into one note line."""

    def marked(ls: Column) -> Column:
        def one(line: Column, i: Column) -> Column:
            follows = (i > 0) & F.coalesce(is_print_title(F.get(ls, i - 1)), F.lit(False))
            return F.when(~is_print_title(line), line).when(
                ~follows, F.lit(fixed.PRINT_TITLE_NOTE)
            )

        return F.filter(F.transform(ls, one), lambda line: line.isNotNull())

    return let(lines, marked)


def may_hold_headers(c: Column) -> Column:
    """Cheap test on a whole text; most texts fail it and skip the line work."""
    return F.contains(c, F.lit("<")) & F.contains(c, F.lit(">"))


def is_message_header(line: Column) -> Column:
    """Line that opens a new mail inside an export."""

    def strict(s: Column) -> Column:
        english = (F.length(s) < fixed.HEADER_MAX_CHARS_ENGLISH) & _matches(
            s, JAVA_FLAGS + fixed.HEADER_ENGLISH_PATTERN
        )
        original = _matches(s, JAVA_FLAGS + fixed.HEADER_ORIGINAL_PATTERN)
        spanish = (
            (F.regexp_count(s, F.lit(" de ")) >= 2)
            & _matches(s, JAVA_FLAGS + fixed.HEADER_SPANISH_DATE_PATTERN)
            & (
                _matches(s, JAVA_FLAGS + fixed.HEADER_SPANISH_MARK_PATTERN)
                | _matches(s, "(?U)" + fixed.HEADER_SPANISH_AFTER_PATTERN_CASED)
            )
        )
        return (F.length(s) >= fixed.HEADER_MIN_CHARS) & (english | original | spanish)

    possible = may_hold_headers(line) & (F.length(line) >= fixed.HEADER_MIN_CHARS)
    return F.when(possible, let(strip(line), strict)).otherwise(False)


def is_wrapped_header(line: Column, following: Column) -> Column:
    """``line`` becomes a header only together with ``following``."""
    joined = F.concat(line, F.lit(" "), following)
    return F.when(
        F.contains(line, F.lit("<")), ~is_message_header(line) & is_message_header(joined)
    ).otherwise(False)


def has_wrapped_header(lines: Column) -> Column:
    """Some line and its successor form a header together."""
    pairs = F.zip_with(
        lines,
        F.slice(lines, F.lit(2), F.size(lines)),
        lambda a, b: F.coalesce(is_wrapped_header(a, b), F.lit(False)),
    )
    return F.array_contains(pairs, True)


def _header_positions(lines: Column) -> Column:
    indexed = F.transform(lines, lambda line, i: F.when(is_message_header(line), i))
    return F.filter(indexed, lambda i: i.isNotNull())


def mark_messages(c: Column) -> Column:
    """Put a numbered rule before the second and every later header."""

    def with_lines(ls: Column) -> Column:
        def numbered(heads: Column) -> Column:
            def one(line: Column, i: Column) -> Column:
                number = F.array_position(heads, i)
                banner = F.concat(
                    F.lit(f"\n{fixed.MESSAGE_RULE}\n  Message "),
                    number.cast("string"),
                    F.lit(f"\n{fixed.MESSAGE_RULE}\n\n"),
                    line,
                )
                return F.when(may_hold_headers(line) & (number > 1), banner).otherwise(line)

            return F.array_join(F.transform(ls, one), "\n")

        return let(_header_positions(ls), numbered)

    return F.when(is_blank(c) | ~may_hold_headers(c), c).otherwise(
        let(F.split(c, "\n", -1), with_lines)
    )


def export_messages(c: Column) -> Column:
    """``ARRAY<STRUCT<message_no,text>>``; number 0 is text before any header."""

    def with_lines(ls: Column) -> Column:
        def cut(heads: Column) -> Column:
            starts = F.when(F.get(heads, F.lit(0)) == 0, heads).otherwise(
                F.array_prepend(heads, F.lit(0))
            )
            shift = F.when(F.get(heads, F.lit(0)) == 0, F.lit(1)).otherwise(F.lit(0))

            def one(start: Column, i: Column) -> Column:
                end = F.coalesce(F.get(starts, i + 1), F.size(ls))
                text = F.array_join(F.slice(ls, start + 1, end - start), "\n")
                return F.struct((i + shift).alias("message_no"), text.alias("text"))

            return F.transform(starts, one)

        return let(_header_positions(ls), cut)

    return let(F.split(c, "\n", -1), with_lines)


def squeeze_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\n{3,}", "\n\n")
