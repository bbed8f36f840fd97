"""Plain text helpers: trimming, splitting, sampling, previews, link ids."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailweave.functions import fixed


def strip(c: Column) -> Column:
    """Trim Unicode white space from both ends."""
    return F.btrim(c, F.lit(fixed.WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(fixed.WHITESPACE))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(strip(c), F.lit("")) == ""


def words(c: Column) -> Column:
    """Tokens between white-space runs, without empty ones."""
    return F.filter(F.split(c, f"[{fixed.WHITESPACE_CLASS}]+"), lambda w: w != "")


def lines(c: Column) -> Column:
    return F.split(c, fixed.LINE_END_PATTERN, -1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unix_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def approximate_tokens(c: Column) -> Column:
    """About four characters per token, never less than one."""
    return F.greatest(
        F.lit(1), F.floor(F.length(c) / fixed.CHARS_PER_TOKEN).cast("int")
    )


def paragraphs(c: Column) -> Column:
    """Trimmed, non-blank paragraphs between blank lines."""
    parts = F.split(unix_newlines(c), fixed.PARAGRAPH_BREAK_PATTERN, -1)
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def language_sample(c: Column) -> Column:
    """Whole text when short, else its head and tail around a banner."""
    limit = fixed.LANGUAGE_HEAD_CHARS + fixed.LANGUAGE_TAIL_CHARS
    return F.when(F.length(c) <= limit, c).otherwise(
        F.concat(
            F.left(c, F.lit(fixed.LANGUAGE_HEAD_CHARS)),
            F.lit(fixed.LANGUAGE_SAMPLE_BANNER),
            F.right(c, F.lit(fixed.LANGUAGE_TAIL_CHARS)),
        )
    )


def latest_turn(turn: Column, transcript: Column) -> Column:
    """The trimmed turn, or the transcript when the turn is blank."""
    return F.when(is_blank(turn), transcript).otherwise(strip(turn))


def retrieval_query(transcript: Column, subject: Column, turn: Column) -> Column:
    """Search text led by the latest turn, with recent thread context."""
    tail = F.right(transcript, F.lit(fixed.QUERY_TAIL_CHARS))
    return strip(
        F.concat(
            F.lit("Subject: "),
            subject,
            F.lit("\n\nLatest customer turn:\n"),
            latest_turn(turn, tail),
            F.lit("\n\nRecent thread context:\n"),
            tail,
        )
    )


def classifier_body(c: Column) -> Column:
    return F.left(c, F.lit(fixed.CLASSIFIER_BODY_CHARS))


def preview(c: Column, max_chars: int = 240) -> Column:
    """One line of at most ``max_chars`` characters, with an ellipsis if cut."""
    flat = F.replace(c, F.lit("\n"), F.lit(" "))
    keep = max(0, max_chars - 3)
    return F.when(
        F.length(flat) > max_chars, F.concat(F.left(flat, F.lit(keep)), F.lit("..."))
    ).otherwise(flat)


def link_id(c: Column, patterns: Sequence[str] = fixed.FOLDER_ID_PATTERNS) -> Column:
    """Id inside a share link; a bare id is returned trimmed."""
    found = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in patterns]
    return F.coalesce(*found, strip(c))
