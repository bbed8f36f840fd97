"""Columns read out of a mail message row.

A message row has ``headers ARRAY<STRUCT<name,value>>`` and ``parts
ARRAY<STRUCT<path,mime_type,data>>`` where ``path`` sorts depth-first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailweave.functions import fixed
from mailweave.functions.text import strip, words

DRAFT_LABEL = "DRAFT"


def header(headers: Column, name: str, default: str = "") -> Column:
    """Value of a header by case-insensitive name; the last duplicate wins."""
    hits = F.filter(headers, lambda h: F.lower(h["name"]) == name.lower())
    return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit(default))


def decode_base64url(data: Column) -> Column:
    """UTF-8 text of base64url data; padding may be missing, lines may be folded.

    Data that is no base64 at all gives null.
    """
    standard = F.translate(data, "-_= \t\r\n", "+/")
    padded = F.rpad(standard, (F.ceil(F.length(standard) / 4) * 4).cast("int"), F.lit("="))
    raw = F.try_to_binary(padded, F.lit("base64"))
    return F.make_valid_utf8(raw.cast("string"))


def plain_body(parts: Column) -> Column:
    """First non-empty ``text/plain`` part in depth-first order, else ''."""
    plain = F.filter(
        parts, lambda p: (p["mime_type"] == "text/plain") & (F.length(p["data"]) > 0)
    )
    placed = F.transform(
        plain,
        lambda p: F.struct(
            # Part numbers count as numbers: 0.2 comes before 0.10.
            F.transform(F.split(p["path"], "[.]"), lambda n: n.try_cast("int")).alias("place"),
            p["path"].alias("path"),
            p["data"].alias("data"),
        ),
    )
    decoded = F.transform(F.array_sort(placed), lambda p: decode_base64url(p["data"]))
    return F.coalesce(F.get(F.filter(decoded, lambda t: t != ""), F.lit(0)), F.lit(""))


def date_ms(internal_date: Column) -> Column:
    """Epoch milliseconds, null when missing or not a whole number."""
    return strip(internal_date).try_cast("bigint")


def received_at(ms: Column) -> Column:
    """``YYYY-MM-DD HH:MM UTC``, or '' when the time is unknown."""
    in_utc = F.to_utc_timestamp(F.timestamp_millis(ms), F.current_timezone())
    shown = F.concat(F.date_format(in_utc, "yyyy-MM-dd HH:mm"), F.lit(" UTC"))
    return F.coalesce(shown, F.lit(""))


def is_draft(label_ids: Column) -> Column:
    """Rows without labels count as sent mail."""
    return F.coalesce(F.array_contains(label_ids, DRAFT_LABEL), F.lit(False))


def address(from_header: Column) -> Column:
    """Bare address of a From header; quoted names and comments are no part of it."""
    unquoted = F.regexp_replace(from_header, r'"(?:[^"\\]|\\.)*"', "")
    bare = F.regexp_replace(unquoted, r"\([^()]*\)", "")
    bracketed = F.regexp_extract(bare, r"<([^<>]*)>", 1)
    return strip(F.when(bracketed != "", bracketed).otherwise(bare))


def is_staff(from_header: Column, domains: Sequence[str]) -> Column:
    """Sender's domain is one of ``domains`` (any case, leading @ allowed)."""
    wanted = sorted({d.strip().lower().removeprefix("@") for d in domains if d.strip()})
    addr = address(F.coalesce(from_header, F.lit("")))
    domain = F.lower(F.substring_index(addr, "@", -1))
    return F.contains(addr, F.lit("@")) & domain.isin(wanted)


def reply_subject(subject: Column) -> Column:
    trimmed = strip(subject)
    return F.when(F.lower(trimmed).startswith("re:"), trimmed).otherwise(
        F.concat(F.lit("Re: "), trimmed)
    )


def reference_chain(existing: Column, message_id_header: Column) -> Column:
    """Existing references plus the answered id, single-spaced."""
    return F.when(existing == "", message_id_header).otherwise(
        F.concat_ws(" ", F.array_append(words(existing), message_id_header))
    )


def _or_default(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def segment_tail(
    received: Column, sender: Column, subject: Column, body: Column
) -> Column:
    """A rendered message without its ordinal line."""
    return F.concat(
        F.lit("Received: "),
        _or_default(received, fixed.UNKNOWN_TIME),
        F.lit("\nFrom: "),
        _or_default(sender, fixed.UNKNOWN_SENDER),
        F.lit("\nSubject: "),
        _or_default(subject, fixed.DEFAULT_SUBJECT),
        F.lit("\nBody:\n"),
        _or_default(body, fixed.NO_BODY),
    )


SEGMENT_HEAD_OPEN = "--- MESSAGE "
SEGMENT_HEAD_CLOSE = " ---\n"
# Shortest possible segment: one-digit ordinal and one-character fields.
MIN_SEGMENT_CHARS = len(
    f"{SEGMENT_HEAD_OPEN}1{SEGMENT_HEAD_CLOSE}Received: {fixed.UNKNOWN_TIME}"
    "\nFrom: x\nSubject: x\nBody:\nx"
)


def segment_head(ordinal: Column) -> Column:
    return F.concat(
        F.lit(SEGMENT_HEAD_OPEN), ordinal.cast("string"), F.lit(SEGMENT_HEAD_CLOSE)
    )


def omission_banner(kept: Column) -> Column:
    return F.concat(
        F.lit(fixed.OMISSION_BANNER_HEAD),
        kept.cast("string"),
        F.lit(fixed.OMISSION_BANNER_TAIL),
    )
