"""Ordered redaction of links, addresses, account, card and phone numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailweave.functions import fixed
from mailweave.functions.text import is_blank, let


def redact_booking_urls(c: Column) -> Column:
    return F.regexp_replace(c, fixed.BOOKING_URL_PATTERN, "<BOOKING_URL>")


def redact_emails(c: Column) -> Column:
    return F.regexp_replace(c, fixed.EMAIL_PATTERN, "<EMAIL>")


def redact_ibans(c: Column) -> Column:
    return F.regexp_replace(c, fixed.IBAN_PATTERN, "<IBAN>")


def redact_phones(c: Column) -> Column:
    return F.regexp_replace(c, fixed.PHONE_PATTERN, "<PHONE>")


def redact_cards(c: Column) -> Column:
    """Replace digit runs of card length only where the Luhn digit holds.

    The text between candidates and the candidates themselves are taken apart,
    checked one by one and put back together; texts without a candidate skip
    all of it.
    """
    pattern = fixed.CARD_PATTERN

    def checked(found: Column) -> Column:
        digits = F.translate(found, " -", "")
        return F.when(F.call_function("luhn_check", digits), F.lit("<CARD>")).otherwise(
            found
        )

    def rebuilt(text: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), checked)
        gaps = F.split(text, pattern, -1)
        pairs = F.zip_with(
            gaps, found, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))
        )
        return F.when(F.rlike(text, F.lit(pattern)), F.array_join(pairs, "")).otherwise(
            text
        )

    return let(c, rebuilt)


def sanitize(c: Column) -> Column:
    """All passes in their fixed order; blank input comes back unchanged."""
    early = redact_ibans(redact_emails(redact_booking_urls(c)))
    return F.when(is_blank(c), c).otherwise(redact_phones(redact_cards(early)))


def marker_counts(c: Column) -> list[Column]:
    """One count column per marker, e.g. ``n_email``."""
    return [
        F.regexp_count(c, F.lit(m)).cast("bigint").alias(f"n_{m.strip('<>').lower()}")
        for m in fixed.MARKERS
    ]
