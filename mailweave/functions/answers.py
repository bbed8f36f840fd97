"""Parsing of short free-text answers from an outside classifier."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailweave.functions import fixed
from mailweave.functions.text import is_blank, lines, strip, words

_CODES = tuple(fixed.LANGUAGE_NAMES)


def language_code(raw: Column) -> Column:
    """it / es / en out of an answer; anything unclear reads as ``en``."""
    answer = strip(F.lower(raw))
    first = F.btrim(F.get(lines(answer), F.lit(0)), F.lit(fixed.ANSWER_STRIP_CHARS))
    inside = F.nullif(F.regexp_extract(first, r"(?U)\b(it|es|en)\b", 1), F.lit(""))
    return (
        F.when(answer.isin(*_CODES), answer)
        .when(first.isin(*_CODES), first)
        .otherwise(F.coalesce(inside, F.lit(fixed.DEFAULT_LANGUAGE)))
    )


def topic_answer(raw: Column) -> Column:
    """Struct ``(related, language)`` from a ``yes it`` style answer."""
    tokens = words(F.lower(raw))
    rest = F.slice(tokens, F.lit(2), F.size(tokens))
    language = F.lit(fixed.DEFAULT_LANGUAGE)
    for code in reversed(_CODES):
        language = F.when(F.array_contains(rest, code), F.lit(code)).otherwise(language)
    related = F.coalesce(F.get(tokens, F.lit(0)).startswith("y"), F.lit(False))
    return F.struct(related.alias("related"), language.alias("language"))


def language_name(code: Column) -> Column:
    """English name of a language code, ``English`` when unknown."""
    name = F.lit(fixed.LANGUAGE_NAMES[fixed.DEFAULT_LANGUAGE])
    for known, label in fixed.LANGUAGE_NAMES.items():
        name = F.when(code == known, F.lit(label)).otherwise(name)
    return name


def reply_error(reply: Column) -> Column:
    """Error text for a blank reply, null for a usable one."""
    return F.when(is_blank(reply), F.lit("empty reply"))
