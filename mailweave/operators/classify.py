"""Language and topic of a text through a classifier plug-in.

A classifier maps a text column to a raw answer column. Answers are parsed by
:mod:`mailweave.functions.answers`, so a word-list classifier and a model behind
``batch_classifier`` are interchangeable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.functions import answers, fixed, text

Classifier = Callable[[Column], Column]

# Common words of the default language classifier.
STOP_WORDS: Mapping[str, Sequence[str]] = {
    "it": ("il", "di", "che", "per", "non", "una", "sono", "con", "grazie", "vorrei"),
    "es": ("el", "los", "que", "para", "una", "por", "con", "las", "gracias", "del"),
    "en": ("the", "and", "of", "to", "is", "for", "with", "we", "you", "thanks"),
}
TOPIC_WORDS = ("tour", "tours", "trip", "travel", "viaje", "viaggio", "cusco", "peru")


def _answer(answer: Column) -> Column:
    return F.struct(answer.alias("answer"), F.lit(None).cast("string").alias("error"))


def _best_code(tokens: Column) -> Column:
    """Code of the word list that matches most often; en, es, it on equal counts."""

    def hits(code: str) -> Column:
        return F.size(F.filter(tokens, lambda w: w.isin(*STOP_WORDS[code])))

    ranked = F.greatest(
        *[
            F.struct(hits(code).alias("n"), F.lit(-i).alias("i"), F.lit(code).alias("code"))
            for i, code in enumerate(("en", "es", "it"))
        ]
    )
    return ranked["code"]


def stop_word_language(body: Column) -> Column:
    """Answer with the code of the word list that fits best."""
    return _answer(text.let(text.words(F.lower(body)), _best_code))


def word_topic(words: Sequence[str] = TOPIC_WORDS) -> Classifier:
    """``yes xx`` when a topic word occurs, else ``no xx``."""

    def answer(tokens: Column) -> Column:
        found = F.exists(tokens, lambda w: w.isin(*words))
        return F.concat(F.when(found, F.lit("yes ")).otherwise("no "), _best_code(tokens))

    return lambda body: _answer(text.let(text.words(F.lower(body)), answer))


def batch_classifier(answer: Callable[[str], str]) -> Classifier:
    """Wrap a Python model; a failing text gets an error, not a failed job."""

    @F.pandas_udf("answer string, error string")
    def classify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            out = []
            for value in series:
                try:
                    out.append((answer(value), None))
                except Exception as exc:  # noqa: BLE001 - isolated per row
                    out.append((None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(out, columns=["answer", "error"])

    return classify


def language_prompt(body: Column) -> Column:
    """Question text for a model that detects the language."""
    return F.concat(F.lit(fixed.LANGUAGE_QUESTION), text.language_sample(body))


def topic_prompt(subject: Column, body: Column) -> Column:
    """Question text for a model that decides on the topic."""
    head = F.replace(F.lit(fixed.TOPIC_QUESTION), F.lit("{subject}"), subject)
    return F.concat(head, text.classifier_body(body))


def detect_language(
    df: DataFrame, body: str, classifier: Classifier = stop_word_language
) -> DataFrame:
    """Add ``language`` and ``error`` from a classifier over the language sample."""
    asked = df.withColumn("_answer", classifier(text.language_sample(F.col(body))))
    return asked.withColumns(
        {
            "language": F.when(
                F.col("_answer")["error"].isNull(),
                answers.language_code(F.col("_answer")["answer"]),
            ),
            "error": F.col("_answer")["error"],
        }
    ).drop("_answer")


def classify_topic(
    df: DataFrame, subject: str, body: str, classifier: Classifier | None = None
) -> DataFrame:
    """Add ``related``, ``language`` and ``error``."""
    classifier = classifier or word_topic()
    asked_text = F.concat(F.col(subject), F.lit("\n\n"), text.classifier_body(F.col(body)))
    asked = df.withColumn("_answer", classifier(asked_text)).withColumn(
        "_parsed", answers.topic_answer(F.col("_answer")["answer"])
    )
    ok = F.col("_answer")["error"].isNull()
    return asked.withColumns(
        {
            "related": F.when(ok, F.col("_parsed")["related"]),
            "language": F.when(ok, F.col("_parsed")["language"]),
            "error": F.col("_answer")["error"],
        }
    ).drop("_answer", "_parsed")
