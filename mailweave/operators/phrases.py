"""Replacement of listed phrases (names and the like) by stand-ins."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailweave.functions import fixed
from mailweave.functions.batches import slices
from mailweave.functions.redact import sanitize
from mailweave.functions.text import strip
from mailweave.operators.exports import tidy_export
from mailweave.operators.skew import number_rows
from mailweave.session import materialize
from mailweave.sources.files import write_files

# Phrases of one automaton, some hundred megabytes for names.
PHRASE_BLOCK = 200_000


def distinct_phrases(phrases: DataFrame) -> DataFrame:
    """Trimmed, non-blank ``(pos, phrase)`` rows, each phrase at its first place."""
    trimmed = phrases.select("pos", strip(F.col("phrase")).alias("phrase"))
    return trimmed.where(F.col("phrase") != "").groupBy("phrase").agg(F.min("pos").alias("pos"))


def stand_ins(phrases: DataFrame, style: str = "pool") -> DataFrame:
    """``(phrase, replacement, place)`` in first-seen order.

    ``pool`` cycles through fictive names, ``numbered`` counts, ``marker`` uses
    one marker for all.
    """
    placed = number_rows(distinct_phrases(phrases), [F.col("pos"), F.col("phrase")], "place")
    place = F.col("place")
    pool = F.array(*[F.lit(n) for n in fixed.STAND_IN_POOL])
    choices = {
        "pool": F.get(pool, ((place - 1) % len(fixed.STAND_IN_POOL)).cast("int")),
        "numbered": F.concat(F.lit(fixed.NUMBERED_STAND_IN), place.cast("string")),
        "marker": F.lit(fixed.NAME_MARKER),
    }
    return placed.select("phrase", choices[style].alias("replacement"), "place")


class _Folds(dict):
    """Code point to the one that stands for all its case forms."""

    def __missing__(self, point: int) -> int:
        char = chr(point)
        found = char
        upper = char.upper()
        for form in (upper.lower() if len(upper) == 1 else "", char.lower()):
            if len(form) == 1:
                found = form
                break
        value = self[point] = ord(found)
        return value


class PhraseRules:
    """Literal, case-insensitive replacement by a list of phrases, one after the other.

    An automaton over the folded phrases finds in one pass which of them a text holds; only these
    are applied, in the order of the list. A replacement can complete a later, not longer
    phrase: the places around it are searched again. The result is that of going
    through the whole list. Two letters are equal when their single-letter case forms are.
    """

    def __init__(self, pairs: Sequence[tuple[str, str]]) -> None:
        import ahocorasick

        self.folds = _Folds()
        self.keys = [self.folded(phrase) for phrase, _ in pairs]
        self.others = [other for _, other in pairs]
        self.folded_others = [self.folded(other) for other in self.others]
        turns: dict[str, list[int]] = {}
        for turn, key in enumerate(self.keys):
            turns.setdefault(key, []).append(turn)
        self.automaton = ahocorasick.Automaton()
        for key, found in turns.items():
            self.automaton.add_word(key, tuple(found))
        self.automaton.make_automaton()

    def folded(self, text: str) -> str:
        return text.lower() if text.isascii() else text.translate(self.folds)

    def replace(self, text: str) -> str:
        low = self.folded(text)
        known = {turn for _, turns in self.automaton.iter(low) for turn in turns}
        waiting = sorted(known)
        while waiting:
            turn = heapq.heappop(waiting)
            key, other = self.keys[turn], self.others[turn]
            cuts, at = [], low.find(key)
            while at >= 0:
                cuts.append(at)
                at = low.find(key, at + len(key))
            if not cuts:
                continue  # a longer phrase took it
            text = other.join(_between(text, cuts, len(key)))
            low = self.folded_others[turn].join(_between(low, cuts, len(key)))
            # What comes later is not longer than this phrase.
            reach, end = len(key) - 1, 0
            for i, cut in enumerate(cuts):
                place = cut + i * (len(other) - len(key))
                start = max(place - reach, end - reach, 0)
                end = min(place + len(other) + reach, len(low))
                for _, turns in self.automaton.iter(low, start, end):
                    for later in turns:
                        if later > turn and later not in known:
                            known.add(later)
                            heapq.heappush(waiting, later)
        return text


def _between(text: str, cuts: list[int], size: int) -> list[str]:
    starts = [0, *(c + size for c in cuts)]
    return [text[a:b] for a, b in zip(starts, [*cuts, len(text)], strict=True)]


def replace_phrases(df: DataFrame, pairs: Sequence[tuple[str, str]], text: str = "text") -> DataFrame:
    """Apply ``(phrase, replacement)`` pairs in the given order, longer phrases first.

    All tasks get the pairs as a broadcast, so there should be at most some PHRASE_BLOCK.
    Blank phrases are ignored and a null text stays null.
    """
    usable = sorted(((p, r) for p, r in pairs if p and p.strip()), key=lambda pair: -len(pair[0]))
    if not usable:
        return df
    sent = df.sparkSession.sparkContext.broadcast(usable)
    at, schema = df.columns.index(text), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = PhraseRules(sent.value)
        for batch in slices(batches):
            done = [None if t is None else rules.replace(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(done, batch.schema.field(at).type))

    return df.mapInArrow(run, schema)


def redact_phrases(
    df: DataFrame, phrases: DataFrame, text: str = "text", style: str = "pool"
) -> DataFrame:
    """Replace every listed phrase in ``text``.

    Longer phrases go first, so the list is put in that order and cut into blocks of
    PHRASE_BLOCK; a block is all that the driver or a task ever holds of it. Blocks are applied one
    after another, with the texts written in between.
    """
    pairs = stand_ins(phrases, style).withColumn("_chars", F.length("phrase"))
    # Numbered once; each block reads its own rows of the stored list.
    placed = materialize(number_rows(pairs, [F.desc("_chars"), F.col("place")], "_turn"), "phrases")
    total = placed.count()
    for start in range(0, total, PHRASE_BLOCK):
        if start:
            df = materialize(df, "redacted")
        block = placed.where((F.col("_turn") > start) & (F.col("_turn") <= start + PHRASE_BLOCK))
        rows = block.orderBy("_turn").select("phrase", "replacement").collect()
        df = replace_phrases(df, [(row.phrase, row.replacement) for row in rows], text)
    return df


def redact_documents(
    df: DataFrame,
    phrases: DataFrame | None = None,
    text: str = "text",
    *,
    style: str = "pool",
    tidy: bool = True,
) -> DataFrame:
    """Whole redaction: patterns, then listed phrases, then export tidy."""
    out = df.withColumn(text, sanitize(F.col(text)))
    if phrases is not None:
        out = redact_phrases(out, phrases, text, style)
    if tidy:
        out = tidy_export(out, text)
    return out


def redacted_name(path: Column) -> Column:
    """``dir/stem.ext`` to ``dir/stem.redacted.ext``, so equal names in two folders stay apart."""
    name = F.substring_index(path, "/", -1)
    folder = F.substring(path, F.lit(1), F.length(path) - F.length(name))
    stem = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 1)
    suffix = F.regexp_extract(name, r"^(.+?)(\.[^.]*)?$", 2)
    return F.concat(folder, stem, F.lit(".redacted"), suffix)


def redact_files(
    files: DataFrame, folder: str, phrases: DataFrame | None = None, **options
) -> DataFrame:
    """Redact ``(path, text)`` rows and write one file each below ``folder``, under
    :func:`redacted_name` of its path. Gives ``(name, n_bytes)``."""
    done = redact_documents(files.select("path", "text"), phrases, **options)
    return write_files(done.withColumn("path", redacted_name(F.col("path"))), folder, "path", "text")
