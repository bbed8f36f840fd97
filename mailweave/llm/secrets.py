"""Secret scan of whole texts: fixed patterns, and strings that do not compress.

The patterns give the kinds ``assign``, ``access`` and ``hex``. Beyond them every string of 16 or
more letters, digits, a few signs and ``%XX`` codes, with up to two ``=`` behind it, is a candidate
if it stands in a line with a sensitive word or in a line that belongs to one:

* up to the end mark of a PEM block that the line begins,
* up to the quote that closes a value left open,
* behind a line that ends in ``:``, ``=``, a block mark or an open bracket, the next line with
  letters or digits and all lines that are further indented,
* behind a line that ends in a backslash, the next one,
* lines of one candidate and nothing else right behind any of these.

Its novelty is the number of bytes by which it lengthens the zstandard form of the code around
it, where the compressor starts with a dictionary of the identifiers that occur in
sensitive lines of the corpus; per character, NOVEL or more is reported as ``novel``.

The identifier dictionary is gathered over all texts: each task counts the plain
identifiers of its sensitive lines and gives its table out whenever it is full, so the
summed counts are exact; the IDENTIFIERS most frequent make up the dictionary. Strings
with digits never enter it, so a copied secret stays novel.

A null text counts as empty and has no spans. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm.common import map_slices, release, slices, texts_of

MASK = "<SECRET>"
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
# Words behind which a string may be a secret.
SENSITIVE = (
    "password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key",
    "private", "credential", "auth", "bearer", "signature",
)
WORD = re.compile("(?i:" + "|".join(SENSITIVE) + ")")
SIGNS = r"(?:[A-Za-z0-9+/_-]|%[0-9A-Fa-f]{2}){16,}={0,2}"
# The letter of an escaped line end is not part of what follows it.
CANDIDATE = re.compile(
    r"(?:(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nrt])|(?<=\\[nrt]))" + SIGNS
)
ALONE = re.compile(r"[\s\"'`+,]*" + SIGNS + r"[\s\"'`+,;\\)]*")
OPEN_QUOTE = re.compile(r"[:=]\s*(\"{3}|'{3}|[\"'`])((?:(?!\1).)*)\Z")
OPEN_VALUE = re.compile(r"(?:[:=]\s*[|>][+-]?[0-9]?[+-]?|[:=\[{(])\s*\Z")
PEM, PEM_END = "-----BEGIN", "-----END"
IDENTIFIER = re.compile(r"(?a:\b[A-Za-z_]{3,24}\b)")
# Surrounding code a candidate is compressed against, in code points on each side (a parameter of the
# method: a repeat further away does not make a string known).
AROUND = 256
NOVEL = 0.6
IDENTIFIERS, KEPT = 4_096, 50_000


def sensitive(low: str) -> bool:
    return any(w in low for w in SENSITIVE)


def identifiers(df: DataFrame, text_col: str = "text") -> list[str]:
    """The most frequent plain identifiers of sensitive lines, rarest first.

    Counts are over all documents; a task only adds up what it can hold.
    """

    def counted(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
            names=["word", "n"],
        )

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch, 0):
                for text in texts_of(part.column(0)):
                    if not sensitive(text.lower()):
                        continue
                    for line in text.split("\n"):
                        if sensitive(line.lower()):
                            held.update(IDENTIFIER.findall(line))
                    # A full table goes out as it is; the sum below puts all parts together.
                    if len(held) > KEPT:
                        yield counted(held)
                        held = Counter()
        if held:
            yield counted(held)

    summaries = df.select(text_col).mapInArrow(run, "word string, n long")
    top = summaries.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word")
    return [row.word for row in top.limit(IDENTIFIERS).select("word").collect()][::-1]


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """``(start, kind number, end)`` of the fixed patterns."""
    found = []
    if any(w in low for w in ASSIGN_WORDS):
        found += [
            (m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6
        ]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


class Regions:
    """Lines with sensitive words and the lines that belong to them."""

    def __init__(self, text: str) -> None:
        self.text, self.pem_end = text, -2  # -1: none is left

    def line_end(self, start: int) -> int:
        """Where the line that has ``start`` in it ends."""
        at = self.text.find("\n", start)
        return len(self.text) if at < 0 else at

    def belongs(self, start: int, end: int) -> int:
        """The end of what belongs to the sensitive line from ``start`` to ``end``."""
        text, line = self.text, self.text[start:end]
        if PEM in line:
            begin = start + line.rindex(PEM)
            if self.pem_end != -1 and self.pem_end < begin:
                self.pem_end = text.find(PEM_END, begin)
            if self.pem_end >= 0:
                end = max(end, self.line_end(self.pem_end))
        elif quote := OPEN_QUOTE.search(line):
            close = text.find(quote[1], end)
            if close >= 0:
                end = self.line_end(close)
        elif OPEN_VALUE.search(line):
            end = self.block(end, len(line) - len(line.lstrip()))
        while end < len(text):
            after = self.line_end(end + 1)
            if not (text.endswith("\\", start, end) or ALONE.fullmatch(text, end + 1, after)):
                break
            end = after
        return end

    def block(self, end: int, indent: int) -> int:
        """The end of the first line with letters or digits behind ``end`` and of the lines behind
        it that are further indented."""
        text, seen, at = self.text, False, end
        while at < len(text):
            after = self.line_end(at + 1)
            line = text[at + 1 : after]
            bare = line.lstrip()
            if bare and seen and len(line) - len(bare) <= indent:
                break
            seen = seen or any(map(str.isalnum, bare))
            if bare:
                end = after
            at = after
        return end

    def find(self) -> list[tuple[int, int]]:
        """``(start, end)`` of all regions, in order and apart."""
        out, line = [], -1
        for m in WORD.finditer(self.text):
            if m.start() < line:
                continue
            start = self.text.rfind("\n", 0, m.start()) + 1
            line = self.line_end(m.end())
            end = self.belongs(start, line)
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], max(out[-1][1], end))
            else:
                out.append((start, end))
        return out


class Novelty:
    """Marginal compressed bytes of candidates."""

    def __init__(self, words: list[str]) -> None:
        # Content nearest to the data comes last in a raw zstandard dictionary.
        raw = "\n".join(words).encode() or b"\n"
        self.compressor = zstandard.ZstdCompressor(
            level=6, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        )

    def rate(self, text: str, start: int, end: int) -> float:
        """Bytes a candidate adds to its surroundings, per character."""
        head = text[max(0, start - AROUND) : start]
        tail = text[end : end + AROUND]
        size = self.compressor.compress
        with_it = len(size((head + text[start:end] + tail).encode("utf-8", "replace")))
        return (with_it - len(size((head + tail).encode("utf-8", "replace")))) / (end - start)

    def spans(self, text: str, low: str, taken: list[tuple[int, int, int]]):
        if not sensitive(low):
            return []
        # Covered parts, in order and apart.
        starts, ends = [], []
        for s, _, e in sorted(taken):
            if starts and s <= ends[-1]:
                ends[-1] = max(ends[-1], e)
            else:
                starts.append(s)
                ends.append(e)
        found = []
        for first, last in Regions(text).find():
            for m in CANDIDATE.finditer(text, first, last):
                start, end = m.span()
                at = bisect_right(starts, start) - 1
                if at >= 0 and end <= ends[at]:
                    continue
                if self.rate(text, start, end) >= NOVEL:
                    found.append((start, 3, end))
        return found


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every span, overlapping ones together, replaced by MASK."""
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], MASK]
        done = max(done, end)
    return "".join([*out, text[done:]])


def mask(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df``, all columns, with the secrets in ``text_col`` masked; null texts stay null."""
    words = SparkSession.active().sparkContext.broadcast(identifiers(df, text_col))
    place, schema = df.columns.index(text_col), df.schema

    def run(batches):
        release()  # what earlier stages left in this worker
        novelty = Novelty(words.value)
        for batch in batches:
            for part in slices(batch, place):
                texts = []
                for text in part.column(place).to_pylist():
                    if text:
                        low = text.lower()
                        found = base_spans(text, low)
                        text = masked(text, sorted(found + novelty.spans(text, low, found)))
                    texts.append(text)
                columns = part.columns
                columns[place] = pa.array(texts, part.schema.field(place).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)
                del texts, columns
        release()

    return df.mapInArrow(run, schema)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, spans array<struct<kind, start, end>>)`` for every row, ordered by start
    and kind."""
    words = SparkSession.active().sparkContext.broadcast(identifiers(df, text_col))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def work():
        novelty = Novelty(words.value)

        def handle(part: pa.RecordBatch) -> list:
            out = []
            for text in texts_of(part.column(1)):
                low = text.lower()
                found = base_spans(text, low)
                found = sorted(found + novelty.spans(text, low, found))
                out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
            return [part.column(0), pa.array(out, pa.list_(span))]

        return handle

    kind = dict(df.dtypes)[id_col]
    names = f"{id_col} {kind}, spans array<struct<kind:string,start:int,end:int>>"
    return map_slices(df.select(id_col, text_col), work, names)
