"""Language of every text, from spans found by Viterbi over its words.

Training counts letter trigrams and whole words of labelled texts in BUCKETS hashed buckets per
language, over all training rows: tasks count, the counts are summed by bucket. It also counts in
which scripts a language is written. The model is languages x BUCKETS numbers whatever the
corpus holds, and goes to the tasks as a broadcast.

A word's script narrows its candidate languages to those written in it; its score under a
language is the log-likelihood of its trigrams and of the word. Viterbi over the words of a
text, with a penalty for each switch, gives spans of one language. The text's language is
the one with most letters in its spans, and the score is its share of the letters. Letters of a script
that no learned language is written in speak for none, so such a text has score 0.

Null texts and texts without a letter are ``und`` with score 0, and so is everything where
there is nothing to learn from. Ties go to the first language in alphabetical order.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm.common import map_slices, mix64, offsets, slices, texts_of

BUCKETS = 1 << 15
SWITCH = 12.0  # log-likelihood that a change of language has to gain
WORD_LIMIT = 200_000
UNKNOWN = "und"
# First code point of each script range (fixed values: Unicode blocks), and its name.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"),
    (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"),
    (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
)
SCRIPT_NAMES = tuple(dict.fromkeys(name for _, name in SCRIPTS))
_STARTS = np.array([s for s, _ in SCRIPTS])
_KIND = np.array([SCRIPT_NAMES.index(n) for _, n in SCRIPTS])
# A language counts as written in a script from this share of its words on.
SCRIPT_SHARE = 0.001


# Scripts written without blanks: words are cut into units of so many letters.
UNSEGMENTED, UNIT = frozenset({"han", "kana", "thai"}), 4
LANGUAGES = 512  # most frequent languages that a model can hold
_BEYOND_LATIN = re.compile("[\u0370-\u1dff\u1f00-\U0010ffff]")


def script_of(char: str) -> str:
    return SCRIPT_NAMES[_KIND[np.searchsorted(_STARTS, ord(char), "right") - 1]]


def units_of(text: str) -> list[str]:
    """Words between blanks, cut where the script of the letters changes; units of UNIT letters
    where a script has no blanks."""
    if not _BEYOND_LATIN.search(text):
        return text.split()
    out = []
    for word in text.split():
        if not _BEYOND_LATIN.search(word):
            out.append(word)
            continue
        start, script, letters = 0, None, 0
        for i, char in enumerate(word):
            if not char.isalpha():
                continue
            now = script_of(char)
            if script is not None and (now != script or now in UNSEGMENTED and letters == UNIT):
                out.append(word[start:i])
                start, letters = i, 0
            script, letters = now, letters + 1
        out.append(word[start:])
    return out


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words one after the other, how many each has, letters and script of each.

    A word is lower-cased; everything but letters counts as a boundary. Words without letters
    have no buckets.
    """
    cleaned = [
        w if w.isalpha() else " ".join("".join(c if c.isalpha() else " " for c in w).split())
        for w in map(str.lower, words)
    ]
    joined = "".join(f" {w} " for w in cleaned)
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, cleaned), np.int64, len(cleaned))
    bounds = offsets(sizes + 2)
    n = len(codes)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    a, b = np.concatenate([[32], codes[:-1]]).astype(np.uint64), codes
    c = np.concatenate([codes[1:], [32]]).astype(np.uint64)
    gram = mix64((a << np.uint64(42)) ^ (b << np.uint64(21)) ^ c)
    place = np.arange(n) - np.repeat(bounds[:-1], sizes + 2)
    whole = np.add.reduceat(mix64(codes + (place.astype(np.uint64) << np.uint64(24))), bounds[:-1])
    letter = codes != 32
    letters = np.add.reduceat(letter.astype(np.int64), bounds[:-1])
    # The last boundary's slot holds the whole word.
    gram[bounds[1:] - 1] = mix64(whole)
    use = letter.copy()
    use[bounds[1:] - 1] = letters > 0
    per = np.add.reduceat(use.astype(np.int64), bounds[:-1])
    opening = np.minimum(bounds[:-1] + 1, n - 1)
    script = _KIND[np.searchsorted(_STARTS, codes[opening].astype(np.int64), "right") - 1]
    return (gram[use] & np.uint64(BUCKETS - 1)).astype(np.int64), per, letters, script


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict:
    """Model from all rows with a text and a language."""
    kinds = len(SCRIPT_NAMES)

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, 0):
                by_lang: dict[str, dict[str, int]] = {}
                langs = part.column(1).to_pylist()
                for lang, text in zip(langs, texts_of(part.column(0)), strict=True):
                    counts = by_lang.setdefault(lang, {})
                    for w in units_of(text):
                        counts[w] = counts.get(w, 0) + 1
                for lang, counts in by_lang.items():
                    if not counts:
                        continue
                    bucket, per, letters, script = features(list(counts))
                    n = np.fromiter(counts.values(), np.float64, len(counts))
                    total = held.setdefault(lang, np.zeros(BUCKETS + kinds))
                    total[:BUCKETS] += np.bincount(bucket, np.repeat(n, per), BUCKETS)
                    total[BUCKETS:] += np.bincount(script, n * (letters > 0), kinds)
        for lang, total in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at)), pa.array(at), pa.array(total[at].astype(np.int64))],
                names=["lang", "bucket", "n"],
            )

    known = df.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(text_col, lang_col)
    frequent = known.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(LANGUAGES)
    # At most LANGUAGES short rows.
    rows = known.join(F.broadcast(frequent.select(lang_col)), lang_col, "left_semi").select(
        text_col, lang_col
    ).mapInArrow(run, "lang string, bucket long, n long")
    # At most LANGUAGES x buckets, whatever the corpus holds.
    counted = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counted["lang"].unique())
    table = np.zeros((len(langs), BUCKETS + kinds))
    table[counted["lang"].map(langs.index).to_numpy(int), counted["bucket"].to_numpy(int)] = counted["n"]
    grams, scripts = table[:, :BUCKETS], table[:, BUCKETS:]
    score = np.log((grams + 0.5) / (grams.sum(1, keepdims=True) + 0.5 * BUCKETS))
    share = scripts / np.maximum(scripts.sum(1, keepdims=True), 1)
    return {"langs": langs, "score": score.T.astype(np.float32), "written": (share >= SCRIPT_SHARE).T}


class WordScores(dict):
    """Word to its number, with the scores of every word under every language."""

    def __init__(self, model: dict) -> None:
        super().__init__()
        self.model = model
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.new: list[str] = []
        self.score = np.zeros((0, len(self.model["langs"])), np.float32)
        self.letters = np.zeros(0, np.int64)
        self.sure = np.zeros(0, np.int64)  # letters in a script that some language is written in

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number

    def resolve(self) -> None:
        new, self.new = self.new, []
        if not new:
            return
        bucket, per, letters, script = features(new)
        score = np.zeros((len(new), self.score.shape[1]), np.float32)
        some = per > 0
        sure = np.zeros(len(new), np.int64)
        starts = (np.cumsum(per) - per)[some]
        if len(starts) and score.shape[1]:
            sums = np.add.reduceat(self.model["score"][bucket], starts, axis=0)
            fits = self.model["written"][script[some]]
            # A script nobody writes says nothing; otherwise only its languages stay.
            lowest = sums.min(1, keepdims=True) - SWITCH
            sums = np.where(fits | ~fits.any(1, keepdims=True), sums, lowest)
            sums = np.where(fits.any(1, keepdims=True), sums, 0)
            score[some] = sums - sums.max(1, keepdims=True)
            sure[some] = np.where(fits.any(1), letters[some], 0)
        self.score = np.concatenate([self.score, score])
        self.letters = np.concatenate([self.letters, letters])
        self.sure = np.concatenate([self.sure, sure])


def viterbi(score: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Best label of every word; texts lie one after the other with ``sizes`` words each.

    All texts take their n-th step together.
    """
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    long = sizes[order]
    n_langs = score.shape[1]
    labels = np.zeros(len(score), np.int16)
    came = np.zeros((len(score), n_langs), np.int16)
    steps = int(long[0]) if len(long) else 0
    own = np.arange(n_langs, dtype=np.int16)
    # Active texts at each step are a prefix of the order.
    active = np.searchsorted(-long, -np.arange(steps), "left")
    best = np.zeros((len(long), n_langs))
    for t in range(steps):
        k = active[t]
        at = first[:k] + t
        v = best[:k]
        if t:
            top = v.argmax(1)
            switched = v[np.arange(k), top][:, None] - SWITCH
            stay = v >= switched
            came[at] = np.where(stay, own, top[:, None])
            v = np.where(stay, v, switched)
        best[:k] = v + score[at]
    state = best.argmax(1)
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = first[:k] + t
        labels[at] = state[:k]
        state[:k] = came[at, state[:k]] if t else state[:k]
    return labels


def identify(
    df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, lang_pred, score, spans)`` for every row; ``spans`` lists the language and
    the number of units (words) of each run, in order."""
    shared = SparkSession.active().sparkContext.broadcast(model)
    span = pa.struct([("lang", pa.string()), ("words", pa.int64())])

    def work():
        model = shared.value
        words = WordScores(model)
        langs = np.array([*model["langs"], UNKNOWN], object)
        n_langs = len(model["langs"])

        def handle(part: pa.RecordBatch) -> list:
            if len(words) > WORD_LIMIT:
                words.restart()
            found = []
            for text in texts_of(part.column(1)):
                split = units_of(text)
                found.append(np.fromiter(map(words.__getitem__, split), np.int64, len(split)))
            words.resolve()
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            number = np.concatenate(found)
            letters = words.letters[number]
            doc = np.repeat(np.arange(len(sizes)), sizes)
            total = np.bincount(doc, letters, len(sizes))
            if not n_langs:
                best, share = np.zeros(len(sizes), int), np.zeros(len(sizes))
                labels = np.zeros(len(number), np.int16)
                total[:] = 0
            else:
                labels = viterbi(words.score[number], sizes)
                mass = np.bincount(
                    doc * n_langs + labels, words.sure[number], len(sizes) * n_langs
                ).reshape(-1, n_langs)
                best = mass.argmax(1)
                share = mass.max(1) / np.maximum(total, 1)
            best = np.where(total > 0, best, n_langs)
            change = np.ones(len(number), bool)
            change[1:] = (labels[1:] != labels[:-1]) | (doc[1:] != doc[:-1])
            starts = np.flatnonzero(change)
            runs = pa.StructArray.from_arrays(
                [
                    pa.array(langs[labels[starts]] if n_langs else [UNKNOWN] * len(starts), pa.string()),
                    pa.array(np.diff(np.append(starts, len(number)))),
                ],
                fields=list(span),
            )
            per = offsets(np.bincount(doc[starts], minlength=len(sizes)))
            return [
                part.column(0), pa.array(langs[best], pa.string()),
                pa.array(np.where(total > 0, share, 0.0)),
                pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), runs),
            ]

        return handle

    kind = dict(df.dtypes)[id_col]
    return map_slices(
        df.select(id_col, text_col), work,
        f"{id_col} {kind}, lang_pred string, score double, "
        "spans array<struct<lang:string,words:bigint>>",
    )
