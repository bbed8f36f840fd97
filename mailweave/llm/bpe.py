"""Byte-pair encoding of whole texts with vocabulary files of the tokenizers library.

A task collects the distinct pre-tokens it has not met yet, lays their symbols out
in one array and keeps an index from each mergeable pair to all its positions there.
Ranks with positions are applied in ascending order; each merge looks at all
positions of its pair at once and files the pairs it creates under their ranks. Every
text is then a gather of encoded units. Unit tables are bounded and start anew when
full but for their most used half, which changes no result.

Nulls count as empty texts; an empty text has no ids. Strings of special tokens inside
a text become their ids, as in the library. Repeated rows give repeated results.
Columns other than the named ones are not read and not returned.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm.common import list_array, map_slices, offsets, ragged_take, texts_of

# Units a task remembers; beyond it only the most used half stays.
UNIT_LIMIT = 200_000
# Positions whose pairs are looked up at a time, and new units split at a time: these bound what a task
# holds beside its tables.
POSITIONS, SPLIT_UNITS = 1 << 19, 1 << 16
# The pre-token pattern of the byte-level vocabulary (fixed value of the format).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """What tasks need of a vocabulary file: a few numpy arrays, sent as a broadcast.

    Its size is that of the vocabulary (tens of thousands of entries), whatever the corpus.
    """

    words: bool  # lower-cased words with an end mark; else whole byte-level texts
    pattern: str
    first: np.ndarray  # symbol of each byte
    last: np.ndarray  # symbol of each byte at the end of a pre-token
    keys: np.ndarray  # pair keys in ascending order, and the rank of each
    ranks: np.ndarray
    left: np.ndarray  # by rank
    right: np.ndarray
    made: np.ndarray
    specials: dict[str, int]
    pieces: list[bytes]  # bytes of each id

    def send(self) -> Broadcast:
        """Broadcast the fields; plain values need no copy of this package to be read."""
        return SparkSession.active().sparkContext.broadcast(dict(self.__dict__))


def load(path: str) -> Vocabulary:
    """Read a BPE file of the tokenizers library: byte-level, or words with an end mark."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    model, pre = data["model"], data["pre_tokenizer"]
    suffix = model["end_of_word_suffix"] or ""
    plain = model["type"] == "BPE" and not model["byte_fallback"] and not model["dropout"]
    if pre["type"] == "ByteLevel":
        known = pre["use_regex"] and not pre["add_prefix_space"] and data["normalizer"] is None
        words, pattern = False, BYTE_LEVEL
    else:
        split, level = pre["pretokenizers"]
        steps = [s["type"] for s in data["normalizer"]["normalizers"]]
        known = steps == ["NFC", "Replace", "Lowercase"] and not level["use_regex"]
        known = known and split["behavior"] == "Removed" and split["invert"]
        words, pattern = True, split["pattern"]["Regex"]
    if not (plain and known) or any(t["normalized"] for t in data["added_tokens"]):
        raise ValueError(f"not a supported vocabulary: {path}")
    vocab, symbols = model["vocab"], byte_symbols()
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    left, right, made = (
        np.array([vocab[x] for x in column], np.int64)
        for column in ([a for a, _ in merges], [b for _, b in merges], [a + b for a, b in merges])
    )
    keys = left << 32 | right
    order = np.argsort(keys, kind="stable")
    specials = {t["content"]: t["id"] for t in data["added_tokens"]}
    byte_of = {c: b for b, c in enumerate(symbols)}
    pieces = [b""] * (1 + max([*vocab.values(), *specials.values()]))
    for token, i in vocab.items():
        pieces[i] = bytes(byte_of[c] for c in token.removesuffix(suffix) if c in byte_of)
        if suffix and token.endswith(suffix):
            pieces[i] += b" "
    for token, i in specials.items():
        pieces[i] = token.encode()
    return Vocabulary(
        words, pattern,
        np.array([vocab[c] for c in symbols], np.int64),
        np.array([vocab[c + suffix] for c in symbols], np.int64),
        keys[order], order.astype(np.int64), left, right, made, specials, pieces,
    )


def _ascending(lists: list[np.ndarray]) -> np.ndarray:
    """The distinct values of the lists; for short lists faster than np.unique, which hashes them."""
    both = np.concatenate(lists)
    both.sort()
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


class PairIndex:
    """Encodes many pre-tokens at once."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.v.keys, key), len(self.v.keys) - 1)
        return np.where(self.v.keys[at] == key, self.v.ranks[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        v = self.v
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        del words
        n = len(raw)
        if not n:
            return np.zeros(0, np.int32), sizes
        ends = np.cumsum(sizes)
        tails = (ends - 1)[sizes > 0]
        symbol = v.first.astype(np.int32)[raw]
        symbol[tails] = v.last[raw[tails]]
        after = np.arange(1, n + 1, dtype=np.int32)
        after[tails] = -1
        before = np.arange(-1, n - 1, dtype=np.int32)
        before[(ends - sizes)[sizes > 0]] = -1
        alive = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def file(where: np.ndarray) -> None:
            """Put positions under the ranks of the pairs that start there."""
            found = self.rank(symbol[where], symbol[after[where]])
            some = found >= 0
            where, found = where[some], found[some]
            if not len(where):
                return
            order = np.argsort(found, kind="stable")
            where, found = where[order], found[order]
            cuts = [0, *(np.flatnonzero(found[1:] != found[:-1]) + 1).tolist(), len(found)]
            for i, r in enumerate(found[cuts[:-1]].tolist()):
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(where[cuts[i] : cuts[i + 1]])

        for start in range(0, n, POSITIONS):
            inner = np.flatnonzero(after[start : start + POSITIONS] >= 0)
            file((inner + start).astype(np.int32))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else _ascending(lists)
            a, b = v.left[r], v.right[r]
            other = after[at]
            valid = alive[at] & (other >= 0) & (symbol[at] == a) & (symbol[other] == b)
            at, other = at[valid], other[valid]
            if a == b:  # of overlapping pairs the left one counts
                kept, used = [], -1
                for i, (x, y) in enumerate(zip(at.tolist(), other.tolist(), strict=True)):
                    if x != used:
                        kept.append(i)
                        used = y
                at, other = at[kept], other[kept]
            if not len(at):
                continue
            symbol[at] = v.made[r]
            alive[other] = False
            beyond = after[other]
            after[at] = beyond
            has = beyond >= 0
            before[beyond[has]] = at[has]
            earlier = before[at]
            file(_ascending([earlier[earlier >= 0], at[has]]))
        del after, before
        left = np.zeros(n + 1, np.int32)
        np.cumsum(alive, out=left[1:])
        return symbol[alive], np.diff(left[offsets(sizes)]).astype(np.int64)


class Units(dict):
    """Unit to its number, with the ids of every unit; new units get a number at once
    and their ids at the next :meth:`resolve`.

    A unit is a piece between blanks (byte-level: with the blank before it), or a tuple
    ``(text,)`` for a piece without it, or ``("", special)`` for a special token.
    """

    def __init__(self, v: Vocabulary, seed: tuple = (), limit: int = UNIT_LIMIT) -> None:
        super().__init__()
        self.v, self.limit, self.seed = v, limit, seed
        self.pairs = PairIndex(v)
        self.pattern = regex.compile(v.pattern)
        self.special = (
            regex.compile("(" + "|".join(map(regex.escape, v.specials)) + ")")
            if v.specials else None
        )
        self.new: list = []
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.stop = np.zeros(0, np.int32), np.zeros(0, bool)
        self.used = np.zeros(0, np.int64)
        self.new = []
        self.forget()
        for unit in self.seed:
            self[unit]
        self.resolve()

    def forget(self) -> None:
        """Start the table of pre-tokens anew; several units share a pre-token."""
        self.known = _Numbers()
        self.pre_count, self.pre_flat = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def shrink(self) -> None:
        """Forget all but the seed and the most used units."""
        self.forget()
        self.used[: len(self.seed)] += 1 << 40
        kept = np.argsort(-self.used, kind="stable")[: len(self.seed) + self.limit // 2]
        kept.sort()
        names = list(self)
        self.clear()
        self.update(zip(map(names.__getitem__, kept.tolist()), range(len(kept)), strict=True))
        self.flat, self.count = ragged_take(self.first, self.count, self.flat, kept)
        self.first = np.cumsum(self.count) - self.count
        self.stop, self.used = self.stop[kept], np.zeros(len(kept), np.int64)

    def __missing__(self, unit):
        number = len(self)
        self[unit] = number
        self.new.append(unit)
        return number

    def normal(self, text: str) -> str:
        text = unicodedata.normalize("NFC", text)
        return "".join(map(str.lower, text)) if "Σ" in text else text.lower()

    def pre_tokens(self, units: list[str]) -> list[Sequence[str]]:
        """The pre-tokens of each unit between blanks."""
        find = self.pattern.findall
        if self.v.words:
            # Nothing composes over a line end, and no unit holds one.
            return [
                (u,) if u.isalpha()
                else (u[:-1], u[-1]) if u[-1:] in _MARKS and u[:-1].isalpha()
                else find(u)
                for u in self.normal("\n".join(units)).split("\n")
            ] if units else []
        return [
            (" " + u,) if u.isalpha()
            else (" " + u[:-1], u[-1]) if u[-1:] in _MARKS and u[:-1].isalpha()
            else find(" " + u)
            for u in units
        ]

    def resolve(self) -> None:
        """Encode the new units."""
        new, self.new = self.new, []
        if not new:
            return
        counts, members, special = [], [], {}
        for start in range(0, len(new), SPLIT_UNITS):
            some = new[start : start + SPLIT_UNITS]
            plain = [u for u in some if u.__class__ is str]
            found = self.pre_tokens(plain)
            if len(plain) < len(some):
                rest, whole = iter(found), []
                for i, u in enumerate(some, start):
                    if u.__class__ is str:
                        whole.append(next(rest))
                    elif len(u) == 2:
                        special[i] = self.v.specials[u[1]]
                        whole.append(())
                    else:
                        whole.append(self.pattern.findall(u[0]))
                found = whole
            counts.append(np.fromiter(map(len, found), np.int64, len(found)))
            members.append(np.fromiter(
                map(self.known.__getitem__, chain.from_iterable(found)), np.int64, int(counts[-1].sum())
            ))
        counts, members = np.concatenate(counts), np.concatenate(members)
        fresh = self.known.fresh
        self.known.fresh = []
        flat, per = self.pairs.encode([p.encode("utf-8", "surrogatepass") for p in fresh])
        self.pre_flat = np.concatenate([self.pre_flat, flat])
        self.pre_count = np.concatenate([self.pre_count, per])
        ids, taken = ragged_take(
            np.cumsum(self.pre_count) - self.pre_count, self.pre_count, self.pre_flat, members
        )
        ends = offsets(taken)[offsets(counts)]
        sizes = np.diff(ends)
        first = len(self.flat) + ends[:-1]
        extra = []
        for i, one in special.items():
            first[i], sizes[i] = len(self.flat) + len(ids) + len(extra), 1
            extra.append(one)
        self.first = np.concatenate([self.first, first])
        self.count = np.concatenate([self.count, sizes])
        self.flat = np.concatenate([self.flat, ids, np.array(extra, np.int32)])
        stops = [u.__class__ is str and u[-1:] in _STOPS for u in new]
        self.stop = np.concatenate([self.stop, np.array(stops, bool)])
        if len(self) > self.limit + len(self.seed):
            self.forget()  # the next call of numbers would do it, with the texts at hand still to be packed

    def split(self, text: str) -> list:
        """The units of a text, each of which can be encoded alone."""
        if self.special is not None and "<" in text and self.special.search(text):
            out: list = []
            for part in self.special.split(text):
                out += [("", part)] if part in self.v.specials else self.split_plain(part)
            return out
        return self.split_plain(text)

    def split_plain(self, text: str) -> list:
        if self.v.words:
            if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # blanks for split(), not for \s
                whole = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text))
                return [(p,) for p in self.pattern.findall(self.normal(whole))]
            return text.split()
        pieces: list = text.split(" ")
        # A blank belongs to the unit after it only where no other white space comes before.
        if "  " in text or any(c + " " in text for c in _BLANKS):
            return [(p,) for p in self.pattern.findall(text)]
        pieces[0] = (pieces[0],)
        return pieces

    def numbers(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all texts one after the other, and how many each has."""
        if len(self) > self.limit + len(self.seed):
            self.shrink()
        parts = []
        for text in texts:
            units = self.split(text)
            parts.append(np.fromiter(map(self.__getitem__, units), np.int32, len(units)))
        self.resolve()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        found = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        del parts
        used = np.bincount(found, minlength=len(self))
        used[: len(self.used)] += self.used
        self.used = used
        return found, sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the bounds of each text."""
        units, sizes = self.numbers(texts)
        ids, taken = ragged_take(self.first, self.count, self.flat, units)
        return ids, offsets(taken)[offsets(sizes)]


class _Numbers(dict):
    """Numbers keys in the order they come; ``fresh`` are those not yet dealt with."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key) -> int:
        number = self[key] = len(self)
        self.fresh.append(key)
        return number


# A pre-token of its own after letters, and the end of a sentence.
_MARKS, _STOPS = frozenset(".,;:!?"), frozenset(".!?:;")
_BLANKS = [chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) != " "]


def encode(
    df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, ids array<int>)`` for every row."""
    shared = vocabulary.send()

    def work():
        units = Units(Vocabulary(**shared.value))

        def handle(part: pa.RecordBatch) -> list:
            return [part.column(0), list_array(*units.encode(texts_of(part.column(1))))]

        return handle

    kind = dict(df.dtypes)[id_col]
    return map_slices(
        df.select(id_col, text_col), work, f"{id_col} {kind}, ids array<int>"
    )


def decode(
    df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """Adds ``decoded``: the text of an id list, special tokens included.

    Null lists give the empty text; bytes that are no UTF-8 give U+FFFD, as in the library.
    """
    shared = vocabulary.send()

    def run(batches):
        take = shared.value["pieces"].__getitem__
        for batch in batches:
            column = batch.column(1)
            ends = column.offsets.to_numpy() - column.offsets[0].as_py()
            flat = column.flatten().to_numpy(zero_copy_only=False)
            texts = []
            for i in range(batch.num_rows):
                part = flat[ends[i] : ends[i + 1]].tolist()
                texts.append(b"".join(map(take, part)).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), column, pa.array(texts, pa.string())],
                names=[id_col, ids_col, "decoded"],
            )

    kind = dict(df.dtypes)[id_col]
    lists = F.coalesce(F.col(ids_col), F.expr("cast(array() as array<int>)")).alias(ids_col)
    return df.select(id_col, lists).mapInArrow(
        run, f"{id_col} {kind}, {ids_col} array<int>, decoded string"
    )
