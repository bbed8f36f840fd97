"""Alignment of two tokenizers over a corpus, by external spill counting.

Side A is a byte-level vocabulary file of the tokenizers library, side B a sentencepiece model.
Both split the same bytes (a blank and the text). Where a token of A and one of B end together a
group ends, and the two are linked. How often each id pair is linked in the whole corpus is
counted outside of memory:

1. Documents are taken in packets. The (pair, document) records of a packet are sorted by B id,
   then A id, cut into RADIX parts by B id, and each part is stored as a zstd run, together with a
   run of the packet's own pair totals.
2. The runs of totals of a part are merged by a k-way heap merge, FAN_IN at a time, until one is
   left. In the last merge all pairs of a B id come one after the other, so its maximum is known when
   the id changes.
3. Counts and maxima go to all tasks, and each packet streams its runs of records past them and
   adds up what each of its documents gets. Records never leave the row they were written in, so
   a pair that is in all documents meets no single task.

Two linked tokens end at the same byte, so the bytes of one end those of the other. Hence there are at
most as many pairs as the tokens of both vocabularies have bytes (twice that with B's spare byte
tokens): the counts sent have a bound that the corpus does not change.

A blank between two characters that are not white space parts the text for both vocabularies,
so a task encodes and aligns each unit between such blanks once and keeps it in a bounded table.

A null or empty text, or one whose tokens do not give back its bytes (U+2581, which B
reads as a blank), has no tokens: zeros and ''. Null ids and repeated rows are documents of their
own. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm import bpe
from mailweave.llm.common import offsets, ragged_take, slices, texts_of
from mailweave.session import scratch_path

RADIX = 16  # parts of the pairs, by B id
FAN_IN = 64  # runs merged at a time
PACKET_BYTES, PACKET_ROWS = 8 << 20, 1 << 16
UNIT_LIMIT = 200_000  # units a task remembers
MERGE_CHUNK = 4096  # pairs of a run held as Python numbers during a merge


@dataclass(frozen=True)
class Sides:
    """Both vocabularies as plain values, for a broadcast."""

    a: dict  # fields of bpe.Vocabulary
    b_model: bytes
    b_pieces: list[bytes]  # bytes of each id of B


def load_sides(a_path: str, b_path: str) -> Sides:
    import sentencepiece

    a = bpe.load(a_path)
    with open(b_path, "rb") as f:
        model = f.read()
    b = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = []
    for i in range(b.get_piece_size()):
        piece = b.id_to_piece(i)
        if b.is_byte(i):
            pieces.append(bytes([int(piece[1:-1], 16)]))
            continue
        if "▁" in piece.lstrip("▁"):
            raise ValueError("pieces that go over a blank are not supported")
        pieces.append(piece.replace("▁", " ").encode())
    if a.words:
        raise ValueError("side A must be byte-level")
    return Sides(dict(a.__dict__), model, pieces)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs as numbers whose order is by part, then B id, then A id."""
    b = b.astype(np.int64)
    return (b % RADIX) << 48 | (b // RADIX) << 24 | a.astype(np.int64)


def side_b(key: np.ndarray) -> np.ndarray:
    return key >> 24


class Aligned(dict):
    """Unit (with its leading blank) to its number, with the alignment of every unit."""

    def __init__(self, sides: Sides, limit: int = UNIT_LIMIT) -> None:
        super().__init__()
        import sentencepiece

        self.limit = limit
        vocabulary = bpe.Vocabulary(**sides.a)
        self.pairs = bpe.PairIndex(vocabulary)
        self.pre = bpe.Units(vocabulary).pattern
        self.b = sentencepiece.SentencePieceProcessor(model_proto=sides.b_model)
        self.a_len = np.array([len(p) for p in vocabulary.pieces], np.int64)
        self.b_pieces = sides.b_pieces
        self.b_len = np.array([len(p) for p in sides.b_pieces], np.int64)
        # An id as text, with what comes after it: inside a group, and at the end of its side.
        self.a_text = [[f"{i}{c}".encode() for i in range(len(self.a_len))] for c in ",|"]
        self.b_text = [[f"{i}{c}".encode() for i in range(len(self.b_len))] for c in ",;"]
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.new: list[str] = []
        none = np.zeros(0, np.int64)
        self.n_a, self.n_b, self.n_links = none, none, none
        self.first, self.flat = none, none  # pair keys of each unit
        self.good = np.zeros(0, bool)
        self.shown: list[bytes] = []  # groups of each unit, ';' after each

    def __missing__(self, unit: str) -> int:
        number = self[unit] = len(self)
        self.new.append(unit)
        return number

    def resolve(self) -> None:
        """Encode and align the new units."""
        new, self.new = self.new, []
        if not new:
            return
        raw = [u.encode() for u in new]
        pre = [[u] if u[1:].isalpha() else self.pre.findall(u) for u in new]
        a_ids, per = self.pairs.encode([p.encode() for parts in pre for p in parts])
        counts = np.fromiter(map(len, pre), np.int64, len(pre))
        n_a = np.diff(offsets(per)[offsets(counts)])
        b_lists = self.b.encode([u[1:] for u in new])
        n_b = np.fromiter(map(len, b_lists), np.int64, len(new))
        b_ids = np.fromiter((i for ids in b_lists for i in ids), np.int64, int(n_b.sum()))
        take = self.b_pieces.__getitem__
        good = np.fromiter(
            (b"".join(map(take, ids)) == r for ids, r in zip(b_lists, raw, strict=True)), bool, len(new)
        )
        if not good.all():  # no tokens; the document has none either
            a_ids, b_ids = a_ids[np.repeat(good, n_a)], b_ids[np.repeat(good, n_b)]
            n_a, n_b = n_a * good, n_b * good
        a_end, b_end = np.cumsum(self.a_len[a_ids]), np.cumsum(self.b_len[b_ids])
        # Both sides have the same bytes, so ends over all units can be compared.
        a_last, b_last = np.isin(a_end, b_end), np.isin(b_end, a_end)
        a_unit = np.repeat(np.arange(len(new)), n_a)
        links = np.bincount(a_unit[a_last], minlength=len(new))
        keys = pair_key(a_ids[a_last], b_ids[b_last])
        self.first = np.concatenate([self.first, len(self.flat) + offsets(links)[:-1]])
        self.flat = np.concatenate([self.flat, keys])
        self.n_a, self.n_b = np.concatenate([self.n_a, n_a]), np.concatenate([self.n_b, n_b])
        self.n_links = np.concatenate([self.n_links, links])
        self.good = np.concatenate([self.good, good])
        # Tokens in the order in which they are shown: by group, A before B.
        a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        order = np.argsort(np.concatenate([a_group * 2, b_group * 2 + 1]), kind="stable")
        texts = [self.a_text[e][i] for e, i in zip(a_last.tolist(), a_ids.tolist(), strict=True)]
        texts += [self.b_text[e][i] for e, i in zip(b_last.tolist(), b_ids.tolist(), strict=True)]
        texts = list(map(texts.__getitem__, order.tolist()))
        ends = offsets(n_a + n_b).tolist()
        self.shown += [b"".join(texts[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]

    def numbers(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Unit numbers of all texts one after the other, and how many each has."""
        if len(self) > self.limit:
            self.restart()
        parts = []
        for text in texts:
            units = units_of(text) if text else []
            parts.append(np.fromiter(map(self.__getitem__, units), np.int64, len(units)))
        self.resolve()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), sizes


_PART = re.compile(r"(?<=\S) (?=\S)")


def units_of(text: str) -> list[str]:
    """A blank and the text, cut before every blank that stands alone."""
    if "  " in text or text[0].isspace() or text[-1].isspace() or _NEAR_BLANK.search(text):
        return [" " + part for part in _PART.split(text)]
    return [" " + part for part in text.split(" ")]


_NEAR_BLANK = re.compile(r"[^\S ] | [^\S ]")


def pack_run(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, each with its type and length, as one zstd frame."""
    raw = b"".join(
        len(x).to_bytes(8, "little") + x.dtype.str.encode() + x.tobytes() for x in arrays
    )
    return zstandard.ZstdCompressor(level=1).compress(raw)


def open_run(blob: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, kind = int.from_bytes(raw[at : at + 8], "little"), np.dtype(raw[at + 8 : at + 11].decode())
        out.append(np.frombuffer(raw, kind, n, at + 11))
        at += 11 + n * kind.itemsize
    return out


def record_runs(keys: np.ndarray, docs: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Runs of totals and of records, one of each part, from links ``(pair, document)``."""
    pairs, pair_at = np.unique(keys, return_inverse=True)
    cells, times = np.unique(pair_at.astype(np.int64) << 16 | docs, return_counts=True)
    owner, doc = cells >> 16, (cells & 0xFFFF).astype("<u2")
    records = np.bincount(owner, minlength=len(pairs))
    total = np.bincount(owner, times, minlength=len(pairs)).astype("<i8")
    bounds = np.searchsorted(pairs, np.arange(RADIX + 1, dtype=np.int64) << 48)
    starts = offsets(records)
    totals, runs = [], []
    for i, j in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        part = slice(starts[i], starts[j])
        totals.append(pack_run(pairs[i:j].astype("<i8"), total[i:j]))
        runs.append(pack_run(
            pairs[i:j].astype("<i8"), records[i:j].astype("<u4"), doc[part], times[part].astype("<u4")
        ))
    return totals, runs


def packets(df: DataFrame, sides: Sides, id_col: str, text_col: str) -> DataFrame:
    """One row per packet: its documents' figures, and its runs by part."""
    shared = df.sparkSession.sparkContext.broadcast(dict(sides.__dict__))
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        aligned = Aligned(Sides(**shared.value))
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in _small(slices(batch, 1, PACKET_BYTES)):
                units, sizes = aligned.numbers(texts_of(part.column(1)))
                ends = offsets(sizes)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                bad = np.bincount(doc, ~aligned.good[units], minlength=len(sizes)) > 0
                keep = ~bad[doc]
                units, doc = units[keep], doc[keep]
                ends = offsets(sizes * ~bad)
                keys, taken = ragged_take(aligned.first, aligned.n_links, aligned.flat, units)
                totals, runs = record_runs(keys, np.repeat(doc, taken))
                sums = [
                    np.diff(np.concatenate([[0], np.cumsum(x[units])])[ends])
                    for x in (aligned.n_a, aligned.n_b, aligned.n_links)
                ]
                shown, order, hashes = aligned.shown, units.tolist(), []
                for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    whole = b"".join(map(shown.__getitem__, order[i:j]))
                    hashes.append(hashlib.sha256(memoryview(whole)[:-1]).hexdigest() if whole else "")
                lists = [part.column(0), *[pa.array(x, pa.int64()) for x in sums], pa.array(hashes, pa.string())]
                one = pa.array([0, part.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), *[pa.ListArray.from_arrays(one, x) for x in lists],
                     pa.array([totals], pa.list_(pa.binary())), pa.array([runs], pa.list_(pa.binary()))],
                    names=names,
                )
                number += 1

    names = ["packet", "ids", "n_a", "n_b", "n_links", "hashes", "totals", "runs"]
    return df.select(id_col, text_col).mapInArrow(
        run, f"packet long, ids array<{kind}>, n_a array<long>, n_b array<long>, "
        "n_links array<long>, hashes array<string>, totals array<binary>, runs array<binary>",
    )


def _small(parts):
    for part in parts:
        for at in range(0, part.num_rows, PACKET_ROWS):
            yield part.slice(at, PACKET_ROWS)


def merge_runs(blobs: list[bytes]) -> bytes:
    """One run of totals from several, by a heap over their heads."""

    def stream(blob: bytes):
        keys, counts = open_run(blob)
        for at in range(0, len(keys), MERGE_CHUNK):
            yield from zip(
                keys[at : at + MERGE_CHUNK].tolist(), counts[at : at + MERGE_CHUNK].tolist(), strict=True
            )

    keys, counts, last = [], [], -1
    for key, n in heapq.merge(*map(stream, blobs)):
        if key == last:
            counts[-1] += n
        else:
            keys.append(key)
            counts.append(n)
            last = key
    return pack_run(np.array(keys, "<i8"), np.array(counts, "<i8"))


def best_of_side(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair has the highest count of its B id; the pairs of an id are neighbours."""
    if not len(keys):
        return np.zeros(0, bool)
    b = side_b(keys)
    heads = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    most = np.maximum.reduceat(counts, heads)
    return counts == np.repeat(most, np.diff(np.append(heads, len(keys))))


def pair_counts(held: DataFrame, folder: str, fan_in: int = FAN_IN) -> DataFrame:
    """``(part, run)``: the corpus-wide counts of the pairs of each part, one run each."""
    spark = held.sparkSession
    runs = held.select(F.col("packet").alias("number"), F.posexplode("totals").alias("part", "run"))
    left, level = held.count(), 0

    def merged(rows: pa.Table) -> pa.Table:
        blob = merge_runs(rows.column("run").to_pylist())
        return pa.table({
            "part": pa.array(rows.column("part")[:1].to_pylist(), pa.int32()),
            "number": pa.array(rows.column("number")[:1].to_pylist(), pa.int64()),
            "run": pa.array([blob], pa.binary()),
        })

    while left > 1:
        left = -(-left // fan_in)
        grouped = runs.select(
            "part", F.pmod(F.xxhash64("number", F.lit(level)), F.lit(left)).alias("number"), "run"
        )
        merged_runs = grouped.groupBy("part", "number").applyInArrow(
            merged, "part int, number long, run binary"
        )
        path = f"{folder}/totals{level}"
        merged_runs.write.parquet(path)
        runs = spark.read.schema(merged_runs.schema).parquet(path)
        level += 1
    return runs.select("part", "run")


def align(
    df: DataFrame, sides: Sides, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN
) -> DataFrame:
    """``(id_col, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)`` for every row.

    Every group ends with exactly one link, so ``n_groups`` equals ``n_links``.
    """
    spark = df.sparkSession
    folder = scratch_path(spark, "alignment")
    found = packets(df, sides, id_col, text_col)
    found.write.parquet(f"{folder}/packets")
    held = spark.read.schema(found.schema).parquet(f"{folder}/packets")
    table = {row.part: bytes(row.run) for row in pair_counts(held, folder, fan_in).collect()}
    counted = spark.sparkContext.broadcast(table)
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        known = {}
        for part, blob in counted.value.items():
            keys, counts = open_run(blob)
            known[part] = keys, counts, best_of_side(keys, counts)
        for batch in batches:
            for row in range(batch.num_rows):
                ids, n_a, n_b, n_links, hashes = (batch.column(i)[row].values for i in range(5))
                best, total = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                for part, blob in enumerate(batch.column(5)[row].as_py()):
                    pairs, records, doc, times = open_run(blob)
                    keys, counts, is_best = known[part]
                    at = np.repeat(np.searchsorted(keys, pairs), records)
                    np.add.at(total, doc, counts[at] * times)
                    np.add.at(best, doc, is_best[at] * times.astype(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids, n_a, n_b, n_links, n_links, pa.array(best), pa.array(total), hashes], names=names
                )

    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return held.select("ids", "n_a", "n_b", "n_links", "hashes", "runs").mapInArrow(
        run, f"{id_col} {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, "
        "count_sum long, groups_sha256 string",
    )
