"""Document fingerprints by locally consistent parsing.

Runs of one symbol become one symbol, named by it and its length's power of two; so a text that repeats
a period shrinks as soon as the period is a phrase. Then it is cut into phrases by deterministic coin
tossing: every symbol gets a label from the lowest bit in which the two differ; a few rounds
shrink the labels, and phrases start where a label is a local maximum. Each phrase is named by a hash of
its symbols, and the names are parsed in the same way, level by level. A cut depends
on a few symbols around it only, so equal passages are cut and named alike wherever they
stand. The fingerprint holds the KEPT least hashes of the names from level SIGNATURE_LEVEL
on (of lower levels for texts too short for it); the likeness of two fingerprints is the share of common
hashes among the KEPT least of both (1 for two empty texts).

A null text counts as empty; its fingerprint is the empty string. Rows are ordered by id, equal ids by
text, null ids come last as one block; repeated rows are rows of their own. Ids must be whole
numbers. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.llm.common import SLICE_BYTES, mix64, offsets, slices, texts_of
from mailweave.operators.skew import number_rows
from mailweave.session import shared_dir

KEPT = 64
SIGNATURE_LEVEL, LEVELS = 2, 4
BLOCK_IDS = 4_096  # ids of a block; a block's documents are parsed by one task


def _coin_table(size: int) -> np.ndarray:
    """Label of a symbol b after a symbol a, both below ``size``: twice the lowest bit in which
    they differ plus that bit of b, from 1 on; 0 for equal symbols."""
    a, b = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
    differ = a ^ b
    low = np.zeros_like(differ)
    for bit in range(size.bit_length() - 1, -1, -1):
        low[(differ >> bit) & 1 == 1] = bit
    return np.where(differ == 0, 0, 1 + 2 * low + ((b >> low) & 1)).astype(np.uint8)


_BYTE_COINS, _SMALL_COINS = _coin_table(256), _coin_table(32)


def cuts(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where phrases start; ``starts`` are the first symbols of texts and always do."""
    n = len(symbols)
    # First round on whole symbols: neighbours differ, so each pair has a lowest different bit.
    wide = mix64(symbols.astype(np.uint64))
    differ = wide[1:] ^ wide[:-1]
    low = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1))
    side = (wide[1:] >> low.astype(np.uint64)) & np.uint64(1)
    label = np.zeros(n, np.uint8)
    label[1:] = np.where(differ == 0, 0, 1 + 2 * low.astype(np.int64) + side.astype(np.int64))
    label[starts] = 0  # nothing may depend on the text before
    for coins in (_BYTE_COINS, _SMALL_COINS):
        less = np.zeros(n, np.uint8)
        less[1:] = coins[label[:-1], label[1:]]
        less[starts] = 0
        label = less
    top = np.zeros(n, bool)
    top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:])
    top[starts[1:] - 1] = False  # nor on the text after
    top[starts] = True
    return np.flatnonzero(top)


def joined_runs(symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol as one symbol each, named by it and the power of two below the run's
    length; with the bounds of the texts among them."""
    new = np.ones(len(symbols), bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new[bounds[:-1][np.diff(bounds) > 0]] = True
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(symbols)))
    long = size > 1
    out = symbols[at].astype(np.uint64)
    octave = np.floor(np.log2(size[long])).astype(np.uint64) + np.uint64(1)
    out[long] = mix64(mix64(out[long]) + octave)
    return out, np.searchsorted(at, bounds)


def phrase_names(symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the symbols of each phrase, in order."""
    place = np.arange(len(symbols)) - np.repeat(at, np.diff(np.append(at, len(symbols))))
    salt = (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(np.add.reduceat(mix64(symbols.astype(np.uint64) + salt), at))


def names_by_level(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each level the names of all texts one after the other, and the bounds of each."""
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    bounds = offsets(sizes)
    full = np.flatnonzero(sizes)
    for _ in range(LEVELS):
        if not len(full):
            return
        symbols, bounds = joined_runs(symbols, bounds)
        starts = bounds[full]
        at = cuts(symbols, starts)
        symbols = phrase_names(symbols, at)
        bounds = np.searchsorted(at, bounds)
        yield symbols, bounds


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The kept hashes of each text, ascending."""
    parts = [[] for _ in texts]
    for level, (names, bounds) in enumerate(names_by_level(texts), 1):
        hashed = (mix64(names + np.uint64(level)) >> np.uint64(32)).astype(np.uint32)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            # Below the signature level only texts that end there count.
            if b > a and (level >= SIGNATURE_LEVEL or b - a == 1):
                parts[i].append(hashed[a:b])
    out = []
    for p in parts:
        if not p:
            out.append(np.zeros(0, np.uint32))
            continue
        all_names = np.concatenate(p)
        if len(all_names) > 4 * KEPT:
            # The least of all: a partition first, widened while it holds too many repeats.
            size = 2 * KEPT
            least = np.unique(np.partition(all_names, size)[:size])
            while len(least) < KEPT and size * 2 < len(all_names):
                size *= 2
                least = np.unique(np.partition(all_names, size)[:size])
            out.append(least[:KEPT] if len(least) >= KEPT else np.unique(all_names)[:KEPT])
        else:
            out.append(np.unique(all_names)[:KEPT])
    return out


def shown(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common hashes among the least of both sketches."""
    if not len(a) and not len(b):
        return 1.0
    union = np.union1d(a, b)[:KEPT]
    return float(np.isin(union, a, assume_unique=True)[np.isin(union, b, assume_unique=True)].sum() / len(union))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, fingerprint)`` for every row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                ids, texts = part.column(0), texts_of(part.column(1))
                prints = [shown(s) for s in sketches(texts)]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(prints, pa.string())],
                    names=[id_col, "fingerprint"],
                )

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, fingerprint string")


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the start of another."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def with_followers(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(block, last, id, text)``: the documents of each block of ids, and with ``last`` the
    document that follows the block's lowest one, in descending order of ids.

    The order is total: equal ids are ordered by text. After the last document comes the first.
    """
    shared_dir(df.sparkSession)
    rows = df.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    block = F.floor(F.coalesce(F.col("id"), F.lit(-(2**62))) / BLOCK_IDS).alias("block")
    rows = rows.select(block, "id", "text")
    # The first document of each block, one per block and task before the shuffle.
    heads = rows.groupBy("block").agg(F.max(F.struct("id", "text")).alias("head"))
    heads = heads.select("block", "head.id", "head.text").checkpoint()
    placed = number_rows(heads.select("block"), [F.desc("block")], "place")
    total = placed.count()
    after = placed.select(
        F.col("block").alias("of"), (F.col("place") % max(total, 1) + 1).alias("next_place")
    ).join(placed, F.col("next_place") == F.col("place")).select("of", "block")
    extra = after.join(heads, "block").select(
        F.col("of").alias("block"), F.lit(True).alias("last"), "id", "text"
    )
    own = rows.select("block", F.lit(False).alias("last"), "id", "text")
    return own.union(extra)


def compare_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and its edited form, and their likeness.

    Columns: ``(id_col, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next)``.
    """

    def run(batches):
        held: list[tuple] = []  # rows of a block that wait for the row after them
        size = 0

        def flush(rows):
            """All rows but the last are given out; the last one may be the next one's."""
            texts = [r[3] for r in rows]
            changed = [edited(a, b) for a, b in zip(texts[:-1], texts[1:], strict=True)]
            plain, other = sketches(texts), sketches(changed)
            n = len(changed)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[2] for r in rows[:-1]], pa.int64()),
                    pa.array(list(map(len, texts[:-1])), pa.int64()),
                    pa.array(changed, pa.string()),
                    pa.array([shown(plain[i]) for i in range(n)], pa.string()),
                    pa.array([shown(other[i]) for i in range(n)], pa.string()),
                    pa.array([likeness(plain[i], other[i]) for i in range(n)], pa.float64()),
                    pa.array([likeness(plain[i], plain[i + 1]) for i in range(n)], pa.float64()),
                ],
                names=names,
            )

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for row in zip(*columns, strict=True):
                if held and held[-1][0] != row[0]:
                    if len(held) > 1:
                        yield flush(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
                if size > SLICE_BYTES // 3 and len(held) > 1:
                    yield flush(held)
                    held, size = held[-1:], len(held[-1][3])
        if len(held) > 1:
            yield flush(held)

    names = [
        id_col, "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    ]
    ordered = with_followers(df, id_col, text_col).repartition("block").sortWithinPartitions(
        "block", "last", F.desc_nulls_last("id"), F.desc("text")
    )
    return ordered.mapInArrow(
        run,
        f"{id_col} long, n_chars long, edited string, fingerprint string, "
        "edited_fingerprint string, near_edited double, near_next double",
    )
