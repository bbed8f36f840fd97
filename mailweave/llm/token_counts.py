"""Token counts of whole texts from a two-tier table of pre-token lengths.

First tier: the lengths of the FREQUENT most frequent units (pieces between blanks). Units are
counted over all texts, a task giving out its table whenever that is full; the most frequent ones are
encoded once, and a hash table from their 128-bit hashes to their lengths goes to all tasks as a
broadcast of at most FREQUENT entries. Second tier: what a task meets beyond that is encoded once
and kept in the task's own bounded cache. No text or occurrence is shuffled, only the
pre-aggregated counts. Which units are in the first tier has no influence on the counts.

A null text counts as empty: 0 bytes, 0 tokens. Repeated rows give repeated results, a null id stays
null, other columns are not read, and an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.llm.bpe import Units, Vocabulary
from mailweave.llm.common import map_slices, slices, text_column, texts_of

FREQUENT = 32_768  # entries of the broadcast table
KEPT = 300_000  # entries a task counts at a time
CACHED = 200_000  # entries of a worker's cache


def frequent_units(df: DataFrame, vocabulary: Vocabulary, text_col: str = "text") -> DataFrame:
    """``(unit, n)`` of the most frequent units over all texts, exact counts."""
    shared = vocabulary.send()

    def counted(held: Counter) -> pa.RecordBatch:
        units = [(u, n) for u, n in held.items() if isinstance(u, str)]
        return pa.RecordBatch.from_arrays(
            [pa.array([u for u, _ in units], pa.string()), pa.array([n for _, n in units], pa.int64())],
            names=["unit", "n"],
        )

    def run(batches):
        split = Units(Vocabulary(**shared.value)).split
        held: Counter = Counter()
        for batch in batches:
            for part in slices(batch, 0):
                for text in texts_of(part.column(0)):
                    held.update(split(text))
                    if len(held) > KEPT:
                        yield counted(held)
                        held = Counter()
        if held:
            yield counted(held)

    parts = df.select(text_col).mapInArrow(run, "unit string, n long")
    summed = parts.groupBy("unit").agg(F.sum("n").alias("n"))
    return summed.orderBy(F.desc("n"), "unit").limit(FREQUENT)


def unit_lengths(units: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(key, length)``: hash and number of tokens of each ``unit``."""
    shared = vocabulary.send()

    def work():
        lengths = Lengths(Vocabulary(**shared.value), {})

        def handle(part: pa.RecordBatch) -> list:
            found = part.column(0).to_pylist()
            return [pa.array(map(key_of, found), pa.binary()), pa.array(lengths.encoded(found))]

        return handle

    return map_slices(units.select("unit"), work, "key binary, length long", column=0)


def key_of(unit: str) -> bytes:
    return xxhash.xxh3_128_digest(unit.encode("utf-8", "surrogatepass"))


class Lengths(dict):
    """Unit to its number in the worker's cache, with the number of tokens of each."""

    def __init__(self, vocabulary: Vocabulary, tier: dict[bytes, int]) -> None:
        super().__init__()
        self.units, self.tier = Units(vocabulary), tier
        self.new: list = []
        self.count = np.zeros(0, np.int64)

    def __missing__(self, unit) -> int:
        number = self[unit] = len(self)
        self.new.append(unit)
        return number

    def encoded(self, units: list) -> np.ndarray:
        """Tokens of units that no table knows."""
        table = self.units
        plain = iter(table.pre_tokens([u for u in units if u.__class__ is str]))
        found, special = [], []
        for u in units:
            if u.__class__ is str:
                found.append(next(plain))
            else:  # a piece as it is, or a special token
                found.append(table.pattern.findall(u[0]) if len(u) == 1 else ())
            special.append(u.__class__ is tuple and len(u) == 2)
        pieces: dict[str, int] = {}
        at = [pieces.setdefault(p, len(pieces)) for p in chain.from_iterable(found)]
        _, per = table.pairs.encode([p.encode("utf-8", "surrogatepass") for p in pieces])
        owner = np.repeat(np.arange(len(units)), np.fromiter(map(len, found), np.int64, len(found)))
        sums = np.bincount(owner, per[at], minlength=len(units)).astype(np.int64)
        return sums + np.array(special, np.int64)

    def of(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text."""
        if len(self) > CACHED:
            self.clear()
            self.count = np.zeros(0, np.int64)
        parts = []
        for text in texts:
            units = self.units.split(text)
            parts.append(np.fromiter(map(self.__getitem__, units), np.int64, len(units)))
        new, self.new = self.new, []
        known = [self.tier.get(key_of(u), -1) if u.__class__ is str else -1 for u in new]
        counts = np.array(known, np.int64)
        missing = np.flatnonzero(counts < 0)
        if len(missing):
            counts[missing] = self.encoded([new[i] for i in missing.tolist()])
        self.count = np.concatenate([self.count, counts])
        return np.array([self.count[p].sum() for p in parts], np.int64)


def token_counts(
    df: DataFrame,
    vocabulary: Vocabulary,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` for every row."""
    shared = vocabulary.send()
    frequent = unit_lengths(frequent_units(df, vocabulary, text_col), vocabulary)
    # At most FREQUENT rows of 24 bytes.
    tier = SparkSession.active().sparkContext.broadcast({bytes(r.key): r.length for r in frequent.collect()})

    def work():
        lengths = Lengths(Vocabulary(**shared.value), tier.value)

        def handle(part: pa.RecordBatch) -> list:
            return [part.column(0), part.column(2), pa.array(lengths.of(texts_of(part.column(1))))]

        return handle

    kind = dict(df.dtypes)[id_col]
    n_bytes = F.octet_length(text_column(text_col)).cast("long").alias("n_bytes")
    counted = map_slices(
        df.select(id_col, text_col, n_bytes), work,
        f"{id_col} {kind}, n_bytes long, n_tokens long",
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
