"""Helpers shared by the corpus operators: Arrow batches, ragged arrays, hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of the table of :func:`marks`, and of a part of it that one group makes.
MARKS, MARKS_PART = 1 << 25, 1 << 16
# Texts worked on at a time inside a task; a longer single text is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(
    batch: pa.RecordBatch, column: int = 1, limit: int = SLICE_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose values in ``column`` fit ``limit`` bytes."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes, dtype=np.int64)
    start = 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def texts_of(column: pa.Array) -> list[str]:
    """Python strings, a null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def texts_in_turn(column: pa.Array) -> Iterator[str]:
    """The same, made few at a time."""
    for start in range(0, len(column), 128):
        yield from texts_of(column.slice(start, 128))


def release() -> None:
    """Give unused memory back to the system: a worker process lives on, and what one task or an
    earlier stage held should not stay with it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_slices(
    df: DataFrame, work: Callable[[], Callable[[pa.RecordBatch], list]], schema: str,
    column: int = 1, limit: int = SLICE_BYTES,
) -> DataFrame:
    """Apply ``work()`` (made once per task) to slices; it returns the output's arrays, or chunked
    arrays, whose chunks go out one by one.

    An empty slice never reaches the function, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        handle = work()
        for batch in batches:
            for part in slices(batch, column, limit):
                arrays = handle(part)
                yield from pa.Table.from_arrays(arrays, names=names).to_batches()
                del arrays
        del handle
        release()

    names = [field.split()[0] for field in schema.split(", ")]
    return df.mapInArrow(run, schema)


def ragged_take(first, count, flat, index):
    """Concatenate the runs ``flat[first[i] : first[i] + count[i]]`` for i in ``index``."""
    taken = count[index]
    before = np.cumsum(taken) - taken
    where = np.repeat(first[index] - before, taken)
    where += np.arange(len(where))
    return flat[where], taken


def offsets(counts) -> np.ndarray:
    """0 and the running sum."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def list_array(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def text_column(name: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def hex_digest(c: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(c.cast("binary"), 256)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def mark(c: Column) -> Column:
    """The place of a value in the table of :func:`marks`."""
    return F.pmod(F.xxhash64(c), F.lit(MARKS).cast("long"))


def marks(keys: DataFrame, name: str) -> Broadcast:
    """Bits by hash of the values in the column ``name``, for :func:`marked`.

    The table has the same size for any number of keys. It tells for sure which rows have no value
    among the keys, so these need no join with them; few others pass while keys are far fewer than bits.
    """

    def pack(group: pa.Table) -> pa.Table:
        bits = np.zeros(MARKS_PART, np.uint8)
        bits[group.column("at").to_numpy() % MARKS_PART] = 1
        return pa.table({
            "part": group.column("part").slice(0, 1),
            "bits": pa.array([np.packbits(bits).tobytes()], pa.binary()),
        })

    at = keys.select(mark(F.col(name)).alias("at"))
    parts = at.withColumn("part", F.floor(F.col("at") / MARKS_PART)).groupBy("part").applyInArrow(
        pack, "part long, bits binary"
    )
    table = np.zeros((MARKS // MARKS_PART, MARKS_PART // 8), np.uint8)
    for r in parts.collect():
        table[r.part] = np.frombuffer(r.bits, np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table.ravel())


def marked(table: np.ndarray, at: pa.Array) -> pa.Array:
    """Whether the places are marked."""
    where = at.to_numpy(zero_copy_only=False)
    return pa.array((table[where >> 3] >> (7 - (where & 7)).astype(np.uint8)) & 1 == 1)


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` is not in ``gone``; only rows that may be in it are exchanged."""
    shared = marks(gone, key)

    @F.arrow_udf("boolean")
    def maybe(at: pa.Array) -> pa.Array:
        return marked(shared.value, at)

    hit = maybe(mark(F.col(key)))
    return rows.where(~hit).unionByName(rows.where(hit).join(gone, key, "left_anti"))
