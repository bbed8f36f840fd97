"""Order-preserving packing of documents into sequences of a fixed number of tokens.

The documents of a block are laid end to end, in the order they are read, and cut into
windows of at most ``limit`` tokens. Where to cut is a shortest path over the allowed
cuts: document ends cost nothing, sentence ends SENTENCE_CUT, a place inside a long
sentence WORD_CUT; a window costs its padding and WINDOW. Padding is what is missing to
``limit``, or nothing where the window's length is a power of two. The best predecessor
within reach is the head of a monotone queue, so a block takes time linear in its cuts;
the few power-of-two predecessors are looked up by position.

Every block is worked on alone, so no task waits for another and nothing is shuffled.

A null text counts as empty and gives one piece, the end id. Repeated rows are packed
each on its own.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from mailweave.llm.bpe import Units, Vocabulary
from mailweave.llm.common import map_slices, offsets, ragged_take, release, slices, texts_in_turn

SENTENCE_CUT, WORD_CUT, WINDOW = 2.0, 12.0, 4.0
GRID = 32  # tokens between the allowed cuts inside a sentence
ENCODED_BYTES = 16 << 20  # texts encoded at a time: new units of several blocks cost one pass of merges


def best_cuts(at: np.ndarray, price: np.ndarray, limit: int) -> list[int]:
    """Positions of the cheapest cuts; ``at`` ascends from 0 in steps of at most ``limit``."""
    number = np.full(int(at[-1]) + 1, -1, np.int32)
    number[at] = np.arange(len(at), dtype=np.int32)
    later, earlier = [], []
    size = 1
    while size < limit:
        reach = int(np.searchsorted(at, size))
        found = number[at[reach:] - size]
        hit = np.flatnonzero(found >= 0)
        later.append(hit + reach)
        earlier.append(found[hit])
        size *= 2
    # Predecessors at a power of two, smaller ones first, in one list; ``until`` bounds those of a place.
    both = np.concatenate(later) if later else np.zeros(0, np.int64)
    powers = np.concatenate(earlier)[np.argsort(both, kind="stable")].tolist() if later else []
    until = np.cumsum(np.bincount(both, minlength=len(at))).tolist()
    seen = 0
    places, prices = at.tolist(), (price + WINDOW).tolist()
    cost, back = [0.0] * len(places), [0] * len(places)
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # cost + place, place, number
    for j in range(1, len(places)):
        here = places[j]
        while queue[0][1] < here - limit:
            queue.popleft()
        least, _, source = queue[0]
        least += limit - here
        if seen < until[j]:
            for i in powers[seen : until[j]]:
                if cost[i] < least:
                    least, source = cost[i], i
            seen = until[j]
        least += prices[j]
        cost[j], back[j] = least, source
        level = least + here
        while queue and queue[-1][0] >= level:
            queue.pop()
        queue.append((level, here, j))
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(places[j])
        j = back[j]
    return cuts[::-1]


def allowed_cuts(doc_ends, sentence_ends, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All places where a window may end, with their prices. The places near the end of
    the block are all allowed, so that the last window needs little padding."""
    total = int(doc_ends[-1])
    # 1: inside a sentence, 2: a sentence's end, 3: a document's
    kind = np.zeros(total + 1, np.uint8)
    kind[sentence_ends] = 2
    kind[doc_ends] = 3
    kind[0] = max(kind[0], 1)
    natural = np.flatnonzero(kind)
    inner = (np.diff(natural) - 1) // GRID
    steps = np.arange(int(inner.sum())) - np.repeat(np.cumsum(inner) - inner, inner) + 1
    kind[np.repeat(natural[:-1], inner) + steps * GRID] = 1
    last = kind[max(0, total - limit) : total]
    last[last == 0] = 1
    at = np.flatnonzero(kind)
    price = np.array([0.0, WORD_CUT, SENTENCE_CUT, 0.0])[kind[at]]
    return at, price


def pack(
    df: DataFrame,
    vocabulary: Vocabulary,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    end_id: int = 1,
) -> DataFrame:
    """One row per piece: ``(id_col, start, length, token_bytes, doc_tokens, sequence_id,
    offset)``; ``token_bytes`` holds the ids as little-endian unsigned 32-bit numbers."""
    shared = vocabulary.send()

    def work():
        release()  # what earlier stages left in this worker
        units = Units(Vocabulary(**shared.value))
        state = {"next": TaskContext.get().partitionId() << 33}

        def handle(part: pa.RecordBatch) -> list:
            numbers, sizes = units.numbers(texts_in_turn(part.column(1)))
            ends, row, blocks = offsets(sizes), 0, []
            for block in slices(part):
                rows = slice(row, row + block.num_rows)
                blocks.append(pieces(block.column(0), numbers[ends[rows.start] : ends[rows.stop]], sizes[rows]))
                row = rows.stop
            return [pa.chunked_array(columns) for columns in zip(*blocks, strict=True)]

        def pieces(ids_of: pa.Array, numbers: np.ndarray, sizes: np.ndarray) -> list:
            # A unit of one id, numbered after all others, ends each document.
            first = np.append(units.first, len(units.flat))
            count = np.append(units.count, 1)
            flat = np.append(units.flat, np.int32(end_id))
            stop = np.append(units.stop, False)
            unit_ends = np.cumsum(sizes)
            numbers = np.insert(numbers, unit_ends, len(count) - 1)
            ids, taken = ragged_take(first, count, flat, numbers)
            run = np.cumsum(taken)
            doc_ends = run[unit_ends + np.arange(len(sizes))]
            at, price = allowed_cuts(doc_ends, run[stop[numbers]], limit)
            cuts = np.array(best_cuts(at, price, limit), np.int64)
            bounds = np.union1d(cuts, doc_ends)
            starts = np.concatenate([[0], bounds[:-1]])
            doc = np.searchsorted(doc_ends, starts, "right")
            window = np.searchsorted(cuts, starts, "right")
            doc_starts, window_starts = offsets(np.diff(doc_ends, prepend=0)), np.append(0, cuts)
            raw = ids.astype("<u4").tobytes()
            blobs = pa.Array.from_buffers(
                pa.binary(), len(bounds),
                [None, pa.py_buffer((offsets(bounds - starts) * 4).astype(np.int32).tobytes()),
                 pa.py_buffer(raw)],
            )
            sequence = state["next"] + window
            state["next"] += len(cuts)
            return [
                ids_of.take(pa.array(doc)),
                pa.array(starts - doc_starts[doc]),
                pa.array(bounds - starts),
                blobs,
                pa.array(np.diff(doc_starts)[doc]),
                pa.array(sequence),
                pa.array(starts - window_starts[window]),
            ]

        return handle

    kind = dict(df.dtypes)[id_col]
    return map_slices(
        df.select(id_col, text_col), work,
        f"{id_col} {kind}, start long, length long, token_bytes binary, doc_tokens long, "
        "sequence_id long, offset long", limit=ENCODED_BYTES,
    )
