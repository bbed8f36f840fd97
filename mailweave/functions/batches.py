"""Python over Arrow batches, some rows at a time.

A batch has up to 10,000 rows, whatever their length. Python objects are made for a slice of it only, so a
worker holds the Arrow batch it was sent and little more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SLICE_ROWS = 128


def slices(batches: Iterable, rows: int = SLICE_ROWS) -> Iterator:
    """Arrays or record batches in pieces of at most ``rows`` rows."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def by_row(function: Callable[[Any], Any], kind: str, arrow: pa.DataType) -> Callable[[Column], Column]:
    """Column function that applies ``function`` to each value; null stays null."""

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in slices(batches):
            yield pa.array([None if v is None else function(v) for v in part.to_pylist()], arrow)

    return run
