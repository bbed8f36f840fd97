"""Embedding plug-in: text column in, vector column out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.functions.batches import slices


class Embedder(Protocol):
    """Anything that turns a batch of texts into one vector each."""

    name: str
    batch_size: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class _Places(dict):
    """Token to ``2 * place + sign bit``, filled on first use."""

    def __init__(self, dim: int, seed: int) -> None:
        super().__init__()
        self.dim, self.seed = dim, seed

    def __missing__(self, token: str) -> int:
        digest = hashlib.md5(f"{self.seed}:{token}".encode("utf-8", "replace")).digest()
        number = int.from_bytes(digest[8:], "little")
        self[token] = code = 2 * (number % self.dim) + ((number >> 32) & 1)
        return code


class HashEmbedder:
    """Signed token hashing; needs no model and gives the same vector anywhere.

    A token's MD5 picks its place and sign, so the vectors can be checked in any
    engine that has MD5.
    """

    _MAX_KNOWN = 100_000

    def __init__(self, dim: int = 256, seed: int = 0, batch_size: int = 64) -> None:
        self.name = f"hash/{dim}-{seed}"
        self.dim = dim
        self.seed = seed
        self.batch_size = batch_size

    def embed(self, texts: list[str]) -> np.ndarray:
        places = self.__dict__.get("_places")
        if places is None or len(places) > self._MAX_KNOWN:
            places = self._places = _Places(self.dim, self.seed)
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for row, text in zip(out, texts):
            tokens = text.lower().split()
            codes = np.fromiter(map(places.__getitem__, tokens), np.int64, len(tokens))
            counts = np.bincount(codes, minlength=2 * self.dim)
            row += counts[0::2] - counts[1::2]
        return out


def checked_vectors(embedder: Embedder, texts: list[str]) -> list[np.ndarray]:
    """Vectors of one provider call; a short or empty answer is an error."""
    vectors = list(embedder.embed(texts))
    if len(vectors) != len(texts):
        raise RuntimeError(
            f"{embedder.name} returned {len(vectors)} vectors for {len(texts)} texts"
        )
    if any(len(v) == 0 for v in vectors):
        raise RuntimeError(f"{embedder.name} returned an empty vector")
    return [np.asarray(v, dtype=np.float32) for v in vectors]


def embed_texts(
    df: DataFrame, embedder: Embedder, text: str = "text", output: str = "embedding"
) -> DataFrame:
    """Add an ``ARRAY<FLOAT>`` column; texts travel in Arrow batches."""

    @F.arrow_udf("array<float>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in slices(batches, max(1, embedder.batch_size)):
            found = checked_vectors(embedder, part.to_pylist())
            ends = np.cumsum([0, *map(len, found)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))

    return df.withColumn(output, vectors(F.col(text)))
