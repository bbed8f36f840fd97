"""Exact cosine top-k over a chunk table.

Scores are dot products of unit vectors in double precision. Ranking uses the
score rounded to 12 places, then ``(source_id, chunk_index)``, so copies of a
chunk rank the same way whatever task scored them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from mailweave.functions import fixed, vectors
from mailweave.operators.skew import number_rows
from mailweave.session import materialize, scratch_path

KEY = ("source_id", "chunk_index")
SCORE_PLACES = 12
# Bytes of query vectors sent to every task at a time: 2,048 queries of 3,072
# dimensions in double precision.
QUERY_BYTES = 50_331_648
# Scores of a block of chunks by a tile of queries, and queries of a tile: small enough for a core's caches, and
# enough chunks at a time that the kept rows are seldom merged.
_SCORE_CELLS = 2_097_152
_TILE_QUERIES = 512
# Rows scored in double precision at a time.
_EXACT_ROWS = 8_192
# Half the distance from 1 to the next number in single precision, and products (lengths of a chunk and
# a query) above which that precision is not used. Terms below _TINY may be lost in it.
_ROUGH_UNIT = 2.0**-24
_ROUGH_SIZE = 1e30
_TINY = 1e-30
# Tasks per core that read the chunks: each gives out up to k rows per query.
_WAVES = 2
_OUT_ROWS = 10_000


def top_k(
    chunks: DataFrame, query: Sequence[float], k: int = fixed.DEFAULT_TOP_K
) -> DataFrame:
    """Chunks most like one query vector, best first.

    Stays in the JVM: the query is a literal and the sort-and-limit keeps k rows
    per task.
    """
    q = np.asarray(query, dtype=np.float64)
    size = float(np.linalg.norm(q))
    found = F.size("unit_embedding")
    wrong = F.raise_error(
        F.concat(F.lit(f"query has {len(q)} dimensions, a chunk has "), found.cast("string"))
    )
    dot = vectors.dot(F.col("unit_embedding"), q / (size or 1.0))
    # Chunks without a vector have no score.
    score = F.when((found > 0) & (found != len(q)), wrong.cast("double")).otherwise(dot)
    scored = chunks.withColumn("score", F.round(score, SCORE_PLACES))
    if size == 0 or k <= 0:
        return scored.limit(0)
    return scored.orderBy(F.desc("score"), *KEY).limit(k)


class _Best:
    """Running k best rows per query inside one task.

    Scores are first taken in single precision. Only rows that, with the largest error of such a
    score, may still be among the k best are scored in double precision, and these decide. A block of
    chunks is scored by a tile of queries after the other.
    """

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries = np.ascontiguousarray(queries, dtype=np.float64)
        self.rough_t = self.queries.astype(np.float32).T
        self.reach = float(np.linalg.norm(self.queries, axis=1).max(initial=0.0))
        self.k = k
        self.floor = np.full(len(self.queries), -np.inf)
        # Kept rows in order of query and score: query, score and the KEY columns.
        self.query = np.empty(0, np.int64)
        self.score = np.empty(0)
        self.keys = [np.empty(0, object) for _ in KEY]

    def candidates(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) of all rows that may still be among the k best."""
        size = float(np.linalg.norm(matrix, axis=1).max(initial=0.0)) * self.reach
        if not size < _ROUGH_SIZE:  # also where a value is no number
            given_t, rows, slack = self.queries.T, matrix, 0.0
        else:
            given_t, rows = self.rough_t, matrix.astype(np.float32)
            slack = (matrix.shape[1] + 8) * _ROUGH_UNIT * size + _TINY
        found = []
        for start in range(0, len(self.queries), _TILE_QUERIES):
            tile = slice(start, start + _TILE_QUERIES)
            query, row = self._likely(given_t[:, tile], rows, self.floor[tile], slack)
            found.append((query + start, row))
        query, row = (np.concatenate(side) for side in zip(*found, strict=True))
        exact = np.empty(len(row))
        for start in range(0, len(row), _EXACT_ROWS):
            part = slice(start, start + _EXACT_ROWS)
            exact[part] = np.einsum("ij,ij->i", matrix[row[part]], self.queries[query[part]])
        exact = np.round(exact, SCORE_PLACES)
        good = exact >= self.floor[query]
        return query[good], row[good], exact[good]

    def _likely(
        self, given_t: np.ndarray, rows: np.ndarray, floor: np.ndarray, slack: float
    ) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of a tile whose scores, give or take ``slack``, may be among the k best."""
        n = len(rows)
        scores = given_t.T @ rows.T
        least = floor - slack - 10.0**-SCORE_PLACES
        new = np.isneginf(floor)
        if n > self.k and new.any():
            open_scores = scores if new.all() else scores[new]
            kth = np.partition(open_scores, n - self.k, axis=1)[:, n - self.k]
            least[new] = kth - 2 * slack - 10.0**-SCORE_PLACES
        # Rounded down, for a limit above the true one would lose rows.
        limit = np.nextafter(least.astype(scores.dtype), scores.dtype.type(-np.inf))
        return np.divmod(np.flatnonzero(scores >= limit[:, None]), n)

    def merge(self, query: np.ndarray, score: np.ndarray, keys: list[np.ndarray]) -> None:
        if not len(query):
            return
        query, score = np.append(self.query, query), np.append(self.score, score)
        keys = [np.append(old, new) for old, new in zip(self.keys, keys, strict=True)]
        order = np.lexsort((-score, query))
        place = self._places(query[order])
        # The keys decide where the k-th score comes again behind it.
        again = np.flatnonzero(place == self.k)
        again = again[score[order][again] == score[order][again - 1]]
        if len(again):
            tied = np.zeros(len(self.queries), bool)
            tied[query[order][again]] = True
            at = np.flatnonzero(tied[query[order]])
            some = order[at]
            columns = dict(zip(KEY, (k[some] for k in keys), strict=True))
            frame = pd.DataFrame({"_query": query[some], "_score": -score[some], **columns})
            order[at] = some[frame.sort_values(["_query", "_score", *KEY]).index.to_numpy()]
        order = order[place < self.k]
        self.query, self.score = query[order], score[order]
        self.keys = [k[order] for k in keys]
        full = np.flatnonzero(place[place < self.k] == self.k - 1)
        self.floor[self.query[full]] = self.score[full]

    @staticmethod
    def _places(query: np.ndarray) -> np.ndarray:
        """Place from 0 of each row among the rows of its query, which lie together."""
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        return np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))

    def step(self) -> int:
        """Chunks of a block."""
        return max(1, _SCORE_CELLS // max(1, min(len(self.queries), _TILE_QUERIES)))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    """List column as a dense matrix, without a Python object per value."""
    sizes = set(pc.unique(pc.list_value_length(column)).to_pylist())
    if sizes != {dimension}:
        raise ValueError(f"queries have {dimension} dimensions, chunks have {sorted(sizes)}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dimension).astype(np.float64)


def _scan_arrow(best: _Best, batches: Iterator[pa.RecordBatch]) -> None:
    step = best.step()
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            vecs = part.column(part.schema.get_field_index("unit_embedding"))
            query, row, score = best.candidates(_matrix(vecs, best.queries.shape[1]))
            if not len(row):
                continue
            keys = [np.array(part.column(part.schema.get_field_index(c)).to_pylist(), object) for c in KEY]
            best.merge(query, score, [k[row] for k in keys])


def _output(best: _Best, ids: np.ndarray, schema: pa.Schema) -> pa.Table:
    columns = {"query_id": ids[best.query], "score": best.score, **dict(zip(KEY, best.keys, strict=True))}
    return pa.table({n: pa.array(columns[n], schema.field(n).type) for n in schema.names}, schema)


def _hit_schema(chunks: DataFrame, queries: DataFrame) -> T.StructType:
    fields = [T.StructField("query_id", queries.schema["query_id"].dataType)]
    fields.append(T.StructField("score", T.DoubleType()))
    return T.StructType(fields + [chunks.schema[c] for c in KEY])


def retrieve(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = fixed.DEFAULT_TOP_K,
    *,
    columns: Sequence[str] = ("source_name", "source_path", "text"),
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """The k best chunks of every query: ``(query_id, rank, score, chunk columns)``.

    Queries go to the tasks in blocks of at most ``query_bytes``; for each block
    the keys and vectors of the chunks are read once, where they lie, and a task
    gives out at most k keys per query. The hits are written as keys and ranks;
    ``columns`` are looked up for the hits alone. Zero query vectors find
    nothing; repeated or null query ids and vectors of unequal length are errors.
    """
    wanted = chunks.where(F.size("unit_embedding") > 0)
    schema = _hit_schema(chunks, queries)
    spark = chunks.sparkSession
    units = materialize(
        queries.select("query_id", vectors.unit(F.col("vector")).alias("unit")).where(
            vectors.norm(F.col("unit")) > 0
        ),
        "queries",
    )
    facts = units.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("query_id").alias("ids"),
        F.min(F.size("unit")).alias("least"),
        F.max(F.size("unit")).alias("most"),
    ).first()
    if facts.n != facts.ids:
        raise ValueError("query ids must be distinct and not null")
    if facts.least != facts.most:
        raise ValueError(f"query vectors have {facts.least} to {facts.most} dimensions")
    if k <= 0 or facts.n == 0:
        empty = _ranked(spark.createDataFrame([], schema), 1)
        return _with_columns(empty, wanted, columns, 1)
    path = scratch_path(spark, "hits")
    # A fixed number of tasks, so that what they give out grows with the queries only.
    vecs = wanted.select(*KEY, "unit_embedding").coalesce(_WAVES * spark.sparkContext.defaultParallelism)
    for block in _blocks(units, facts.n, max(1, query_bytes // (8 * facts.most))):
        sent = spark.sparkContext.broadcast(
            (block["query_id"].to_numpy(), np.vstack(block["unit"].to_numpy()))
        )
        found = vecs.mapInArrow(_scorer(sent, k, schema), schema)
        _ranked(found, k).write.mode("append").parquet(path)
        sent.unpersist()
    return _with_columns(spark.read.parquet(path), wanted, columns, k)


def _blocks(units: DataFrame, total: int, size: int) -> Iterator[pd.DataFrame]:
    """The queries, at most ``size`` at a time."""
    if total <= size:
        yield units.toPandas()
        return
    placed = number_rows(units, [F.col("query_id")], "_turn")
    for start in range(0, total, size):
        inside = (F.col("_turn") > start) & (F.col("_turn") <= start + size)
        yield placed.where(inside).toPandas()


def _scorer(sent, k: int, schema: T.StructType):
    """Task function: keys and scores of the k best rows per query."""
    arrow = to_arrow_schema(schema)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        best = _Best(matrix, k)
        _scan_arrow(best, batches)
        yield from _output(best, ids, arrow).to_batches(_OUT_ROWS)

    return score


def _ranked(partial: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *KEY)
    ranked = partial.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "score", *KEY)


def _with_columns(
    hits: DataFrame, wanted: DataFrame, columns: Sequence[str], k: int
) -> DataFrame:
    """Hits with further chunk columns, read for the chunks that were hit.

    Where a chunk is listed more than once under its key, the n-th hit of a query
    on the key takes the n-th of these rows.
    """
    if not columns:
        return hits
    of_query = Window.partitionBy("query_id", *KEY).orderBy("rank")
    of_key = Window.partitionBy(*KEY).orderBy(*columns)
    rows = (
        wanted.select(*KEY, *columns)
        .join(hits.select(*KEY).distinct(), [*KEY], "left_semi")
        .withColumn("_copy", F.row_number().over(of_key))
        .where(F.col("_copy") <= k)
    )
    numbered = hits.withColumn("_copy", F.row_number().over(of_query))
    return numbered.join(rows, [*KEY, "_copy"]).select(
        "query_id", "rank", "score", *KEY, *columns
    )
