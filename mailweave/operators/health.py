"""Corpus statistics and the index health report."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.operators.skew import number_rows
from mailweave.session import materialize


def source_stats(chunks: DataFrame) -> DataFrame:
    """Chunks per source path, largest first."""
    return _largest_first(_per_source(chunks))


def _per_source(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_path").agg(F.count(F.lit(1)).alias("chunk_count"))


def _largest_first(stats: DataFrame) -> DataFrame:
    return stats.orderBy(F.desc("chunk_count"), F.asc("source_path"))


def index_stats(chunks: DataFrame) -> DataFrame:
    """Chunk count, distinct sources and vector dimension in one row."""
    return chunks.agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.count_distinct("source_id").alias("source_file_count"),
        F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"),
    )


def top_sources(chunks: DataFrame, limit: int = 20) -> DataFrame:
    """The ``limit`` largest sources and how many more there are."""
    # Written once, so that the chunks are read once for both.
    stats = materialize(_per_source(chunks), "source-stats")
    hidden = F.lit(max(0, stats.count() - limit)).cast("bigint")
    return _largest_first(stats).limit(limit).withColumn("more_sources", hidden)


def ingest_age(ingested_at: Column, now: datetime | Column) -> Column:
    """``<1h ago``, ``Nh ago`` or ``Nd Nh ago``; '' when the time is unknown."""
    moment = now if isinstance(now, Column) else F.lit(now)
    at = ingested_at.try_cast("timestamp")
    seconds = F.unix_seconds(moment.cast("timestamp")) - F.unix_seconds(at)
    hours = F.floor(seconds / 3600)
    days, rest = F.floor(hours / 24), hours % 24
    text = (
        F.when(hours < 1, F.lit("<1h ago"))
        .when(days > 0, F.format_string("%sd %sh ago", days, rest))
        .otherwise(F.format_string("%sh ago", hours))
    )
    return F.coalesce(F.when(at.isNotNull(), text), F.lit(""))


def health_report(
    spark: SparkSession,
    chunks: DataFrame | None,
    index_model: str | None,
    configured_model: str,
    *,
    available: bool = True,
    exemplars: DataFrame | None = None,
) -> DataFrame:
    """One row: counts, flags, the example pool and the list of issues.

    ``chunks`` is None when the index could not be opened. The pool is shown by
    its size, and by :func:`pool_titles` in full; an empty pool is no issue.
    """
    pool_size = F.lit(0).cast("bigint")
    if exemplars is not None:
        pool_size = exemplars.agg(F.count(F.lit(1))).scalar()
    loaded = available and chunks is not None
    if loaded:
        stats = index_stats(chunks)
    else:
        stats = spark.range(1).select(
            F.lit(0).cast("bigint").alias("chunk_count"),
            F.lit(0).cast("bigint").alias("source_file_count"),
            F.lit(0).alias("dimension"),
        )
    matches = loaded and index_model == configured_model
    no_chunks = F.lit(loaded) & (F.col("chunk_count") == 0)
    issues = F.array_compact(
        F.array(
            F.when(F.lit(not available), F.lit("index not found at its destination")),
            F.when(F.lit(available and not loaded), F.lit("index could not be loaded")),
            F.when(
                F.lit(loaded and not matches and bool(index_model)),
                F.lit(f"index was built with '{index_model}', not '{configured_model}'"),
            ),
            F.when(no_chunks, F.lit("index has no chunks")),
        )
    )
    return stats.select(
        F.lit(available).alias("available"),
        F.lit(loaded).alias("loaded"),
        "chunk_count",
        "source_file_count",
        "dimension",
        F.lit(matches).alias("model_matches"),
        (F.lit(loaded and matches) & (F.col("chunk_count") > 0)).alias("healthy"),
        pool_size.alias("exemplar_count"),
        issues.alias("issues"),
    )


def pool_titles(exemplars: DataFrame) -> DataFrame:
    """Every title of the pool with its place, one row each."""
    keys = exemplars.select("title", "source_id", F.lower("title").alias("_title"))
    placed = number_rows(keys, [F.col("_title"), F.col("source_id")], "place")
    return placed.select("place", "title", "source_id")


def outcome_counts(processed: DataFrame) -> DataFrame:
    """Messages per outcome."""
    return processed.groupBy("outcome").agg(F.count(F.lit(1)).alias("messages"))
