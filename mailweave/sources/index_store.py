"""Versioned chunk index on any Hadoop file system.

``<base>/chunks/<version>`` holds the rows of one version and
``<base>/versions`` one row per published version. A version becomes visible
when its row is appended, after its data was written and checked; readers use
the newest row. A failed publish leaves the old version in place.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from mailweave.functions import vectors

META_SCHEMA = (
    "version string, embedding_model string, dimension int, ingested_at timestamp, "
    "source_file_count bigint, chunk_count bigint"
)
COLUMNS = ("source_id", "source_name", "source_path", "chunk_index", "text")


class IndexUnusableError(RuntimeError):
    """The index is missing, empty, or does not fit the configured model."""


def gate(chunks: DataFrame, source_file_count: int) -> DataFrame:
    """The facts a publish depends on, in one row with a ``publishable`` flag."""
    size = F.size("embedding")
    facts = chunks.agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.count("embedding").alias("vector_count"),
        F.coalesce(F.min(size), F.lit(0)).alias("min_dimension"),
        F.coalesce(F.max(size), F.lit(0)).alias("max_dimension"),
    )
    return facts.withColumn("source_file_count", F.lit(source_file_count).cast("bigint")).withColumn(
        "publishable",
        (F.col("source_file_count") > 0)
        & (F.col("chunk_count") > 0)
        & (F.col("vector_count") == F.col("chunk_count"))
        & (F.col("min_dimension") > 0)
        & (F.col("min_dimension") == F.col("max_dimension")),
    )


def write_index(
    chunks: DataFrame, base: str, *, embedding_model: str, source_file_count: int
) -> Row:
    """Write, check and publish one version; returns its version row.

    Vectors are normalized once here. Rows are sorted by source inside each
    file so that a filter on sources can skip row groups.
    """
    spark = chunks.sparkSession
    now = datetime.now(timezone.utc)
    version = f"{now:%Y%m%dT%H%M%S%f}-{uuid.uuid4().hex[:8]}"
    target = f"{base}/chunks/{version}"
    (
        chunks.select(*COLUMNS, "embedding")
        .withColumn("unit_embedding", vectors.unit(F.col("embedding")))
        .sortWithinPartitions("source_id", "chunk_index")
        .write.parquet(target)
    )
    facts = gate(spark.read.parquet(target), source_file_count).first()
    if not facts.publishable:
        raise IndexUnusableError(f"refusing to publish an unusable index: {facts.asDict()}")
    row = (
        version,
        embedding_model,
        facts.max_dimension,
        now,
        source_file_count,
        facts.chunk_count,
    )
    meta = spark.createDataFrame([row], META_SCHEMA).coalesce(1)
    meta.write.mode("append").parquet(f"{base}/versions")
    return meta.first()


def current_version(spark: SparkSession, base: str) -> Row | None:
    """Newest published version, or None when nothing was published."""
    try:
        versions = spark.read.schema(META_SCHEMA).parquet(f"{base}/versions")
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return versions.orderBy(F.desc("ingested_at"), F.desc("version")).first()


def load_index(spark: SparkSession, base: str) -> tuple[Row, DataFrame]:
    """Version row and chunk rows of the current version."""
    meta = current_version(spark, base)
    if meta is None:
        raise IndexUnusableError(f"no index published at {base}")
    return meta, spark.read.parquet(f"{base}/chunks/{meta.version}")


def open_index(spark: SparkSession, base: str, embedding_model: str) -> DataFrame:
    """Chunks for retrieval; refuses an empty index or one of another model.

    A version without a stored model name is accepted.
    """
    meta, chunks = load_index(spark, base)
    if meta.chunk_count == 0:
        raise IndexUnusableError(f"index at {base} is empty")
    if meta.embedding_model and meta.embedding_model != embedding_model:
        raise IndexUnusableError(
            f"index was built with '{meta.embedding_model}', not '{embedding_model}'"
        )
    return chunks
