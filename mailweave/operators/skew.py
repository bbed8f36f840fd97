"""Ordered numbering and running sums that hold when one key has most rows.

A window puts a whole key into one task. Keys above a row count are therefore
numbered by range: the rows are range-partitioned on ``(key, order)``, numbered
inside each slice, and shifted by what earlier slices of the key hold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailweave.session import materialize, shared_dir

HOT_ROWS = 2_000_000
# Rows of (key, slice, two numbers) that may be broadcast, some 50 MB.
SENT_ROWS = 1_000_000


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Table of the keys with more than ``hot_rows`` rows, None when there are none.

    Of N rows at most N / ``hot_rows`` keys are in it; it stays a table, so any
    number will do. The count reads the key column only and is pre-aggregated
    before its shuffle.
    """
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    hot = counted.where((F.col("_rows") > hot_rows) & F.col(key).isNotNull()).select(key)
    return None if hot.isEmpty() else materialize(hot, "hot-keys")


def split_by_keys(
    df: DataFrame, key: str, hot: DataFrame | None
) -> tuple[DataFrame, DataFrame | None]:
    """Rows outside and inside the keys of ``hot``; rows with a null key are outside."""
    if hot is None:
        return df, None
    return df.join(hot, key, "left_anti"), df.join(hot, key, "left_semi")


def _sum(measure: Column | None) -> Column:
    return F.sum((F.lit(0) if measure is None else measure).cast("bigint"))


def window_positions(
    df: DataFrame, key: str, order: Sequence[Column], measure: Column | None = None
) -> DataFrame:
    """``ordinal`` from 1 and inclusive ``running`` sum per key, one shuffle."""
    by_key = Window.partitionBy(key).orderBy(*order)
    upto = by_key.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.select(
        "*",
        F.row_number().over(by_key).cast("bigint").alias("ordinal"),
        _sum(measure).over(upto).alias("running"),
    )


def ranged_positions(
    df: DataFrame, key: str, order: Sequence[Column], measure: Column | None = None
) -> DataFrame:
    """Same result as :func:`window_positions` with every task bounded.

    The slice number is part of the data from the checkpoint on, so a lost
    executor cannot give a row another slice.
    """
    shared_dir(df.sparkSession)
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(slices, F.col(key), *order)
        .withColumn("_slice", F.spark_partition_id())
        .checkpoint()
    )
    held = materialize(
        placed.groupBy(key, "_slice").agg(
            F.count(F.lit(1)).alias("_rows"), _sum(measure).alias("_sum")
        ),
        "slice-sums",
    )
    earlier = (
        Window.partitionBy(key)
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = held.select(
        key,
        "_slice",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_sum_before"),
    )
    inside = Window.partitionBy(key, "_slice").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = placed.select(
        "*",
        F.row_number().over(inside).cast("bigint").alias("_ordinal"),
        _sum(measure).over(upto).alias("_running"),
    )
    # One row per key and slice it spans: at most keys + slices rows.
    if held.count() <= SENT_ROWS:
        carried = F.broadcast(carried)
    return (
        local.join(carried, [key, "_slice"])
        .withColumn("ordinal", F.col("_ordinal") + F.col("_rows_before"))
        .withColumn("running", F.col("_running") + F.col("_sum_before"))
        .drop(
            "_slice", "_ordinal", "_running", "_rows_before", "_sum_before"
        )
    )


def number_rows(df: DataFrame, order: Sequence[Column], name: str = "index") -> DataFrame:
    """1-based position of every row in a total order, without one big task."""
    shared_dir(df.sparkSession)
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(slices, *order)
        .sortWithinPartitions(*order)
        .withColumn("_id", F.monotonically_increasing_id())
        .checkpoint()
        .withColumn("_slice", F.shiftright("_id", 33))
    )
    # One row per slice.
    held = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = held.select(
        "_slice", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before")
    )
    in_slice = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(carried), "_slice")
        .withColumn(name, in_slice + F.col("_before") + 1)
        .drop("_id", "_slice", "_before")
    )
