"""Outcome per processed message: a log by batch, and buckets by hash that it is merged into.

Each batch writes its own folder of the log, so writing a batch again replaces it. :func:`compact`
merges finished batches into buckets: a bucket holds the ids whose hash begins with certain bits, the
newest row per id with its batch, and is split when it has more than BUCKET_ROWS rows. Only buckets
that get new rows are read and written; a manifest then names the folders that count. A reader that
asks for some ids (:func:`outcomes_of`) opens their buckets and the short log, so what it reads does
not grow with the history. Readers take the newest outcome per message.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.functions import fixed
from mailweave.session import remove

STATE_SCHEMA = "message_id string, outcome string, processed_at timestamp"
ROW = ("message_id", "outcome", "processed_at", "batch")
BUCKET_ROWS = 100_000
COMPACT_AFTER = 8  # finished batches in the log
# (depth, value, folder): the ids whose hash begins with the ``depth`` bits ``value``.
Bucket = tuple[int, int, str | None]


def with_default_outcome(log: DataFrame) -> DataFrame:
    """Rows from before outcomes were stored count as drafted."""
    return log.withColumn(
        "outcome", F.coalesce("outcome", F.lit(fixed.OUTCOME_DRAFTED))
    )


def latest_outcomes(log: DataFrame) -> DataFrame:
    """Last write per message."""
    newest = F.struct("processed_at", "outcome")
    return (
        with_default_outcome(log)
        .groupBy("message_id")
        .agg(F.max(newest).alias("_last"))
        .select("message_id", "_last.outcome", "_last.processed_at")
    )


def append_outcomes(rows: DataFrame, path: str, batch: int | str) -> None:
    """Write one batch; the same batch id replaces itself."""
    rows.select("message_id", "outcome", "processed_at").write.mode("overwrite").parquet(
        f"{path}/log/batch={batch}"
    )


def _folders(spark: SparkSession, path: str, key: str) -> list[str]:
    """Values of the finished ``key=value`` folders of a folder, none where it does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    found = [status.getPath() for status in system.listStatus(place)]
    done = [f for f in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return [f.getName().partition("=")[2] for f in done if f.getName().startswith(f"{key}=")]


def batches(spark: SparkSession, path: str) -> list[str]:
    """Ids of the batches that a folder of ``batch=<id>`` tables has."""
    return _folders(spark, path, "batch")


def _manifest(spark: SparkSession, path: str) -> tuple[int, list[Bucket]]:
    """Number and buckets of the newest manifest; one bucket of everything where there is none."""
    numbers = [int(n) for n in _folders(spark, f"{path}/buckets", "manifest")]
    if not numbers:
        return 0, [(0, 0, None)]
    rows = spark.read.parquet(f"{path}/buckets/manifest={max(numbers)}").collect()
    return max(numbers), [(r.depth, r.value, r.folder) for r in rows]


def _prefix(depth: int | Column) -> Column:
    """The first ``depth`` bits of an id's hash."""
    hashed = F.xxhash64("message_id")
    if isinstance(depth, int):
        return F.shiftrightunsigned(hashed, 64 - depth) if depth else F.lit(0).cast("long")
    # A shift by 64 would leave all bits.
    return F.when(depth == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftrightunsigned", hashed, (64 - depth).cast("int"))
    )


def _bucket_of(rows: DataFrame, buckets: list[Bucket]) -> DataFrame:
    """``rows`` with ``depth`` and ``value`` of the bucket each id belongs to."""
    known = rows.sparkSession.createDataFrame(
        [(d, v) for d, v, _ in buckets], "depth int, value long"
    )
    depths = sorted({d for d, _, _ in buckets})
    tries = F.explode(F.array(*[
        F.struct(F.lit(d).cast("int").alias("depth"), _prefix(d).alias("value")) for d in depths
    ]))
    return rows.withColumn("_try", tries).select(*rows.columns, "_try.*").join(
        known, ["depth", "value"], "left_semi"
    )


def _log(spark: SparkSession, path: str, batches: list[str]) -> DataFrame:
    if not batches:
        return spark.createDataFrame([], STATE_SCHEMA + ", batch string")
    log = spark.read.schema(STATE_SCHEMA).option("basePath", f"{path}/log").parquet(
        *[f"{path}/log/batch={b}" for b in batches]
    )
    return log.withColumn("batch", F.col("batch").cast("string")).select(*ROW)


def _read_buckets(spark: SparkSession, folders: list[str]) -> DataFrame:
    schema = STATE_SCHEMA + ", batch string"
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def _view(rows: DataFrame, without_batch: int | str | None) -> DataFrame:
    if without_batch is not None:
        rows = rows.where(F.col("batch") != str(without_batch))
    return latest_outcomes(rows)


def read_state(
    spark: SparkSession, path: str, without_batch: int | str | None = None
) -> DataFrame:
    """Current outcome per message; empty when nothing was written yet.

    ``without_batch`` leaves out one batch, so that a batch that runs again sees
    the state it saw the first time.
    """
    _, buckets = _manifest(spark, path)
    log = _log(spark, path, batches(spark, f"{path}/log"))
    return _view(log.unionByName(_read_buckets(spark, [f for *_, f in buckets if f])), without_batch)


def outcomes_of(
    ids: DataFrame, path: str, without_batch: int | str | None = None
) -> DataFrame:
    """:func:`read_state` for the messages of ``ids (message_id)`` only."""
    spark = ids.sparkSession
    asked = ids.select("message_id").where(F.col("message_id").isNotNull()).distinct()
    _, buckets = _manifest(spark, path)
    held = [b for b in buckets if b[2]]
    folders: list[str] = []
    if held:
        hit = _bucket_of(asked, held).select("depth", "value").distinct().collect()
        places = {(d, v): f for d, v, f in held}
        folders = [places[r.depth, r.value] for r in hit]
    log = _log(spark, path, batches(spark, f"{path}/log"))
    rows = log.unionByName(_read_buckets(spark, folders))
    return _view(rows.join(asked, "message_id", "left_semi"), without_batch)


def compact(
    spark: SparkSession, path: str, running: int | str | None = None, after: int = 1
) -> bool:
    """Merge the log into the buckets, but for the ``running`` batch; False where fewer than
    ``after`` batches wait.

    A row stays that of the batch that wrote it last, so a batch that runs
    again afterwards still does not see its own outcomes.
    """
    waiting = [b for b in batches(spark, f"{path}/log") if b != str(running)]
    if len(waiting) < max(after, 1):
        return False
    number, buckets = _manifest(spark, path)
    log = _bucket_of(with_default_outcome(_log(spark, path, waiting)), buckets)
    touched = {(r.depth, r.value) for r in log.select("depth", "value").distinct().collect()}
    old = [f for d, v, f in buckets if f and (d, v) in touched]
    both = log.unionByName(_bucket_of(_read_buckets(spark, old), buckets))
    row = F.struct("processed_at", "outcome", "batch")
    newest = both.groupBy("depth", "value", "message_id").agg(F.max(row).alias("_last")).select(
        "depth", "value", "message_id", "_last.outcome", "_last.processed_at", "_last.batch"
    )
    # At most one row per bucket that got new rows.
    sizes = {(r.depth, r.value): r["count"] for r in newest.groupBy("depth", "value").count().collect()}
    deeper = {k: max(0, math.ceil(math.log2(n / BUCKET_ROWS))) for k, n in sizes.items()}
    more = spark.createDataFrame([(*k, e) for k, e in deeper.items()], "depth int, value long, more int")
    place = f"{path}/buckets/data-{uuid.uuid4().hex}"
    split = newest.join(F.broadcast(more), ["depth", "value"]).withColumn(
        "depth", F.col("depth") + F.col("more")
    ).withColumn("value", _prefix(F.col("depth")))
    split.drop("more").repartition("depth", "value").sortWithinPartitions(
        "depth", "value", "message_id"
    ).write.partitionBy("depth", "value").parquet(place)
    filled = spark.read.schema("message_id string, depth int, value long").parquet(place)
    new = {
        (r.depth, r.value): f"{place}/depth={r.depth}/value={r.value}"
        for r in filled.select("depth", "value").distinct().collect()
    }
    rows: list[Bucket] = [b for b in buckets if (b[0], b[1]) not in touched]
    for (depth, value), extra in deeper.items():
        children = [(depth + extra, (value << extra) + i) for i in range(1 << extra)]
        rows += [(d, v, new.get((d, v))) for d, v in children]
    spark.createDataFrame(rows, "depth int, value long, folder string").coalesce(1).write.parquet(
        f"{path}/buckets/manifest={number + 1}"
    )
    # Nothing that the new manifest names is removed; what is left behind by a crash repeats known rows.
    for batch in waiting:
        remove(spark, f"{path}/log/batch={batch}")
    for folder in old:
        remove(spark, folder)
    return True
