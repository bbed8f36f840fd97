"""Session settings shared by tests, the benchmark and ad-hoc use."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(
    master: str | None = None, shuffle_partitions: int | None = None
) -> SparkSession:
    """Session with the settings the library relies on.

    On a cluster leave both arguments out and let ``spark-submit`` decide.
    """
    builder = (
        SparkSession.builder.appName("mailweave")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``, else the
    checkpoint directory of the context.

    Where neither is set a local session (tests) gets a fresh folder; on a cluster that
    would be another disk on every machine, so it is an error there.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="mailweave-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write ``df`` once below the shared folder and read it back.

    Cuts the lineage in a way that survives lost executors, and later steps read
    only the columns they need. With ``folder`` the table is ``folder/label`` and
    replaces what lies there; :func:`remove` deletes such a folder after its use.
    """
    path = f"{folder}/{label}" if folder else scratch_path(df.sparkSession, label)
    df.write.mode("overwrite" if folder else "error").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate tables, wherever it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
