"""One output file per row, on any file system that pyarrow opens.

Tasks write their files below a staging folder of their own attempt and report them; only the
reports of attempts that Spark commits reach the manifest, and only files of the manifest are moved to
their places. A task that runs again, or twice at a time, therefore adds nothing, and until the move the
folder shows none of the new files. Moves run in tasks too and may be repeated.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailweave.session import materialize, remove

STAGING = "_staging-"


def _checked_names(df: DataFrame, name: str) -> None:
    """An error where a name is missing, leaves the folder or comes twice."""
    steps = F.split(F.col(name), "/")
    wrong = F.col(name).isNull() | F.exists(
        steps, lambda s: s.isin("", ".", "..") | s.startswith(STAGING)
    )
    bad = df.select(name).where(wrong).limit(3).collect()
    if bad:
        raise ValueError(f"not a file name below the folder: {[row[0] for row in bad]}")
    twice = df.groupBy(name).count().where("count > 1").select(name).limit(3).collect()
    if twice:
        raise ValueError(f"several rows for one file: {[row[0] for row in twice]}")


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> DataFrame:
    """Write each row's ``content`` (text or bytes, null as nothing) to ``folder/name``.

    ``name`` may have folders in it. Existing files of the same names are replaced, others stay.
    Returns ``(name, n_bytes)`` of what was written.
    """
    _checked_names(df, name)
    spark, place = df.sparkSession, f"{folder.rstrip('/')}/{STAGING}{uuid.uuid4().hex}"

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        task = TaskContext.get()
        system, root = fs.FileSystem.from_uri(place)
        own = f"{task.partitionId()}-{task.taskAttemptId()}"
        system.create_dir(f"{root}/{own}", recursive=True)
        number = 0
        for batch in batches:
            staged, sizes = [], []
            for data in batch.column(1).to_pylist():
                with system.open_output_stream(f"{root}/{own}/{number}") as out:
                    out.write(data or b"")
                staged.append(f"{own}/{number}")
                sizes.append(len(data or b""))
                number += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(staged, pa.string()), pa.array(sizes, pa.int64())],
                names=["name", "staged", "n_bytes"],
            )

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(place)
        _, target = fs.FileSystem.from_uri(folder.rstrip("/"))
        for batch in batches:
            for file, staged in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source = f"{root}/{staged}"
                if system.get_file_info(source).type == fs.FileType.NotFound:
                    continue  # moved by an earlier attempt
                system.create_dir(posixpath.dirname(f"{target}/{file}"), recursive=True)
                system.move(source, f"{target}/{file}")
            yield batch.select([0, 2])

    rows = df.select(F.col(name).alias("name"), F.col(content).cast("binary").alias("content"))
    try:
        manifest = materialize(
            rows.mapInArrow(stage, "name string, staged string, n_bytes long"), "files-manifest"
        )
        return materialize(manifest.mapInArrow(publish, "name string, n_bytes long"), "files-written")
    finally:
        remove(spark, place)
