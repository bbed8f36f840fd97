"""Corpus listings: files below folders, with readable paths."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailweave.functions import fixed
from mailweave.session import materialize, shared_dir
from mailweave.sources.html import HTML_MIME

FILE_COLUMNS = ("file_id", "name", "mime_type", "path", "modified_time")

# Tasks per core that read the files of a folder, at most.
READ_WAVES = 16
# Bytes read by a task where there are fewer, and what opening a file counts for.
_TASK_BYTES, _OPEN_BYTES = 134_217_728, 4_194_304
# Entries of a listing and bytes of contents that a task gives out at a time.
_LISTED_ROWS, _READ_BYTES = 10_000, 16_777_216


def root_paths(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """``roots(folder_id)`` with their display name, or the id when unknown."""
    named = nodes.select(F.col("id").alias("folder_id"), "name").dropDuplicates(["folder_id"])
    return roots.join(named, "folder_id", "left").select(
        "folder_id", F.coalesce("name", "folder_id").alias("path")
    )


def folder_paths(roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """All folders below the roots with their full path, at any depth.

    Walks one level per join over the folder rows only; files, the bulk of the
    table, are not touched. A folder that lies below itself is an error.
    """
    shared_dir(nodes.sparkSession)
    folders = nodes.where(F.col("mime_type") == fixed.FOLDER_MIME).select(
        F.col("parent_id").alias("folder_id"), F.col("id").alias("child_id"), "name"
    )
    level = root_paths(roots, nodes).withColumn("_trail", F.array("folder_id")).checkpoint()
    levels = [level]
    loop = F.raise_error(F.concat(F.lit("folder lies below itself: "), "path")).cast("string")
    below = F.concat("path", F.lit(fixed.PATH_SEPARATOR), "name")
    inside_itself = F.array_contains("_trail", F.col("child_id"))
    while True:
        level = (
            level.join(folders, "folder_id")
            .select(
                F.col("child_id").alias("folder_id"),
                F.when(inside_itself, loop).otherwise(below).alias("path"),
                F.array_append("_trail", F.col("child_id")).alias("_trail"),
            )
            .checkpoint()
        )
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels).drop("_trail")
        levels.append(level)


def list_files(
    nodes: DataFrame,
    roots: DataFrame,
    *,
    recursive: bool = True,
    include_mime_types: Sequence[str] = (),
) -> DataFrame:
    """Files below ``roots(folder_id)``; folders themselves are not listed.

    A file under two roots is listed twice. An empty MIME list keeps all types.
    """
    parents = folder_paths(roots, nodes) if recursive else root_paths(roots, nodes)
    files = nodes.where(F.col("mime_type") != fixed.FOLDER_MIME)
    if include_mime_types:
        files = files.where(F.col("mime_type").isin(*include_mime_types))
    placed = files.join(
        parents.withColumnRenamed("folder_id", "parent_id"), "parent_id"
    )
    return placed.select(
        F.col("id").alias("file_id"),
        "name",
        "mime_type",
        F.concat("path", F.lit(fixed.PATH_SEPARATOR), "name").alias("path"),
        F.coalesce("modified_time", F.lit("")).alias("modified_time"),
    )


def read_folder(spark: SparkSession, folder: str, *, recursive: bool = True) -> DataFrame:
    """Files of a directory on any Hadoop file system, with their bytes.

    MIME types come from the file ending. Tasks list the folders level by level into a table and read
    the files, so neither the driver nor a task holds the whole listing. A file system that pyarrow does
    not open is left to Spark's reader, which lists in the driver.
    """
    endings = {"txt": "text/plain", "md": "text/markdown", "pdf": fixed.PDF_MIME, "html": HTML_MIME}
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    qualified = system.makeQualified(place)
    folder = qualified.toString()
    opener = _opener(qualified.toUri())
    files = opener and _listed_files(spark, folder, opener, recursive)
    if files is None:
        files = _spark_files(spark, folder, recursive)
    name = F.substring_index("path", "/", -1)
    ending = F.lower(F.substring_index(name, ".", -1))
    mime = F.lit("application/octet-stream")
    for suffix, known in endings.items():
        mime = F.when(ending == suffix, F.lit(known)).otherwise(mime)
    root = folder.rstrip("/").rsplit("/", 1)[-1]
    return files.select(
        F.col("path").alias("file_id"),
        name.alias("name"),
        mime.alias("mime_type"),
        F.replace(
            F.concat(F.lit(f"{root}/"), "below"), F.lit("/"), F.lit(fixed.PATH_SEPARATOR)
        ).alias("path"),
        F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss").alias("modified_time"),
        "content",
    )


def _spark_files(spark: SparkSession, folder: str, recursive: bool) -> DataFrame:
    """``(path, below, modificationTime, content)`` by Spark's reader."""
    # A file's path is the folder's, perhaps with a scheme before it, and what lies below.
    prefix = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", folder.rstrip("/")) + "/"
    below = F.expr("substring(path, instr(path, {p}) + length({p}))".format(p=_literal(prefix)))
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", str(recursive).lower())
        .load(folder)
        # Spark counts each file as megabytes, so small files would make a task of every few.
        .coalesce(READ_WAVES * spark.sparkContext.defaultParallelism)
    )
    return files.select("path", below.alias("below"), "modificationTime", "content")


def _opener(uri: Any) -> Callable[[], tuple[Any, str]] | None:
    """What opens the file system of a folder and names the folder there, None where pyarrow cannot."""
    from pyarrow import fs

    local, whole = uri.getPath() if uri.getScheme() == "file" else None, uri.toString()

    def opened() -> tuple[Any, str]:
        from pyarrow import fs

        return (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(whole)

    try:
        system, root = opened()
        return opened if system.get_file_info(root).type == fs.FileType.Directory else None
    except Exception:  # noqa: BLE001 - unknown schemes, missing libraries or rights
        return None


def _hidden(name: str, is_folder: bool) -> bool:
    """Names that Spark's readers leave out."""
    if is_folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _listed_files(
    spark: SparkSession, folder: str, opener: Callable[[], tuple[Any, str]], recursive: bool
) -> DataFrame | None:
    """``(path, below, modificationTime, content)``, listed and read by tasks; None for a folder
    that is not to be walked and is partitioned by names ``key=value``, which Spark knows to read."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = opener()
        for parent in (p for batch in batches for p in batch.column(0).to_pylist()):
            base = f"{root.rstrip('/')}/{parent}".rstrip("/") or "/"
            found = system.get_file_info(fs.FileSelector(base, allow_not_found=bool(parent)))
            for start in range(0, len(found), _LISTED_ROWS):
                rows = [
                    (f"{parent}/{i.base_name}".lstrip("/"), i.type == fs.FileType.Directory, i.size, i.mtime_ns)
                    for i in found[start : start + _LISTED_ROWS]
                    if i.type != fs.FileType.NotFound
                    and not _hidden(i.base_name, i.type == fs.FileType.Directory)
                ]
                paths, folders, sizes, times = zip(*rows) if rows else ([], [], [], [])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(paths, pa.string()),
                        pa.array(folders, pa.bool_()),
                        pa.array(sizes, pa.int64()),
                        pa.array([t and t // 1_000_000 for t in times], pa.int64()),
                    ],
                    names=["below", "is_folder", "size", "modified_ms"],
                )

    @F.arrow_udf("binary")
    def contents(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        system, root = opener()
        for batch in batches:
            part, size = [], 0
            for below in batch.to_pylist():
                with system.open_input_file(f"{root.rstrip('/')}/{below}") as file:
                    part.append(file.read())
                size += len(part[-1])
                if size >= _READ_BYTES:
                    yield pa.array(part, pa.binary())
                    part, size = [], 0
            yield pa.array(part, pa.binary())

    tasks = spark.sparkContext.defaultParallelism
    folders, levels = spark.createDataFrame([("",)], "below string"), []
    while not levels or not folders.isEmpty():
        listed = folders.select("below").mapInArrow(
            entries, "below string, is_folder boolean, size long, modified_ms long"
        )
        levels.append(materialize(listed, "folder-listing"))
        folders = levels[-1].where("is_folder").repartition(tasks)
        if not recursive:
            if folders.where(F.contains("below", F.lit("="))).isEmpty():
                break
            return None
    # Spark's readers leave out empty files too.
    files = reduce(DataFrame.unionByName, levels).where("not is_folder and size > 0")
    total = files.agg(F.coalesce(F.sum(F.col("size") + _OPEN_BYTES), F.lit(0))).first()[0]
    spread = files.repartition(max(1, min(READ_WAVES * tasks, -(-total // _TASK_BYTES))))
    return spread.select(
        F.concat(F.lit(folder.rstrip("/") + "/"), "below").alias("path"),
        "below",
        F.timestamp_millis("modified_ms").alias("modificationTime"),
        contents(F.col("below")).alias("content"),
    )


def _literal(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def union_listings(*listings: DataFrame) -> DataFrame:
    """Listings of several folders together, without removing repeats."""
    return reduce(DataFrame.unionByName, listings)


def read_name_list(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, phrase)`` rows of a names file; see :func:`name_lines`."""
    raw = spark.read.text(path, wholetext=True)
    return name_lines(raw.select(F.col("value").alias("text")))


def name_lines(texts: DataFrame) -> DataFrame:
    """One phrase per line; blank lines, ``#`` lines and a leading BOM go."""
    from mailweave.functions.text import lines, strip

    body = F.regexp_replace("text", "^﻿", "")
    keep = [c for c in texts.columns if c != "text"]
    split = texts.select(*keep, F.posexplode(lines(body)).alias("pos", "phrase"))
    trimmed = split.withColumn("phrase", strip(F.col("phrase")))
    return trimmed.where((F.col("phrase") != "") & ~F.col("phrase").startswith("#"))
