"""Bytes of files, read by the tasks that need them.

Spark lists the files and deals them out; a task opens its own through pyarrow's file systems and reads what it needs:
a first record, a digest in chunks, or one range. No row ever holds a file.
"""

from __future__ import annotations

import csv
import hashlib
import io
import os
from collections.abc import Callable, Iterator, Sequence
from fnmatch import fnmatchcase
from typing import BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes a task reads of a file at a time.
CHUNK_BYTES = 1 << 20

#: Characters after which a first line counts as ended.
HEADER_CHARS = 1 << 20

Opener = Callable[[str], BinaryIO]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it, and the path inside it: local, hdfs, s3, gs, abfs."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), os.path.abspath(path)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")


def open_file(path: str) -> pa.NativeFile:
    store, inner = _store(path)
    return store.open_input_file(inner)


def listing(spark: SparkSession, path: str | Sequence[str], glob: str = "*") -> DataFrame:
    """(path, name, length) of every file that holds something, as Spark's readers see them. No content is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path if isinstance(path, str) else list(path))
    return found.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


def walk(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, name, length) of every file under a folder, empty ones too, which Spark's readers leave out.

    A task lists folder by folder, so no names pass through the driver; hidden files and folders are left out as Spark does. Rows
    are dealt out over as many tasks as the cluster has cores at least. A folder that is not there holds no files.
    """

    def shown(name: str) -> bool:
        return not name.startswith(".") and (not name.startswith("_") or "=" in name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for root in (r for batch in batches for r in batch.column("root").to_pylist()):
            store, base = _store(root)
            folders = [fs.FileSelector(base, allow_not_found=True)]
            if store.get_file_info(base).type == fs.FileType.File:
                folders = [[base]]
            while folders:
                found = [i for i in store.get_file_info(folders.pop()) if shown(i.base_name)]
                folders += [fs.FileSelector(i.path) for i in found if i.type == fs.FileType.Directory]
                files = [i for i in found if i.type == fs.FileType.File and fnmatchcase(i.base_name, glob)]
                yield pa.RecordBatch.from_pydict({
                    "path": pa.array([root + i.path.removeprefix(base) for i in files], pa.string()),
                    "name": pa.array([i.base_name for i in files], pa.string()),
                    "length": pa.array([i.size for i in files], pa.int64())})

    roots = spark.createDataFrame([(path.rstrip("/"),)], "root string")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return roots.mapInArrow(run, "path string, name string, length bigint").repartition(tasks, "path")


def _per_file(files: DataFrame, name: str, dtype: str, arrow: pa.DataType, read: Callable[[str], object]) -> DataFrame:
    """``files`` with the column ``name``: what ``read`` makes of each path, in the task that holds the row."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([read(p) for p in batch.column("path").to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return files.mapInArrow(run, f"{fields}, `{name}` {dtype}")


def with_header(files: DataFrame, open_: Opener = open_file) -> DataFrame:
    """``header``: the stripped cells of each file's first CSV record, null if the file is empty.

    A file is read to the end of that record only, in blocks of a few kilobytes. A byte order mark is left out. A record with
    a cell beyond the csv module's limit is no header: its list is empty.
    """

    def first_record(path: str) -> list[str] | None:
        with open_(path) as raw, io.TextIOWrapper(raw, "utf-8-sig", errors="replace", newline="") as text:
            try:
                return [cell.strip() for cell in next(csv.reader(iter(lambda: text.readline(HEADER_CHARS), "")))]
            except StopIteration:
                return None
            except csv.Error:
                return []

    return _per_file(files, "header", "array<string>", pa.list_(pa.string()), first_record)


def with_digest(files: DataFrame, open_: Opener = open_file) -> DataFrame:
    """``digest``: SHA-256 of each file's bytes in lowercase hex, a chunk at a time, whatever the file's size."""

    def digest(path: str) -> str:
        state = hashlib.sha256()
        with open_(path) as raw:
            while chunk := raw.read(CHUNK_BYTES):
                state.update(chunk)
        return state.hexdigest()

    return _per_file(files, "digest", "string", pa.string(), digest)
