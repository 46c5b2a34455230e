"""A folder of files as a batch source: names first, contents apart, one row for every failure.

``folder_names`` is a data source of its own. Its partitions are subfolders, each of which a task
lists, so a listing of many files isn't the driver's work. It knows names and sizes only. Contents are
read later, by tasks that get files dealt by size; a file that can't be read, or is too large, becomes a
row with an error, and the others go on. Hidden files are those whose name starts with ``.``; a name that starts with
``_`` is a file like any other.

Files are opened with Arrow's file systems: local paths, and addresses that start with ``s3``, ``s3a``, ``gs``, ``hdfs`` or ``abfs``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evisift.session import written

#: Subfolders that are listed at the same time, if there are as many.
LISTING_TASKS = 64
#: Levels of folders that the planner looks into for them.
LISTING_LEVELS = 3
#: Largest file that is read, and bytes dealt to one task.
MAX_BYTES = 256 * 2**20
TASK_BYTES = 256 * 2**20
#: Bytes of contents in one batch of a task.
BATCH_BYTES = 16 * 2**20

NAMES = "source_file string, filename string, size long, error string"
CONTENTS = "source_file string, filename string, size long, error string, content binary"


def opened(address: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of an address, the path in it, and what makes a path of it an address again."""
    scheme, _, rest = address.rpartition("://")
    if not scheme:
        return fs.LocalFileSystem(), re.sub("^file:(//)?", "", address), ""
    system, path = fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", address))
    lead = address[: len(address) - len(path)] if address.endswith(path) else f"{scheme}://"
    return system, path, lead


class Folder(InputPartition):
    def __init__(self, path: str, recursive: bool):
        super().__init__((path, recursive))


class FolderNames(DataSource):
    """``spark.read.format("folder_names").option("recursive", ...).load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "folder_names"

    def schema(self) -> str:
        return NAMES

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"], self.options.get("recursive", "true") == "true")


class FolderReader(DataSourceReader):
    def __init__(self, address: str, recursive: bool):
        self.address, self.recursive = address.rstrip("/") or "/", recursive

    def partitions(self) -> Sequence[InputPartition]:
        """Subfolders, level by level until there are enough of them; what lies above is listed flat."""
        system, path, _ = opened(self.address)
        kind = system.get_file_info(path).type
        if kind == fs.FileType.NotFound:
            raise FileNotFoundError(f"[PATH_NOT_FOUND] no such folder: {self.address}")
        if kind != fs.FileType.Directory:
            raise NotADirectoryError(f"[PATH_NOT_FOUND] not a folder: {self.address}")
        if not self.recursive:
            return [Folder(path, False)]
        flat, deep = [], [path]
        for _ in range(LISTING_LEVELS):
            below = [found.path for folder in deep for found in listing(system, folder) if found.type == fs.FileType.Directory]
            flat, deep = flat + deep, below
            if not deep or len(deep) >= LISTING_TASKS:
                break
        return [Folder(x, False) for x in flat] + [Folder(x, True) for x in deep]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        system, _, lead = opened(self.address)
        path, recursive = partition.value
        waiting = [path]
        while waiting:
            folder = waiting.pop()
            try:
                found = system.get_file_info(fs.FileSelector(folder))
            except OSError as failure:  # a folder that may not be entered
                yield lead + folder, folder.rsplit("/", 1)[-1], None, f"unreadable folder: {failure}"
                continue
            for x in found:
                if x.type == fs.FileType.File:
                    yield lead + x.path, x.base_name, x.size, None
                elif x.type == fs.FileType.Directory and recursive:
                    waiting.append(x.path)


def listing(system: fs.FileSystem, folder: str) -> list[fs.FileInfo]:
    try:
        return system.get_file_info(fs.FileSelector(folder))
    except OSError:  # told by the task that reads the folder
        return []


def names(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """``(source_file, filename, size, error)`` of every file below a folder; a missing folder raises."""
    FolderReader(folder, False).partitions()
    spark.dataSource.register(FolderNames)
    return spark.read.format("folder_names").option("recursive", str(recursive).lower()).load(folder)


def with_content(listed: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``content`` to listed files; where there is none, ``error`` says why."""

    def row(address: str, size: int | None, error: str | None) -> tuple[bytes | None, str | None]:
        if error is not None:
            return None, error
        try:
            system, path, _ = opened(address)
            if size is None:
                size = system.get_file_info(path).size
            if size is not None and size > max_bytes:
                return None, f"file too large: {size} bytes"
            with system.open_input_stream(path) as stream:
                content = stream.read(max_bytes + 1)
            if len(content) > max_bytes:  # grown since it was listed
                return None, f"file too large: more than {max_bytes} bytes"
            return content, None
        except Exception as failure:  # noqa: BLE001 - one file never ends the others
            return None, f"unreadable file: {failure}"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for given in batch.to_pylist():
                content, error = row(given["source_file"], given["size"], given["error"])
                held.append(given | {"content": content, "error": error})
                size += len(content or b"")
                if size >= BATCH_BYTES:
                    yield batch_of(held)
                    held, size = [], 0
            if held:
                yield batch_of(held)

    def batch_of(rows: list[dict]) -> pa.RecordBatch:
        types = pa.schema([
            ("source_file", pa.string()), ("filename", pa.string()), ("size", pa.int64()), ("error", pa.string()), ("content", pa.binary()),
        ])
        return pa.RecordBatch.from_pylist(rows, schema=types)

    return dealt(listed).mapInArrow(task, CONTENTS)


def dealt(listed: DataFrame) -> DataFrame:
    """Listed files in as many parts as their bytes ask for."""
    listed = written(listed.select("source_file", "filename", "size", "error"), "names")
    total, count = listed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    least = int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(count, max(least, -(-total // TASK_BYTES))))
    return listed.repartition(int(parts), F.xxhash64("source_file"))
