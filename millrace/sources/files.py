"""Files of a folder as a Spark data source, names that begin with '_' or '.' included, on any file system that Arrow opens.

Spark's own file sources leave such names out. Folders are walked level by level until there are enough of them to share out; each
partition then walks its own subtrees (or lists the files of one of the upper folders) in its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from millrace.functions.validate import INPUT_EXTENSIONS, extension

SCHEMA = "path string, size bigint, mtime double"

#: The walk on the driver stops at so many folders, or at the depth below which there are none.
FOLDERS = 256


def _opened(path: str) -> tuple[afs.FileSystem, str, str]:
    """The file system of a path or URI, the path within it, and what stands before such paths."""
    system, inner = afs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else ""


def _below(system: afs.FileSystem, folder: str, deep: bool) -> list[afs.FileInfo]:
    return system.get_file_info(afs.FileSelector(folder, allow_not_found=True, recursive=deep))


class _Subtree(InputPartition):
    def __init__(self, root: str, deep: bool):
        super().__init__(root)
        self.root, self.deep = root, deep


class _Reader(DataSourceReader):
    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def partitions(self) -> list[InputPartition]:
        system, inner, _ = _opened(self.root)
        upper, level = [], [inner]
        while level and len(upper) + len(level) < FOLDERS:
            upper += level
            level = sorted(x.path for folder in level for x in _below(system, folder, False) if x.type == afs.FileType.Directory)
        return [*(_Subtree(p, False) for p in upper), *(_Subtree(p, True) for p in level)]

    def read(self, partition: _Subtree) -> Iterator[tuple]:
        system, _, before = _opened(self.root)
        for x in _below(system, partition.root, partition.deep):
            if x.type == afs.FileType.File:
                yield before + x.path, x.size, (x.mtime_ns or 0) / 1e9


class FolderSource(DataSource):
    """spark.read.format('folder').load(root): (path, size, mtime) of every file below root."""

    @classmethod
    def name(cls) -> str:
        return "folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, mtime) of all supported files below root, whatever the case of their extension."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("folder").load(root).where(extension(F.col("path")).isin(*INPUT_EXTENSIONS))


def _read(path: str) -> bytes | None:
    try:
        system, inner, _ = _opened(path)
        with system.open_input_stream(inner) as f:
            return f.read()
    except OSError:
        return None


def _checksum(path: str) -> str | None:
    try:
        system, inner, _ = _opened(path)
        md5 = hashlib.md5(usedforsecurity=False)
        with system.open_input_stream(inner) as f:
            while block := f.read(1 << 20):
                md5.update(block)
        return md5.hexdigest()
    except OSError:
        return None


def _fields(rows: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)


def with_checksums(files: DataFrame) -> DataFrame:
    """files with the column checksum (MD5 of the bytes, read block by block); null for a file that cannot be read."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.array([_checksum(p) for p in batch.column("path").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, sums], names=[*batch.schema.names, "checksum"])

    return files.mapInArrow(load, f"{_fields(files)}, checksum string")


def with_data(files: DataFrame) -> DataFrame:
    """files with the columns data and checksum (MD5 of the bytes); both null for a file that cannot be read.

    A row holds a whole file, which its parser needs; each goes on its own, so that a task holds one at a time.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                data = _read(row.column("path")[0].as_py())
                md5 = None if data is None else hashlib.md5(data, usedforsecurity=False).hexdigest()
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary()), pa.array([md5], pa.string())], names=[*row.schema.names, "data", "checksum"])

    return files.mapInArrow(load, f"{_fields(files)}, data binary, checksum string")
