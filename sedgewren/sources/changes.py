"""Files that were added, changed and removed below a directory, as a streaming source.

An offset is a listing: path, length and time of each file. So a batch is the difference of two listings, a stream that is
started again from its checkpoint finds what happened meanwhile, and its first batch has all files as added.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sedgewren.sources.kb import FORMATS

SCHEMA = "directory string, path string, change string, length bigint, modified_ms bigint"
#: Changes that one task gives.
CHANGES_AT_ONCE = 10_000


def listing(root: str, recursive: bool = False) -> dict[str, list[int]]:
    """Length and time in milliseconds of the files of known formats in root and its folders, one level deep unless
    recursive, by path. Files that go meanwhile may be missing; a root that is not there has none."""
    system, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    base, found = base.rstrip("/"), {}
    for level in ("",) if recursive else ("", *(f.path for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)) if f.type == fs.FileType.Directory)):
        for f in system.get_file_info(fs.FileSelector(level or base, allow_not_found=True, recursive=recursive)):
            if f.type == fs.FileType.File and f.extension.lower() in FORMATS:
                found[f.path] = [f.size, (f.mtime_ns or 0) // 1_000_000]
    return found


def differences(before: dict[str, list[int]], after: dict[str, list[int]]) -> Iterator[tuple[str, str, int, int]]:
    """path, change, length, modified_ms; of a removed file what it was."""
    for path in sorted(before.keys() | after.keys()):
        if path not in before:
            yield path, "added", *after[path]
        elif path not in after:
            yield path, "removed", *before[path]
        elif before[path] != after[path]:
            yield path, "changed", *after[path]


@dataclass
class Changes(InputPartition):
    rows: list[tuple]


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str, recursive: bool):
        self.root, self.recursive = root, recursive

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        return {"files": listing(self.root, self.recursive)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        rows = [(self.root, *d) for d in differences(start["files"], end["files"])]
        return [Changes(rows[i : i + CHANGES_AT_ONCE]) for i in range(0, len(rows), CHANGES_AT_ONCE)] or [Changes([])]

    def read(self, partition: Changes) -> Iterator[tuple]:
        yield from partition.rows

    def commit(self, end: dict) -> None:
        pass


class DirectoryChanges(DataSource):
    """Options: root, and recursive (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "directory_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["root"], self.options.get("recursive", "false") == "true")


def changes(spark: SparkSession, root: str, recursive: bool = False):
    """The changes below root as a stream."""
    spark.dataSource.register(DirectoryChanges)
    return spark.readStream.format("directory_changes").option("root", root).option("recursive", str(recursive).lower()).load()
