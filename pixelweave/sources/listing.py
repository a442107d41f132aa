"""Listing of folder trees in tasks.

A data source with a partition for each folder of the first ``depth`` levels: the
planner only looks for folders there, and each task lists one of them (the
deepest ones with all that is below). Endings are sifted in the tasks, so files
that are not wanted never become rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NAME = "pixelweave_files"


def open_folder(uri: str):
    """(file system, path) of a path or URI that the tasks can reach."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class _Folder(InputPartition):
    def __init__(self, path: str, below: bool):
        self.path, self.below = path, below


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.depth = int(options.get("depth", "1"))
        self.endings = tuple("." + s for s in options.get("suffixes", "").split(",") if s)

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        system, top = open_folder(self.root)
        level, out = [top], []
        if not self.recursive:
            return [_Folder(top, False)]
        for _ in range(self.depth):
            out += [_Folder(p, False) for p in level]
            level = [i.path for p in level for i in system.get_file_info(fs.FileSelector(p)) if i.type == fs.FileType.Directory]
        return out + [_Folder(p, True) for p in level]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        from pyarrow import fs

        system, _ = open_folder(self.root)
        scheme = self.root.split("://")[0] + "://" if "://" in self.root and not self.root.startswith("file:") else ""
        for i in system.get_file_info(fs.FileSelector(partition.path, recursive=partition.below)):
            if i.type == fs.FileType.File and (not self.endings or i.base_name.endswith(self.endings)):
                yield scheme + i.path, i.size


class FileListing(DataSource):
    """Files under a folder. Options: path, recursive (true), depth (1), suffixes (comma-separated, all)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, length bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def list_files(spark: SparkSession, folder: str, recursive: bool = True, depth: int = 1, suffixes: Sequence[str] = ()) -> DataFrame:
    """(path, length) of the files under a folder, listed by tasks. Endings are
    compared as they are spelt, after a dot."""
    spark.dataSource.register(FileListing)
    return spark.read.format(NAME).option("recursive", str(recursive).lower()).option("depth", str(depth)).option(
        "suffixes", ",".join(suffixes)).load(folder)
