"""A stream of status files that are written anew in place: Spark's file source knows a path once only, this one knows it by when it was written."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: One row for each state of a file: where it is, when it was written (nanoseconds), and what it holds.
ROW = "path string, written long, value string"


def folder_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder: a local path, or a URI of any scheme that Arrow reads (file, hdfs, s3, gs, abfs)."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class OneState(InputPartition):
    path: str
    mark: list[int]

    def __init__(self, path: str, mark: list[int]):
        super().__init__((path, mark))
        self.path, self.mark = path, mark


def _mark(info: fs.FileInfo) -> list[int]:
    return [info.mtime_ns, info.size]


class StatusFileReader(DataSourceStreamReader):
    """An offset holds, for every file, when it was last written and its size: an entry a run. A batch holds the files that are new or changed since the last one, a partition each.

    A file that is written again before its partition is read gives no row then, for its newer state has an offset of its own: so no state comes twice, also after a restart, and the newest always comes.
    States that were replaced before anyone looked are gone.
    """

    def __init__(self, uri: str, suffix: str):
        self.uri, self.suffix = uri, suffix

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        store, path = folder_of(self.uri)
        found = store.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
        return {i.path: _mark(i) for i in sorted(found, key=lambda i: i.path) if i.type == fs.FileType.File and i.base_name.endswith(self.suffix) and not i.base_name.startswith((".", "_"))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [OneState(path, mark) for path, mark in end.items() if start.get(path) != mark]

    def read(self, partition: OneState) -> Iterator[tuple]:
        store, _ = folder_of(self.uri)
        now = lambda: store.get_file_info(partition.path)
        if now().type != fs.FileType.File or _mark(now()) != list(partition.mark):
            return
        with store.open_input_stream(partition.path) as f:
            value = f.read().decode("utf-8", "replace")
        if now().type == fs.FileType.File and _mark(now()) == list(partition.mark):
            yield partition.path, partition.mark[0], value


class StatusFiles(DataSource):
    """Format `status_files`; options path (a folder) and suffix."""

    @classmethod
    def name(cls) -> str:
        return "status_files"

    def schema(self) -> str:
        return ROW

    def streamReader(self, schema) -> StatusFileReader:  # noqa: ANN001, N802
        return StatusFileReader(self.options["path"], self.options.get("suffix", ".json"))
