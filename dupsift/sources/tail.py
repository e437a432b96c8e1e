"""The last lines of log files as a data source: spark.read.format("tail").

Each file is a task that reads byte ranges from the file's end, never more than MOST_BYTES, and gives its last lines in order. Files are opened with
pyarrow's file systems, by URI or local path.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Lines that are given at most and unless told otherwise, bytes that are read of a file at most, and at once.
MOST_LINES, LINES, MOST_BYTES, RANGE_BYTES = 400, 200, 64 << 10, 8 << 10


def last_lines(source, size: int, lines: int) -> tuple[list[str], int]:
    """The last lines of a random-access file of `size` bytes, and how many bytes were read. A line longer than MOST_BYTES is cut at its beginning."""
    data, at = b"", size
    floor = max(0, size - MOST_BYTES)
    while at > floor and data.count(b"\n") <= lines:
        step = min(RANGE_BYTES, at - floor)
        source.seek(at - step)
        data, at = source.read(step) + data, at - step
    parts = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
    if parts[-1] == b"":
        parts.pop()
    return [p.decode("utf-8", "replace") for p in parts[max(0, len(parts) - lines) :]], size - at


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.lines = options["path"], max(1, min(MOST_LINES, int(options.get("lines", LINES))))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, inner = _system(self.path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == fs.FileType.File:
            return [_File(self.path)]
        found = sorted(x.path for x in system.get_file_info(fs.FileSelector(inner)) if x.type == fs.FileType.File)
        return [_File(self.path.rstrip("/") + "/" + x.rsplit("/", 1)[-1]) for x in found]

    def read(self, partition: _File) -> Iterator[tuple]:
        system, inner = _system(partition.path)
        size = system.get_file_info(inner).size
        with system.open_input_file(inner) as f:
            lines, read = last_lines(f, size, self.lines)
        for i, line in enumerate(lines):
            yield partition.path, i - len(lines), line, read


class TailSource(DataSource):
    """Options: path (a file or a folder of files), lines (1 to MOST_LINES)."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "path string, line_from_end int, line string, bytes_read bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TailSource)
