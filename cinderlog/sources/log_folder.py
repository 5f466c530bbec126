"""A data source for folders of many small logs: `spark.read.format("cinderlog")`, and the same as a stream.

Files are planned into tasks by their bytes, so a folder of very many small logs takes few tasks; a file is one log, whatever its size, and
is never split. Filters on `path` (equal, in, starts with) are applied to the listing, so other files aren't opened.
The stream hands on each file once, in order of the time it was last changed and its path; files are expected to be
complete when they appear, and a batch takes at most `maxBytesPerBatch`.

Options: path (a folder or a glob of one level), maxPartitionBytes (default 128 MB), maxBytesPerBatch (default 4 GB), and
pathSuffix (default .log). Paths are of file systems that pyarrow opens.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

SCHEMA = "path string, bytes long, raw_log string"
_ARROW = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("raw_log", pa.string())])


@dataclass
class Files(InputPartition):
    """Paths and sizes of a task's files."""

    files: list[tuple[str, int]]


def listed(path: str, suffix: str) -> list[tuple[int, str, int]]:
    """(time of the last change in ns, path, bytes) of a folder's files, in that order."""
    system, folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    base, _, pattern = folder.rpartition("/") if any(x in folder for x in "*?[") else (folder, "", "*")
    infos = system.get_file_info(fs.FileSelector(base, recursive=pattern == "*", allow_not_found=True))
    found = [x for x in infos if x.type == fs.FileType.File and x.base_name.endswith(suffix) and fnmatch.fnmatchcase(x.base_name, pattern)]
    return sorted((x.mtime_ns, x.path, x.size) for x in found)


def planned(files: list[tuple[str, int]], most: int) -> list[Files]:
    """Files in tasks of at most `most` bytes; a larger file is a task by itself. Largest first, each to the emptiest task that has room."""
    import heapq

    tasks: list[Files] = []
    heap: list[tuple[int, int]] = []
    for path, size in sorted(files, key=lambda x: (-x[1], x[0])):
        weight = size + 4096  # opening a file costs, too
        if heap and heap[0][0] + weight <= most:
            load, i = heapq.heappop(heap)
        else:
            load, i = 0, len(tasks)
            tasks.append(Files([]))
        tasks[i].files.append((path, size))
        heapq.heappush(heap, (load + weight, i))
    return tasks


def rows(path: str, part: Files) -> Iterator[pa.RecordBatch]:
    """A batch for each file, so that a task holds one log at a time."""
    system = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
    for name, size in part.files:
        with system.open_input_stream(name) as stream:
            text = stream.read().decode("utf-8", "replace")
        yield pa.RecordBatch.from_pydict({"path": [name], "bytes": [size], "raw_log": [text]}, schema=_ARROW)


class _Options:
    def __init__(self, options: dict) -> None:
        self.path, self.suffix = options["path"], options.get("pathSuffix", ".log")
        self.most, self.batch = int(options.get("maxPartitionBytes", 128 << 20)), int(options.get("maxBytesPerBatch", 4 << 30))


class Reader(DataSourceReader):
    def __init__(self, options: _Options) -> None:
        self.options, self.wanted = options, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for x in filters:
            if isinstance(x, (EqualTo, In, StringStartsWith)) and x.attribute == ("path",):
                self.wanted.append(x)
            else:
                yield x

    def _has(self, path: str) -> bool:
        tests = {EqualTo: lambda v: path == v, In: lambda v: path in v, StringStartsWith: path.startswith}
        return all(tests[type(x)](x.value) for x in self.wanted)

    def partitions(self) -> list[Files]:
        files = [(p, n) for _, p, n in listed(self.options.path, self.options.suffix) if self._has(p)]
        return planned(files, self.options.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return rows(self.options.path, partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are the last file handed on: its time and path."""

    def __init__(self, options: _Options) -> None:
        self.options, self.last = options, {"at": -1, "path": ""}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": -1, "path": ""}

    def _after(self, start: dict) -> list[tuple[int, str, int]]:
        return [x for x in listed(self.options.path, self.options.suffix) if x[:2] > (start["at"], start["path"])]

    def latestOffset(self) -> dict:  # noqa: N802
        total = 0
        for at, path, size in self._after(self.last):
            if total and total + size > self.options.batch:
                break
            total, self.last = total + size, {"at": at, "path": path}
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Files]:
        self.last = max(self.last, end, key=lambda x: (x["at"], x["path"]))
        return planned([(p, n) for at, p, n in self._after(start) if (at, p) <= (end["at"], end["path"])], self.options.most)

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return rows(self.options.path, partition)

    def commit(self, end: dict) -> None:
        pass


class LogFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cinderlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(_Options(self.options))

    def streamReader(self, schema: StructType) -> StreamReader:  # noqa: N802
        return StreamReader(_Options(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, filters on paths included."""
    from cinderlog.workers import workers_find_package

    workers_find_package(spark)
    spark.dataSource.register(LogFolder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
