"""Log files as a Spark data source, ``event_log``: tables are read in byte ranges, streams go on where a file has grown.

    spark.dataSource.register(EventLog)
    spark.readStream.format("event_log").load("/logs")          # value, file, position

A file that is appended to is read from where the last batch ended, which Spark's own file stream, made for whole
files, cannot do. An offset is the end of the last whole line of each file; Spark keeps it in the checkpoint, so a
stream that starts again loses no line and repeats none.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from levelstream.operators import events as E

from .logs import parse_with, write_log

#: Bytes of a partition; a task holds as many, and its last line.
SPLIT = 32 << 20
_BLOCK = 1 << 16
_SCHEMA = "value string, file string, position long"


@dataclass
class Range(InputPartition):
    """The lines of a file that start at or after ``begin`` and before ``end``."""

    path: str
    begin: int
    end: int


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def _sizes(folder: str) -> dict[str, int]:
    """The files of a folder by name; marks and hidden files are left out."""
    system, path = _system(folder)
    return {f.base_name: f.size for f in system.get_file_info(fs.FileSelector(path)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))}


def _whole_lines(folder: str, name: str, size: int) -> int:
    """Where the last whole line of a file ends."""
    system, path = _system(folder)
    with system.open_input_file(f"{path}/{name}") as f:
        while size:
            low = max(0, size - _BLOCK)
            f.seek(low)
            at = f.read(size - low).rfind(b"\n")
            if at >= 0:
                return low + at + 1
            size = low
    return 0


def _ranges(folder: str, name: str, begin: int, end: int, split: int) -> list[Range]:
    return [Range(f"{folder.rstrip('/')}/{name}", at, min(end, at + split)) for at in range(begin, end, split)]


def lines_in(part: Range) -> Iterator[tuple[bytes, int]]:
    """(line, position) of a range. A line that goes on beyond its end is read whole."""
    system, path = _system(part.path)
    with system.open_input_file(path) as f:
        # The byte before tells whether a line starts at ``begin``.
        f.seek(max(0, part.begin - 1))
        data, at = f.read(part.end - max(0, part.begin - 1)), part.begin
        if part.begin:
            cut = data.find(b"\n")
            if cut < 0:
                return
            data, at = data[cut + 1 :], part.begin + cut
        if not data:
            return
        tail = [data]
        while not tail[-1].endswith(b"\n"):
            more = f.read(_BLOCK)
            if not more:
                break
            tail.append(more[: more.find(b"\n") + 1 or len(more)])
    lines = b"".join(tail).split(b"\n")
    for line in lines if lines[-1] else lines[:-1]:
        yield line, at
        at += len(line) + 1


def _batches(part: Range) -> Iterator[pa.RecordBatch]:
    held: list[tuple[str, int]] = []

    def made() -> pa.RecordBatch:
        values, positions = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(values), pa.array([part.path] * len(held)), pa.array(positions, pa.int64())], ["value", "file", "position"])

    for line, at in lines_in(part):
        held.append((line.removesuffix(b"\r").decode("utf-8", "replace"), at))
        if len(held) == 10_000:
            yield made()
            held.clear()
    if held:
        yield made()


class _Table(DataSourceReader):
    def __init__(self, folder: str, split: int):
        self.folder, self.split = folder, split

    def partitions(self) -> list[Range]:
        return [r for name, size in sorted(_sizes(self.folder).items()) for r in _ranges(self.folder, name, 0, size, self.split)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return _batches(part) if part.path else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str, split: int):
        self.folder, self.split, self.known = folder, split, {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """What has been seen to be whole is not looked for again while a file keeps its size."""
        for name, size in _sizes(self.folder).items():
            if self.known.get(name, (None, 0))[0] != size:
                self.known[name] = (size, _whole_lines(self.folder, name, size))
        return {name: end for name, (_, end) in sorted(self.known.items()) if end}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        shorter = [name for name, at in start.items() if end.get(name, at) < at]
        if shorter:
            raise ValueError(f"log files only grow, but {shorter[0]} is shorter than what was read of it")
        return [r for name, at in end.items() for r in _ranges(self.folder, name, start.get(name, 0), at, self.split)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return _batches(part)

    def commit(self, end: dict) -> None:
        pass


class EventLog(DataSource):
    """Lines of the files of a folder, with their file and the byte where they start.

    Option ``split`` is the bytes of a partition. Files are uncompressed UTF-8; bytes that are none become the
    replacement character. A table holds a last line without its end, a stream waits for it. Files of a stream only
    grow, and may come and go; its offset has an entry for each, so rotate them into other folders.
    """

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return _SCHEMA

    def _where(self) -> tuple[str, int]:
        return self.options["path"], int(self.options.get("split", SPLIT))

    def reader(self, schema) -> _Table:
        return _Table(*self._where())

    def streamReader(self, schema) -> _Stream:
        return _Stream(*self._where())


def read_lines(spark: SparkSession, folder: str, streaming: bool = False, split: int = SPLIT) -> DataFrame:
    spark.dataSource.register(EventLog)
    return (spark.readStream if streaming else spark.read).format("event_log").option("split", split).load(folder)


def replay(spark: SparkSession, folder: str, streaming: bool = False, split: int = SPLIT) -> DataFrame:
    """The events of the logs of a folder, as a table or a stream; lines that are no events and shut-downs are dropped."""
    events = parse_with(read_lines(spark, folder, streaming, split), ["file", "position"])
    return events.where("event_code is not null and device_time is not null").where(F.col("event_code") != E.SHUT_DOWN)


def written(events: DataFrame) -> str:
    """The folder of a new log of ``events``: in ``spark.checkpoint.dir``, or on this machine for a local master."""
    spark = events.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = f"{shared or tempfile.gettempdir()}/levelstream/log-{uuid.uuid4().hex}"
    write_log(events, folder)
    return folder
