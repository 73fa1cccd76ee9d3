"""Sources of compressed files.

raw_streams reads whole files with Spark's reader and decodes them. The Python data source chunked_deflate reads containers
by their own index: a partition is a range of a file's bytes, whose task seeks the footer and the indexes and inflates the
chunks that begin in its range; a filter on chunk_id or the raw offsets prunes chunks before any is read. Paths are those of
Arrow's file systems (local, hdfs, s3, gs, and so on, as its build has them); raw_streams takes any that Spark's readers take.
"""

from __future__ import annotations

import fnmatch
import os
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..functions import container
from ..operators.codecs import MOST, decode

SCHEMA = "file string, chunk_id int, raw_start long, raw_end long, raw binary"
#: Bytes of a file that one task reads, about.
PARTITION = 32 << 20


def raw_streams(spark: SparkSession, path: str, codec: str, pattern: str = "*", most: int = MOST) -> DataFrame:
    """file and result of every file below path: raw DEFLATE too, which Spark's text reader can't read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return found.select(F.col("path").alias("file"), decode(F.col("content"), codec, most).alias("result"))


def as_text(result: Column) -> Column:
    return F.decode(result["raw"], "UTF-8")


@dataclass
class Chunks(InputPartition):
    """The chunks of a file that begin in a range of its bytes."""

    file: str
    size: int
    first: int
    last: int


def _system(path: str) -> tuple[files.FileSystem, str]:
    """Arrow's file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return files.FileSystem.from_uri(path)
    return files.LocalFileSystem(), os.path.abspath(path)


def _listed(path: str) -> list[files.FileInfo]:
    """The containers at a path: one file, those of a folder, or those whose names fit a pattern."""
    system, inside = _system(path)
    found = system.get_file_info(inside)
    if found.type == files.FileType.File:
        return [found]
    folder, pattern = (inside, "*.xf") if found.type == files.FileType.Directory else posixpath.split(inside)
    below = system.get_file_info(files.FileSelector(folder, allow_not_found=True))
    return sorted((x for x in below if x.type == files.FileType.File and fnmatch.fnmatchcase(x.base_name, pattern)), key=lambda x: x.path)


def _records(f: pa.NativeFile, size: int) -> list[tuple[int, int, int, int, int]]:
    """chunk_id, comp_start, comp_end, raw_start, raw_end of each chunk. Only the footer and the indexes are read."""

    def read(start: int, end: int) -> bytes:
        f.seek(start)
        return f.read(end - start)

    out, before = [], container.Record(0, 0, 0)
    for r in container.open_index(read, size):
        if r.type == container.DEFLATE:
            out.append((len(out), before.comp_end, r.comp_end, before.raw_end, r.raw_end))
        before = r
    return out


class ChunkedReader(DataSourceReader):
    def __init__(self, path: str, size: int = PARTITION):
        self.path, self.size, self.tests = path, size, []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        place = {"chunk_id": 0, "raw_start": 3, "raw_end": 4}
        tests = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        for f in filters:
            if type(f) in tests and f.attribute[0] in place and len(f.attribute) == 1:
                self.tests.append((place[f.attribute[0]], type(f).__name__, f.value))
            else:
                yield f

    def _wanted(self, row) -> bool:
        for k, name, value in self.tests:
            x = row[k]
            if not {"EqualTo": x == value, "GreaterThan": x > value, "GreaterThanOrEqual": x >= value, "LessThan": x < value, "LessThanOrEqual": x <= value}[name]:
                return False
        return True

    def partitions(self) -> list[Chunks]:
        return [Chunks(x.path, x.size, at, at + self.size) for x in _listed(self.path) for at in range(0, max(x.size, 1), self.size)]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("file", pa.string()), ("chunk_id", pa.int32()), ("raw_start", pa.int64()), ("raw_end", pa.int64()), ("raw", pa.binary())])
        with _system(self.path)[0].open_input_file(partition.file) as f:
            for row in _records(f, partition.size):
                chunk_id, start, end, raw_start, raw_end = row
                if not partition.first <= start < partition.last or not self._wanted(row):
                    continue
                f.seek(start)
                raw = container.inflate_chunk(f.read(end - start), raw_end - raw_start)
                yield pa.RecordBatch.from_pylist([{"file": partition.file, "chunk_id": chunk_id, "raw_start": raw_start, "raw_end": raw_end, "raw": raw}], schema=schema)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ChunkedWriter(DataSourceWriter):
    """Writes each partition's rows (one binary column) as one container file; files appear under their names at commit."""

    def __init__(self, path: str, chunk: int, index: int, level: int):
        self.path, self.chunk, self.index, self.level = path, chunk, index, level

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, folder = _system(self.path)
        system.create_dir(folder, recursive=True)
        name = posixpath.join(folder, f".part-{context.partitionId():05d}-{context.taskAttemptId()}")
        made, held = container.Writer(self.index), bytearray()
        for row in rows:
            held += row[0]
            while len(held) > self.chunk:
                made.chunk(container.compress_chunk(bytes(held[: self.chunk]), self.level), self.chunk)
                del held[: self.chunk]
        if held:
            made.chunk(container.compress_chunk(bytes(held), self.level), len(held))
        with system.open_output_stream(name) as f:
            f.write(made.close())
        return Written([name])

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for name in m.files if m else []:
                folder, base = posixpath.split(name)
                _system(self.path)[0].move(name, posixpath.join(folder, base[1:].rsplit("-", 1)[0] + ".xf"))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for name in m.files if m else []:
                _system(self.path)[0].delete_file(name)


class ChunkedDeflate(DataSource):
    """Options: path (a file, folder or pattern); for writing also chunkSize, indexSize and level, 0 for the defaults."""

    @classmethod
    def name(cls) -> str:
        return "chunked_deflate"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ChunkedReader:
        return ChunkedReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> ChunkedWriter:
        path, chunk = self.options["path"], int(self.options.get("chunkSize", 0))
        if chunk < 0:
            raise ValueError("chunkSize is negative")
        system, folder = _system(path)
        if overwrite and system.get_file_info(folder).type == files.FileType.Directory:
            for found in _listed(path):
                system.delete_file(found.path)
        return ChunkedWriter(path, chunk or container.DEFAULT_CHUNK, int(self.options.get("indexSize", 0)), int(self.options.get("level", 0)))


def register(spark: SparkSession) -> None:
    """Makes format("chunked_deflate") known, with filter pushdown."""
    spark.dataSource.register(ChunkedDeflate)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
