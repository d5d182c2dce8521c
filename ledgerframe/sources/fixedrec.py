"""The `fixedrec` data source: files of fixed (FB) and varying (VB) records, read in byte ranges and written with a commit.

Options: recordLength; format FB or VB; partial pad or drop (a last record that is short); blank, the padding byte (32, or 64 for EBCDIC);
split, the bytes of a partition. Rows: rrn (the record's number over all files in name order, from 1; FB only, else null) and value.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "rrn bigint, value binary"
#: Records of one Arrow batch, at most this many bytes of them.
CHUNK = 4 << 20


def resolved(spark: SparkSession, path: str) -> str:
    """The path with its file system, the cluster's default one if it names none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a resolved path, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), path) if path.startswith("/") or "://" not in path else pafs.FileSystem.from_uri(path)


def listed(path: str) -> list[tuple[str, int]]:
    """A file, or the files of a folder in name order, hidden ones left out, with their sizes."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == pafs.FileType.File else [f for f in fs.get_file_info(pafs.FileSelector(at)) if f.type == pafs.FileType.File]
    return sorted((f.path, f.size) for f in found if len(found) == 1 or not f.base_name.startswith((".", "_")))


@dataclass
class Range(InputPartition):
    path: str
    start: int
    length: int
    first: int | None


@dataclass
class Written(WriterCommitMessage):
    name: str
    partition: int


class FixedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.length = options["path"], int(options.get("recordlength", 0))
        self.varying, self.drop = options.get("format", "FB").upper() == "VB", options.get("partial", "pad") == "drop"
        self.blank, self.split = bytes([int(options.get("blank", 32))]), int(options.get("split", 64 << 20))
        if not self.varying and self.length < 1:
            raise ValueError("recordLength is missing")

    def partitions(self) -> list[Range]:
        out, number = [], 1
        for path, size in listed(self.path):
            if self.varying:  # only a walk from the start finds records
                out.append(Range(path, 0, size, None))
                continue
            step = max(self.split // self.length, 1) * self.length
            out += [Range(path, at, min(step, size - at), number + at // self.length) for at in range(0, size, step)]
            number += size // self.length + (0 if self.drop else size % self.length > 0)
        return out or [Range("", 0, 0, None)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.length:
            return
        fs, _ = opened(self.path)
        with fs.open_input_file(partition.path) as f:
            f.seek(partition.start)
            for values, first in self._varying(f, partition) if self.varying else self._fixed(f, partition):
                numbers = pa.nulls(len(values), pa.int64()) if first is None else pa.array(range(first, first + len(values)), pa.int64())
                yield pa.RecordBatch.from_arrays([numbers, pa.array(values, pa.binary())], ["rrn", "value"])

    def _fixed(self, f: pa.NativeFile, partition: Range) -> Iterator[tuple[list[bytes], int]]:
        n, left, number = self.length, partition.length, partition.first
        while left > 0:
            data = f.read(min(left, max(CHUNK // n, 1) * n))
            if not data:
                raise OSError(f"{partition.path} became shorter while it was read")
            left -= len(data)
            values = [data[i : i + n] for i in range(0, len(data), n)]
            if len(values[-1]) < n:
                values = values[:-1] if self.drop else [*values[:-1], values[-1].ljust(n, self.blank)]
            if values:
                yield values, number
            number += len(values)

    def _varying(self, f: pa.NativeFile, partition: Range) -> Iterator[tuple[list[bytes], None]]:
        values, held, left = [], 0, partition.length
        while left >= 4:
            n = int.from_bytes(f.read(4)[:2], "big")
            if n < 4:
                raise ValueError(f"a record descriptor of {n} bytes {left} bytes before the end of {partition.path}")
            data = f.read(n - 4)
            left, held = left - n, held + n
            values.append(data.ljust(self.length, self.blank))
            if held >= CHUNK:
                yield values, None
                values, held = [], 0
        if values:
            yield values, None


class FixedWriter(DataSourceArrowWriter):
    """Tasks write hidden files; the commit on the driver gives them their names, in the order of partitions."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.length, self.overwrite = options["path"], int(options.get("recordlength", 0)), overwrite
        self.varying, self.blank = options.get("format", "FB").upper() == "VB", bytes([int(options.get("blank", 32))])
        if not self.varying and self.length < 1:
            raise ValueError("recordLength is missing")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        name = f".part-{uuid.uuid4().hex}"
        with fs.open_output_stream(posixpath.join(at, name)) as f:
            for batch in iterator:
                values = batch.column("value").cast(pa.binary())
                size = pc.binary_length(values).fill_null(0)
                if self.varying:
                    if batch.num_rows and (most := pc.max(size).as_py()) > 32756:
                        raise ValueError(f"a varying record of {most} bytes")
                    f.write(b"".join(x for v in values.fill_null(b"").to_pylist() for x in ((len(v) + 4).to_bytes(2, "big") + b"\0\0", v)))
                elif batch.num_rows and pc.all(pc.equal(size, self.length)).as_py() and not values.null_count:
                    offsets = values.buffers()[1]
                    first = np.frombuffer(offsets, np.int32, batch.num_rows + 1, 4 * values.offset)
                    f.write(values.buffers()[2].slice(int(first[0]), int(first[-1] - first[0])))  # the records as they stand in memory
                else:
                    f.write(b"".join(v[: self.length].ljust(self.length, self.blank) for v in values.fill_null(b"").to_pylist()))
        return Written(name, TaskContext.get().partitionId())

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        old = [p for p, _ in listed(self.path) if not posixpath.basename(p).startswith(".")]
        # Appended parts sort behind what is there; an overwrite drops the old files last.
        names = [int(m[1]) for p in old if (m := re.search(r"part-(\d{6})-", p))]
        group = max(names, default=-1) + 1
        for m in sorted((m for m in messages if m), key=lambda m: m.partition):
            fs.move(posixpath.join(at, m.name), posixpath.join(at, f"part-{group:06}-{m.partition:06}"))
        for p in old if self.overwrite else ():
            fs.delete_file(p)

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        for m in messages:
            if m and fs.get_file_info(posixpath.join(at, m.name)).type == pafs.FileType.File:
                fs.delete_file(posixpath.join(at, m.name))


class FixedRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fixedrec"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FixedReader:
        return FixedReader(self.options)

    def writer(self, schema, overwrite: bool) -> FixedWriter:
        return FixedWriter(self.options, overwrite)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(FixedRecords)
    return spark
