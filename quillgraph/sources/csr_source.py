"""`.bin` CSR files as a Spark data source, `spark.read.format("csr")` and the writer behind write_bin().

Reading: options path, block ("out", or "in" for the second block of a dual file) and piece, the edges that a task reads.
Filters on src narrow the range of vertices, and with it the bytes, before tasks are planned.

Writing: rows at, value, width say which number goes where. Each task writes its runs in place, so a task that runs again
writes the same bytes again, and no row passes the driver. The header comes last: a file without it isn't read. The path
must be one that all executors share and write in place (a file system, not an object store).
"""

from __future__ import annotations

import os
import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

#: Edges that one task reads.
PIECE = 1 << 22


def open_file(path: str) -> pa.NativeFile:
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def local_path(path: str) -> str:
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    if not isinstance(system, fs.LocalFileSystem):
        raise ValueError(f"{path}: .bin is written in place, which takes a file system that all machines mount; write_adj writes anywhere")
    return inner


def header(path: str, dual: bool) -> tuple[int, int]:
    """n and m of a file, whose size must be what they give."""
    with open_file(path) as f:
        if f.size() < 24:
            raise ValueError(f"{path}: has {f.size()} bytes")
        n, m, size = struct.unpack("<QQQ", f.read_at(24, 0))
        expected = (n + 1) * 8 + m * 4 + 24
        if size != expected:
            raise ValueError(f"{path}: header says {size} bytes, n and m give {expected}")
        if f.size() != expected * (2 if dual else 1):
            raise ValueError(f"{path}: has {f.size()} bytes")
        if dual and struct.unpack("<QQ", f.read_at(16, expected)) != (n, m):
            raise ValueError(f"{path}: its two blocks differ in n or m")
    return n, m


class _Offsets:
    """The n + 1 offsets of a block, each read where it is asked for."""

    def __init__(self, f: pa.NativeFile, base: int, n: int) -> None:
        self.f, self.base, self.n = f, base, n

    def __len__(self) -> int:
        return self.n + 1

    def __getitem__(self, i: int) -> int:
        return int(self.span(i, i + 1)[0])

    def span(self, i: int, j: int) -> np.ndarray:
        return np.frombuffer(self.f.read_at(8 * (j - i), self.base + 24 + 8 * i), "<u8").astype(np.int64)


class Edges(ds.InputPartition):
    def __init__(self, low: int, high: int) -> None:
        self.low, self.high = low, high


class CsrReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.piece = options["path"], int(options.get("piece", PIECE))
        block = options.get("block", "out")
        dual = options.get("dual", "false") == "true" or block == "in"
        self.n, self.m = header(self.path, dual)
        self.base = (self.n + 1) * 8 + self.m * 4 + 24 if block == "in" else 0
        self.first, self.past = 0, self.n  # vertices

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column != ("src",) or not isinstance(value, int):
                yield f
            elif isinstance(f, ds.EqualTo):
                self.first, self.past = max(self.first, value), min(self.past, value + 1)
            elif isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual)):
                self.first = max(self.first, value + isinstance(f, ds.GreaterThan))
            elif isinstance(f, (ds.LessThan, ds.LessThanOrEqual)):
                self.past = min(self.past, value + isinstance(f, ds.LessThanOrEqual))
            else:
                yield f

    def partitions(self) -> list[Edges]:
        if self.first >= self.past:
            return [Edges(0, 0)]
        with open_file(self.path) as f:
            offsets = _Offsets(f, self.base, self.n)
            low, high = offsets[self.first], offsets[self.past]
        return [Edges(k, min(high, k + self.piece)) for k in range(low, high, self.piece)] or [Edges(0, 0)]

    def read(self, part: Edges) -> Iterator[pa.RecordBatch]:
        low, high = part.low, part.high
        if low == high:
            return
        with open_file(self.path) as f:
            offsets = _Offsets(f, self.base, self.n)
            first, last = bisect_right(offsets, low) - 1, bisect_left(offsets, high)
            own = np.clip(offsets.span(first, last + 1), low, high)
            target = np.frombuffer(f.read_at(4 * (high - low), self.base + 24 + 8 * (self.n + 1) + 4 * low), "<u4").astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(first, last), np.diff(own))), pa.array(target)], names=["src", "dst"])


class Written(ds.WriterCommitMessage):
    def __init__(self, size: int) -> None:
        self.size = size


class CsrWriter(ds.DataSourceArrowWriter):
    """at, value, width of each number, sorted by at within a task. Options: path, headers (at:n:m of each block) and size."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.size = local_path(options["path"]), int(options["size"])
        self.headers = [tuple(map(int, x.split(":"))) for x in options["headers"].split(",")]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        done = 0
        out = os.open(self.path, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for batch in batches:
                at, value, width = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                if not len(at):
                    continue
                cuts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + width[:-1]) | (width[1:] != width[:-1]), True])
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    done += os.pwrite(out, value[i:j].astype("<u8" if width[i] == 8 else "<u4").tobytes(), int(at[i]))
        finally:
            os.close(out)
        return Written(done)

    def commit(self, messages: list[Written]) -> None:
        done = sum(m.size for m in messages if m) + 24 * len(self.headers)
        if done != self.size:
            raise ValueError(f"{self.path}: {done} of {self.size} bytes were written")
        out = os.open(self.path, os.O_WRONLY | os.O_CREAT, 0o644)
        try:
            for at, n, m in self.headers:
                os.pwrite(out, struct.pack("<QQQ", n, m, (n + 1) * 8 + m * 4 + 24), at)
        finally:
            os.close(out)

    def abort(self, messages: list[Written]) -> None:
        if os.path.exists(self.path):
            os.remove(self.path)


class CsrSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "csr"

    def schema(self) -> str:
        return "src long, dst long"

    def reader(self, schema) -> CsrReader:
        return CsrReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> CsrWriter:
        return CsrWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CsrSource)
