"""Archives of arrays (.npz) as a data source: ``spark.read.format("npz").load(path)``.

An archive holds an array ``layer_<k>`` for each layer, a row for each task. The driver reads the headers only; every
array is cut into ranges of rows, and tasks read those. In a plain archive a task goes straight to its rows; in a
compressed one it has to unpack those before them, without holding more than one portion.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and of the portion of it that is held at once.
RANGE_BYTES, PORTION_BYTES = 32 << 20, 4 << 20
_NAME = re.compile(r"layer_(\d+)\.npy")
SCHEMA = "layer_idx INT, row BIGINT, act ARRAY<FLOAT>"


@dataclass
class Header:
    layer: int
    member: str
    shape: tuple[int, ...]
    dtype: np.dtype
    columns_first: bool
    #: Where the numbers begin in the member.
    offset: int

    @property
    def width(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64))


def opened(path: str) -> zipfile.ZipFile:
    """The archive, from any store that Arrow can open; a path without a scheme is a local one."""
    if "://" in path or path.startswith("file:"):
        system, at = fs.FileSystem.from_uri(path)
    else:
        system, at = fs.LocalFileSystem(), path
    return zipfile.ZipFile(system.open_input_file(at))


def headers(archive: zipfile.ZipFile) -> list[Header]:
    """Of all members named layer_<k>, in the order of k. Others are left out."""
    out = []
    for info in archive.infolist():
        if m := _NAME.fullmatch(info.filename):
            with archive.open(info) as f:
                version = np.lib.format.read_magic(f)
                read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                shape, columns_first, dtype = read(f)
                if len(shape) < 1 or dtype.hasobject:
                    raise ValueError(f"{info.filename}: rows of numbers are wanted, not {dtype} {shape}")
                out.append(Header(int(m[1]), info.filename, shape, dtype, columns_first and len(shape) > 1, f.tell()))
    return sorted(out, key=lambda h: h.layer)


@dataclass
class Range(InputPartition):
    member: str
    start: int
    stop: int


def rows(archive: zipfile.ZipFile, h: Header, start: int, stop: int) -> Iterator[tuple[int, np.ndarray]]:
    """Portions of the rows from start to stop: number of the first, and a matrix."""
    if h.columns_first:
        # Rows lie scattered over the member: it is read whole.
        with archive.open(h.member) as f:
            whole = np.lib.format.read_array(f, allow_pickle=False).reshape(h.shape[0], -1)
        yield start, whole[start:stop]
        return
    size = max(1, h.width * h.dtype.itemsize)
    step = max(1, PORTION_BYTES // size)
    with archive.open(h.member) as f:
        f.seek(h.offset + start * size)
        for lo in range(start, stop, step):
            hi = min(lo + step, stop)
            data = f.read((hi - lo) * size) if h.width else b""
            yield lo, np.frombuffer(data, h.dtype, (hi - lo) * h.width).reshape(hi - lo, h.width)


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[InputPartition]:
        """At least two ranges of every array with two rows."""
        out: list[InputPartition] = []
        with opened(self.path) as archive:
            for h in headers(archive):
                n = h.shape[0]
                step = max(1, min(-(-n // 2), self.range_bytes // max(1, h.width * h.dtype.itemsize)))
                out += [Range(h.member, lo, min(lo + step, n)) for lo in range(0, n, step)]
        # An archive without rows still has a partition, which finds none.
        return out or [Range("", 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        assert isinstance(partition, Range)
        with opened(self.path) as archive:
            for h in headers(archive):
                if h.member == partition.member:
                    for first, part in rows(archive, h, partition.start, partition.stop):
                        n = len(part)
                        act = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * h.width), pa.array(np.ascontiguousarray(part, np.float32).ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, h.layer, np.int32)), pa.array(np.arange(first, first + n)), act], names=["layer_idx", "row", "act"])


class Archive(DataSource):
    """Options: path; rangeBytes, the bytes of a task's rows."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return ArchiveReader(self.options["path"], int(self.options.get("rangebytes", RANGE_BYTES)))


def read_npz(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """layer_idx, row and act of an archive."""
    spark.dataSource.register(Archive)
    return spark.read.format("npz").options(**options).load(path)


def lengths(path: str) -> dict[int, int]:
    """Rows of each layer, from the headers."""
    with opened(path) as archive:
        return {h.layer: h.shape[0] for h in headers(archive)}
