"""Binary CSR files: u64 n, u64 m, i64 offsets[n + 1], i32 neighbours[m], little-endian.

The reader is a Python data source whose partitions are ranges of vertices; each reads its slice of the
offsets and of the neighbours.  The file must lie where all executors can open it.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.graph import Graph
from ..plans.ranks import numbered

HEADER = 16
#: Edges of a partition, about.
EDGES = 4_000_000


def _at(f, offset: int, kind: str, count: int) -> np.ndarray:
    f.seek(offset)
    out = np.fromfile(f, kind, count)
    if len(out) != count:
        raise ValueError(f"{f.name}: the file ends early")
    return out


def header(path: str) -> tuple[int, int]:
    with open(path, "rb") as f:
        head = f.read(HEADER)
        if len(head) != HEADER:
            raise ValueError(f"{path}: the file ends early")
        n, m = struct.unpack("<QQ", head)
    if os.path.getsize(path) < HEADER + 8 * (n + 1) + 4 * m:
        raise ValueError(f"{path}: the file ends early")
    return n, m


class _Range(InputPartition):
    def __init__(self, first: int, stop: int):
        self.first, self.stop = first, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.n, self.m = header(path)

    def partitions(self) -> list[_Range]:
        parts = max(1, -(-self.m // EDGES))
        cuts = [self.n * k // parts for k in range(parts + 1)]
        return [_Range(a, b) for a, b in zip(cuts, cuts[1:])]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        with open(self.path, "rb") as f:
            offsets = _at(f, HEADER + 8 * part.first, "<i8", part.stop - part.first + 1)
            begin, count = int(offsets[0]), int(offsets[-1] - offsets[0])
            if (np.diff(offsets) < 0).any() or begin < 0 or begin + count > self.m:
                raise ValueError(f"{self.path}: offsets out of order")
            dst = _at(f, HEADER + 8 * (self.n + 1) + 4 * begin, "<i4", count).astype(np.int64)
        src = np.repeat(np.arange(part.first, part.stop, dtype=np.int64), np.diff(offsets))
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])


class CsrBin(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csrbin"

    def schema(self) -> str:
        return "src bigint, dst bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_csrbin(spark: SparkSession, path: str) -> Graph:
    """The directed graph of a file; neighbours out of range are dropped."""
    n, _ = header(path)
    spark.dataSource.register(CsrBin)
    return Graph.dense(spark.read.format("csrbin").option("path", path).load(), n)


def _write_at(path: str, offset: int, kind: str):
    """Writes (place, value) rows, in runs of places that follow one another, to their places in a file; gives the
    number of values.  A task that runs again writes the same bytes to the same places."""
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        with open(path, "r+b") as f:
            for batch in batches:
                place, value = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(kind)
                begins = np.flatnonzero(np.append(True, np.diff(place) != 1)) if len(place) else []
                for i, j in zip(begins, [*begins[1:], len(place)]):
                    f.seek(offset + width * int(place[i]))
                    f.write(value[i:j].tobytes())
                total += len(place)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64())], ["n"])

    return run


def write_csrbin(graph: Graph, path: str) -> None:
    """Write a graph whose ids are 0 .. n-1.  The file is laid out first, and executors write the ranges of their rows;
    as for reading, it must lie where all of them can open it.  It gets its name when it is whole."""
    n, m = graph.n, graph.m
    ids = graph.vertices.agg(F.min("id").alias("least"), F.max("id").alias("greatest")).first()
    if n and (ids["least"], ids["greatest"]) != (0, n - 1):
        raise ValueError("ids must be 0 .. n-1")
    draft = f"{path}.{uuid.uuid4().hex}"
    with open(draft, "wb") as f:
        f.write(struct.pack("<QQq", n, m, 0))
        f.truncate(HEADER + 8 * (n + 1) + 4 * m)
    ends = graph.row_ptr().select((F.col("id") + 1).alias("place"), "row_end")
    near = numbered(graph.edges.select("src", "dst"), ["src", "dst"], "place").select("place", "dst")
    for rows, offset, kind, wanted in ((ends, HEADER, "<i8", n), (near, HEADER + 8 * (n + 1), "<i4", m)):
        done = rows.mapInArrow(_write_at(draft, offset, kind), "n bigint").agg(F.sum("n")).first()[0] or 0
        if done != wanted:
            os.remove(draft)
            raise ValueError(f"{done} of {wanted} values were written")
    shutil.move(draft, path)


def max_degree_hint(graph: Graph) -> int:
    """The vertex to start from that a generated file names."""
    return graph.degrees().orderBy(F.col("deg").desc(), "id").first()["id"]
