"""MATLAB v7.3 files: /Problem/A/jc (offsets) and /Problem/A/ir (neighbours); values don't matter, and the matrix is symmetric."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from ..operators.graph import Graph

EDGES = 4_000_000


def _open(path: str):
    try:
        import h5py
    except ImportError as e:
        raise ImportError("reading .mat files needs the package h5py") from e
    f = h5py.File(path, "r")
    for name in ("Problem", "Problem/A", "Problem/A/jc", "Problem/A/ir"):
        if name not in f:
            raise ValueError(f"{path}: /{name} is missing")
    return f


def read_mat(spark: SparkSession, path: str) -> Graph:
    """The graph of a sparse matrix; executors open the file and read ranges of columns."""
    with _open(path) as f:
        n, m = len(f["Problem/A/jc"]) - 1, len(f["Problem/A/ir"])
    parts = max(1, -(-m // EDGES))
    ranges = spark.createDataFrame([(n * k // parts, n * (k + 1) // parts) for k in range(parts)], "a bigint, b bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with _open(path) as f:
                    offsets = f["Problem/A/jc"][a : b + 1].astype(np.int64)
                    dst = f["Problem/A/ir"][offsets[0] : offsets[-1]].astype(np.int64)
                src = np.repeat(np.arange(a, b, dtype=np.int64), np.diff(offsets))
                yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])

    return Graph.dense(ranges.repartition(parts).mapInArrow(run, "src bigint, dst bigint"), n, symmetric=True)
