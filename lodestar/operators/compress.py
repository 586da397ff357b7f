"""Adjacency rows as deltas in LEB128, and traversal over them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import byte_class, varint_length
from ..plans.ranks import numbered, previous, running_sum
from ..plans.tables import materialise
from .graph import Graph


#: Neighbours in a compressed row.
ROW = 1 << 16


def encode_varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of non-negative integers, and the number of bytes of each."""
    v = values.astype(np.uint64)
    size = np.ones(len(v), np.int64)
    for k in range(1, 9):
        size += v >= np.uint64(1 << 7 * k)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    at, left = ends - size, v.copy()
    for k in range(int(size.max()) if len(size) else 0):
        on = size > k
        more = (size > k + 1)[on]
        out[at[on] + k] = (left[on] & np.uint64(127)).astype(np.uint8) | (more.astype(np.uint8) << 7)
        left >>= np.uint64(7)
    return out, size


def decode_varints(data: np.ndarray) -> np.ndarray:
    """The integers of a byte stream."""
    if not len(data):
        return np.zeros(0, np.int64)
    last = data < 128
    number = np.cumsum(np.append(0, last[:-1]))
    begins = np.append(0, np.flatnonzero(last)[:-1] + 1)
    place = np.arange(len(data)) - begins[number]
    parts = (data & 127).astype(np.uint64) << (7 * place).astype(np.uint64)
    return np.add.reduceat(parts, begins).astype(np.int64)


def deltas(graph: Graph) -> DataFrame:
    """(src, dst, delta): each neighbour less the one before it in its sorted row; the first one as it is."""
    rows = previous(graph.edges.select("src", "dst"), ["src", "dst"], "before")
    first = ~F.col("before.src").eqNullSafe(F.col("src"))
    return rows.select("src", "dst", F.when(first, F.col("dst")).otherwise(F.col("dst") - F.col("before.dst")).alias("delta"))


def row_bytes(graph: Graph) -> DataFrame:
    """(id, n_bytes): the size of each compressed row."""
    sizes = deltas(graph).groupBy(F.col("src").alias("id")).agg(F.sum(varint_length(F.col("delta"))).alias("n_bytes"))
    return graph.vertices.join(sizes, "id", "left").select("id", F.coalesce("n_bytes", F.lit(0)).cast("bigint").alias("n_bytes"))


def byte_offsets(graph: Graph) -> DataFrame:
    """(id, byte_start, byte_end): the places of the rows in one stream."""
    starts = running_sum(row_bytes(graph), ["id"], "n_bytes", "byte_start")
    return starts.select("id", "byte_start", (F.col("byte_start") + F.col("n_bytes")).alias("byte_end"))


def ratio(graph: Graph) -> DataFrame:
    """One row: bytes of 32-bit neighbours, compressed bytes, and their ratio."""
    total = row_bytes(graph).agg(F.sum("n_bytes").alias("compressed_bytes"))
    raw = graph.edges.agg((F.count("*") * 4).alias("raw_bytes"))
    both = raw.join(F.broadcast(total))  # one row each
    return both.select("raw_bytes", "compressed_bytes", (F.col("raw_bytes") / F.col("compressed_bytes")).alias("ratio"))


def fits_in_place(graph: Graph) -> DataFrame:
    """(id, fits): whether each row, written behind the rows before, ends before its own 32-bit neighbours end."""
    return byte_offsets(graph).join(graph.row_ptr(), "id").select("id", (F.col("byte_end") <= F.col("row_end") * 4).alias("fits"))


@dataclass
class CompressedGraph:
    """vertices (id) and adjacency (id, block, deg, n_bytes, adj): a vertex has a row for each ROW of its neighbours."""

    vertices: DataFrame
    adjacency: DataFrame
    symmetric: bool
    n: int

    require = Graph.require

    def neighbours_of(self, frontier: DataFrame) -> DataFrame:
        """(src, dst) of the frontier's vertices: only their rows are decoded."""
        return _decoded(self.adjacency.join(frontier.select("id"), "id", "left_semi"))

    def decoded(self) -> Graph:
        return Graph(self.vertices, _decoded(self.adjacency), self.symmetric, self.n)

    def byte_class_counts(self) -> DataFrame:
        """(byte_class, n): vertices by the size of their compressed neighbours."""
        sizes = self.adjacency.groupBy("id").agg(F.sum("n_bytes").alias("n_bytes"))
        return sizes.groupBy(byte_class(F.col("n_bytes")).alias("byte_class")).agg(F.count("*").alias("n"))


def _decoded(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, deg, adj = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), batch.column(2)
            raw = decode_varints(np.frombuffer(b"".join(adj.to_pylist()), np.uint8))
            sums = np.cumsum(raw)
            ends = np.cumsum(deg)
            before = np.where(ends > deg, sums[np.maximum(ends - deg - 1, 0)] if len(sums) else 0, 0)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, deg)), pa.array(sums - np.repeat(before, deg))], ["src", "dst"])

    return rows.select("id", "deg", "adj").mapInArrow(run, "src bigint, dst bigint")


def _blocks(graph: Graph) -> DataFrame:
    """(id, block, neighbors): sorted neighbours, at most ROW in a row; one empty row where there are none."""
    edges = graph.edges.select("src", "dst")
    most = edges.groupBy("src").count().agg(F.max("count")).first()[0] or 0
    if most <= ROW:
        placed = edges.withColumn("block", F.lit(0))
    else:
        ranked = numbered(edges, ["src", "dst"], "k")
        starts = ranked.groupBy("src").agg(F.min("k").alias("start"))
        placed = ranked.join(starts, "src").select("src", "dst", F.floor((F.col("k") - F.col("start")) / ROW).cast("int").alias("block"))
    rows = placed.groupBy(F.col("src").alias("id"), "block").agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))  # at most ROW
    joined = graph.vertices.join(rows, "id", "left")
    return joined.select("id", F.coalesce("block", F.lit(0)).alias("block"), F.coalesce("neighbors", F.array().cast("array<bigint>")).alias("neighbors"))


def compress(graph: Graph) -> CompressedGraph:
    """Every row sorted, as deltas, as varints; vertices without neighbours have empty rows, those with very many have
    several, each of which begins with a whole number.  A written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            deg = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
            flat = lists.flatten().to_numpy().astype(np.int64)
            step = np.diff(flat, prepend=0)
            begins = (np.cumsum(deg) - deg)[deg > 0]
            step[begins] = flat[begins]
            data, size = encode_varints(step)
            stops = np.append(0, np.cumsum(size))[np.append(0, np.cumsum(deg))]
            blob = data.tobytes()
            adj = [blob[a:b] for a, b in zip(stops[:-1].tolist(), stops[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(deg.astype(np.int32)), pa.array(np.diff(stops).astype(np.int32)), pa.array(adj, pa.binary())],
                ["id", "block", "deg", "n_bytes", "adj"],
            )

    import pyarrow.compute  # noqa: F401

    rows = _blocks(graph).mapInArrow(run, "id bigint, block int, deg int, n_bytes int, adj binary")
    rows = materialise(rows, "adjacency")  # a search reads it once a level
    vertices = rows.where("block = 0").select("id")
    return CompressedGraph(vertices, rows, graph.symmetric, vertices.count())


def neighbours_of(graph: CompressedGraph, vertex: int) -> DataFrame:
    """(src, dst) of one vertex."""
    return _decoded(graph.adjacency.where(F.col("id") == vertex))
