"""The graph: a DataFrame of vertices and one of directed edges."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import degree_class
from ..plans.ranks import numbered, running_sum


@dataclass
class Graph:
    """vertices (id) and edges (src, dst), both bigint.  Isolated vertices are vertices too; edges may repeat.

    symmetric: every edge is there in both directions.
    """

    vertices: DataFrame
    edges: DataFrame
    symmetric: bool = False
    _n: int | None = field(default=None, repr=False)
    _m: int | None = field(default=None, repr=False)

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | None = None, symmetric: bool = False) -> Graph:
        """From pairs (src, dst); edges whose ends aren't among the given vertices are dropped."""
        edges = edges.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")).where("src is not null and dst is not null")
        if vertices is None:
            vertices = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
        else:
            vertices = vertices.select(F.col("id").cast("bigint")).distinct()
            for end in ("src", "dst"):
                edges = edges.join(vertices, F.col(end) == F.col("id"), "left_semi")
        return cls(vertices, edges, symmetric)

    @classmethod
    def dense(cls, edges: DataFrame, n: int, symmetric: bool = False) -> Graph:
        """Over the vertices 0 .. n-1; edges with an end out of range are dropped."""
        inside = edges.where(F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1))
        vertices = edges.sparkSession.range(n)
        return cls(vertices, inside.select(F.col("src").cast("bigint"), F.col("dst").cast("bigint")), symmetric, _n=n)

    @property
    def n(self) -> int:
        if self._n is None:
            self._n = self.vertices.count()
        return self._n

    @property
    def m(self) -> int:
        if self._m is None:
            self._m = self.edges.count()
        return self._m

    def persist(self) -> Graph:
        """Keep both tables in memory, or on disk where it is short; edges lie by source."""
        self.vertices = self.vertices.persist(StorageLevel.MEMORY_AND_DISK)
        self.edges = self.edges.repartition("src").persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def unpersist(self) -> None:
        self.vertices.unpersist()
        self.edges.unpersist()

    def symmetrized(self) -> Graph:
        """Both directions of every edge, once each."""
        back = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return Graph(self.vertices, self.edges.unionByName(back).distinct(), True, _n=self._n)

    def transposed(self) -> Graph:
        return Graph(self.vertices, self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), self.symmetric, self._n, self._m)

    def degrees(self) -> DataFrame:
        """(id, deg): out-degrees, zero for isolated vertices."""
        counted = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("deg"))
        return self.vertices.join(counted, "id", "left").select("id", F.coalesce("deg", F.lit(0)).cast("bigint").alias("deg"))

    def adjacency(self) -> DataFrame:
        """(id, deg, neighbors): sorted rows.  A row is as large as its vertex's degree."""
        rows = self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))
        joined = self.vertices.join(rows, "id", "left")
        near = F.coalesce("neighbors", F.array().cast("array<bigint>"))
        return joined.select("id", F.size(near).alias("deg"), near.alias("neighbors"))

    def stats(self) -> DataFrame:
        """One row: n, m, least, greatest and mean degree."""
        return self.degrees().agg(
            F.count("*").alias("num_nodes"), F.coalesce(F.sum("deg"), F.lit(0)).alias("num_edges"), F.min("deg").alias("min_degree"),
            F.max("deg").alias("max_degree"), F.avg("deg").alias("avg_degree"),
        )

    def class_counts(self, inclusive: bool = True) -> DataFrame:
        """(deg_class, n): vertices by degree class."""
        return self.degrees().groupBy(degree_class(F.col("deg"), inclusive).alias("deg_class")).agg(F.count("*").alias("n"))

    def isolated(self) -> DataFrame:
        ends = self.edges.select(F.col("src").alias("id")).unionByName(self.edges.select(F.col("dst").alias("id")))
        return self.vertices.join(ends, "id", "left_anti")

    def row_ptr(self) -> DataFrame:
        """(id, row_start, row_end): the places of each vertex's neighbours in the order of ids."""
        starts = running_sum(self.degrees(), ["id"], "deg", "row_start")
        return starts.select("id", "row_start", (F.col("row_start") + F.col("deg")).alias("row_end"))

    def dense_ids(self) -> DataFrame:
        """(old_id, new_id): ids 0 .. n-1 in the order of the old ones."""
        return numbered(self.vertices.select(F.col("id").alias("old_id")), ["old_id"], "new_id")

    def require(self, source: int) -> None:
        if self.vertices.where(F.col("id") == source).isEmpty():
            raise ValueError(f"vertex {source} is not in the graph")

    def violations(self) -> DataFrame:
        """(kind, n): rows that break the rules of a graph; none for a valid one."""
        rows = self.row_ptr()
        out_of_order = rows.where("row_end < row_start").agg(F.count("*").alias("n")).select(F.lit("row_ptr").alias("kind"), "n")
        ends = self.edges.select(F.explode(F.array("src", "dst")).alias("id"))
        unknown = ends.join(self.vertices, "id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("endpoint").alias("kind"), "n")
        return out_of_order.unionByName(unknown).where("n > 0")


def valid_row_ptr(rows: DataFrame) -> bool:
    """Whether (row_start, row_end) rows in the order of ids are gapless and grow."""
    ordered = numbered(rows.select("id", "row_start", "row_end"), ["id"], "k")
    after = ordered.select((F.col("k") - 1).alias("k"), F.col("row_start").alias("next"))
    bad = ordered.join(after, "k", "left").where("row_end < row_start or next <> row_end or row_start < 0")
    return bad.isEmpty() and (ordered.isEmpty() or ordered.where("k = 0 and row_start <> 0").isEmpty())
