"""Breadth-first search, one job a level, with the direction chosen by the size of the frontier."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import degree_class
from ..plans.tables import Pieces, counted, materialise
from .compress import CompressedGraph
from .components import connected_components
from .graph import Graph


@dataclass
class Levels:
    """What a search did: the size of each frontier and the direction that each step took."""

    sizes: list[int] = field(default_factory=list)
    directions: list[str] = field(default_factory=list)


def _top_down(graph: Graph | CompressedGraph, frontier: DataFrame) -> DataFrame:
    """Neighbours of the frontier, which is the small side of the join."""
    if isinstance(graph, CompressedGraph):
        return graph.neighbours_of(frontier).select(F.col("dst").alias("id")).distinct()
    return graph.edges.join(frontier.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id")).distinct()


def _bottom_up(graph: Graph | CompressedGraph, frontier: DataFrame, unvisited: DataFrame) -> DataFrame:
    """Unvisited vertices with an in-edge from the frontier: edges are pruned by the unvisited end first.

    In a symmetric graph that end is the one that edges lie by, so that edges aren't shuffled, and of compressed rows only
    those of unvisited vertices are decoded.
    """
    if not graph.symmetric:
        edges = graph.decoded().edges if isinstance(graph, CompressedGraph) else graph.edges
        met = edges.join(unvisited.select(F.col("id").alias("dst")), "dst", "left_semi").join(frontier.select(F.col("id").alias("src")), "src", "left_semi")
        return met.select(F.col("dst").alias("id")).distinct()
    if isinstance(graph, CompressedGraph):
        edges = graph.neighbours_of(unvisited)
    else:
        edges = graph.edges.join(unvisited.select(F.col("id").alias("src")), "src", "left_semi")
    return edges.join(frontier.select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id")).distinct()


def bfs(
    graph: Graph | CompressedGraph, source: int, mode: str = "top_down", bu_divisor: int | None = None,
    levels: Levels | None = None, max_levels: int | None = None, num_partitions: int | None = None,
) -> DataFrame:
    """(id, dist) of all vertices; dist is null where the source doesn't lead.

    mode: top_down, bottom_up, or hybrid, which goes bottom-up while the frontier is larger than
    n // bu_divisor.  The result doesn't depend on it.  In a symmetric graph only the last two levels
    can be met again, so a top-down step doesn't search the visited set; otherwise it is kept as a few tables.
    num_partitions: how many parts the edges are cut into, if not as the session says.
    """
    if mode not in ("top_down", "bottom_up", "hybrid"):
        raise ValueError(f"unknown mode {mode}")
    compressed = isinstance(graph, CompressedGraph)
    bu_divisor = bu_divisor or (26 if compressed else 20)
    spark = graph.vertices.sparkSession
    graph.require(source)
    if num_partitions and not compressed:
        graph = Graph(graph.vertices, graph.edges.repartition(num_partitions, "src").persist(), graph.symmetric, graph._n, graph._m)
    levels = levels if levels is not None else Levels()
    frontier = materialise(spark.createDataFrame([(source, 0)], "id bigint, dist int"), "frontier")
    visited, last, size, depth = Pieces(frontier), [frontier], 1, 0
    while size and (max_levels is None or depth < max_levels):
        levels.sizes.append(size)
        depth += 1
        up = mode == "bottom_up" or mode == "hybrid" and size > graph.n // bu_divisor
        levels.directions.append("bottom_up" if up else "top_down")
        near = last[-1].select("id")
        if up:
            found = _bottom_up(graph, near, graph.vertices.join(visited.all().select("id"), "id", "left_anti"))
        else:
            seen = reduce(DataFrame.unionByName, last[-2:]) if graph.symmetric else visited.all()
            found = _top_down(graph, near).join(seen.select("id"), "id", "left_anti")
        frontier, size = counted(found.select("id", F.lit(depth).alias("dist")), "frontier")
        if size:
            # the pieces of the visited set may be written anew and deleted: the last two levels are kept as they are
            visited.add(frontier)
            last = [last[-1], frontier]
    return graph.vertices.join(visited.all(), "id", "left").select("id", "dist")


def bfs_parents(graph: Graph, distances: DataFrame) -> DataFrame:
    """(id, parent): for each reached vertex the least neighbour one level nearer; the source is its own parent."""
    near = distances.where("dist is not null")
    up = near.select(F.col("id").alias("src"), (F.col("dist") + 1).alias("dist"))
    down = graph.edges.join(up, "src").select(F.col("dst").alias("id"), "dist", "src")
    found = near.join(down, ["id", "dist"]).groupBy("id").agg(F.min("src").alias("parent"))
    return near.where("dist = 0").select("id", F.col("id").alias("parent")).unionByName(found)


def frontier_profile(distances: DataFrame) -> DataFrame:
    """(dist, n): vertices by level."""
    return distances.where("dist is not null").groupBy("dist").agg(F.count("*").alias("n"))


def frontier_classes(graph: Graph, distances: DataFrame, inclusive: bool = False) -> DataFrame:
    """(dist, deg_class, n): vertices by level and degree class."""
    near = distances.where("dist is not null").join(graph.degrees(), "id")
    return near.groupBy("dist", degree_class(F.col("deg"), inclusive).alias("deg_class")).agg(F.count("*").alias("n"))


def bfs_summary(distances: DataFrame) -> DataFrame:
    """One row: vertices, reached ones, their share in per cent, and the greatest distance from the source."""
    return distances.agg(
        F.count("*").alias("num_nodes"), F.count("dist").alias("reachable"),
        (F.count("dist") * 100.0 / F.count("*")).alias("reachable_percent"), F.max("dist").alias("max_distance"),
    )


def traversed_edges(graph: Graph, distances: DataFrame) -> DataFrame:
    """One row: the out-degrees of the reached vertices, summed."""
    reached = distances.where("dist is not null").select("id")
    return graph.edges.join(reached, F.col("src") == F.col("id"), "left_semi").agg(F.count("*").alias("traversed_edges"))


def reachability(graph: Graph, source: int) -> DataFrame:
    """(id, dist) by components, edges taken both ways: 0 for the source, 1 in its component, null elsewhere."""
    graph.require(source)
    labels = connected_components(graph)
    own = labels.where(F.col("id") == source).select(F.col("component").alias("own"))
    joined = labels.join(F.broadcast(own))  # one row
    dist = F.when(F.col("id") == source, 0).when(F.col("component") == F.col("own"), 1)
    return joined.select("id", dist.cast("int").alias("dist"))


def estimated_bytes(n: int, m: int) -> int:
    """Memory of a search that holds the graph: offsets, neighbours, distances and two queues."""
    return 8 * (n + 1) + 4 * m + 4 * n + 2 * 4 * n


def traverse(graph: Graph, source: int, strategy: str = "auto", limit: int = 18 << 30, **options) -> DataFrame:
    """Distances, or only reachability where the graph is estimated to exceed the limit of bytes."""
    if strategy == "auto":
        strategy = "bfs" if estimated_bytes(graph.n, graph.m) < limit else "union_find"
    if strategy == "bfs":
        return bfs(graph, source, **options)
    if strategy == "union_find":
        return reachability(graph, source)
    raise ValueError(f"unknown strategy {strategy}")


def mismatches(a: DataFrame, b: DataFrame, value: str = "dist") -> DataFrame:
    """(id, a, b): vertices on which two results differ."""
    x, y = a.select("id", F.col(value).alias("a")), b.select("id", F.col(value).alias("b"))
    return x.join(y, "id", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
