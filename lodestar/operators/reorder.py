"""Orders of vertices, and relabelling by them."""

from __future__ import annotations

from enum import IntEnum
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ranks import numbered
from ..plans.tables import Pieces, counted, materialise
from .components import connected_components, label_propagation
from .graph import Graph
from .traverse import bfs


class Method(IntEnum):
    BFS = 0
    DEGREE = 1
    GAP_BFS = 2

    @classmethod
    def _missing_(cls, value):
        return cls.GAP_BFS


def max_degree_node(graph: Graph) -> DataFrame:
    """(id, deg) of the vertex with most neighbours, the least one of several."""
    return graph.degrees().orderBy(F.col("deg").desc(), F.col("id").asc()).limit(1)


def degree_order(graph: Graph) -> DataFrame:
    """(old_id, new_id): by degree, greatest first, and of equal degrees the greater id first."""
    rows = graph.degrees().select(F.col("id").alias("old_id"), "deg")
    return numbered(rows, [F.col("deg").desc(), F.col("old_id").desc()], "new_id").select("old_id", "new_id")


def _roots(graph: Graph, start: int) -> DataFrame:
    """(id, root, late): the vertex whose search meets a vertex first; late is 0 for `start`, else 1.

    Searches that follow one another, each from the least vertex left, meet a vertex from the least of the vertices that
    lead to it, once those that `start` leads to are gone: a smaller one would have been met no later, and so would
    begin a search of its own.  In a symmetric graph those are components.
    """
    if graph.symmetric:
        labels = materialise(connected_components(graph), "labels")
        own = labels.where(F.col("id") == start).select(F.col("component").alias("own"))
        ranked = labels.join(F.broadcast(own)).withColumn("mine", F.col("component") == F.col("own"))  # one row
        return ranked.select("id", F.when(F.col("mine"), F.lit(start)).otherwise(F.col("component")).alias("root"), F.when(F.col("mine"), 0).otherwise(1).alias("late"))
    met = materialise(bfs(graph, start).where("dist is not null").select("id"), "met")
    left = graph.vertices.join(met, "id", "left_anti")
    rest = graph.edges
    for end in ("src", "dst"):
        rest = rest.join(met.select(F.col("id").alias(end)), end, "left_anti")
    labels = label_propagation(Graph(left, rest).transposed(), directed=True)
    return met.select("id", F.lit(start).alias("root"), F.lit(0).alias("late")).unionByName(labels.select("id", F.col("label").alias("root"), F.lit(1).alias("late")))


def _search_order(graph: Graph, start: int | None) -> DataFrame:
    """The order in which a first-in, first-out search meets the vertices: it starts at `start`, takes neighbours
    in the order of their ids, and when it ends goes on at the least vertex that it hasn't met.

    Searches don't touch what others have met, so all run at once, over the edges within what each meets: a level at a
    time, a vertex is ranked by the earliest of its neighbours on the level before, then by id.  A graph without
    vertices has an empty order.
    """
    if start is None:
        return graph.vertices.select(F.col("id").alias("old_id"), F.col("id").alias("new_id"))
    roots = materialise(_roots(graph, start), "roots")
    edges = graph.edges
    if not graph.symmetric:
        for end in ("src", "dst"):
            edges = edges.join(roots.select(F.col("id").alias(end), F.col("root").alias(end + "_root")), end)
        edges = materialise(edges.where("src_root = dst_root").select("src", "dst"), "within")
    names = ["id", "late", "root", "depth", "rank"]
    level = numbered(roots.where("id = root").withColumn("depth", F.lit(0)), ["late", "root"], "rank")
    level = materialise(level.select(*names), "level")
    done, last, depth = Pieces(level), [level], 0
    while True:
        depth += 1
        met = edges.join(last[-1].select(F.col("id").alias("src"), "late", "root", "rank"), "src")
        met = met.groupBy(F.col("dst").alias("id"), "late", "root").agg(F.min("rank").alias("parent"))
        seen = reduce(DataFrame.unionByName, last[-2:]) if graph.symmetric else done.all()  # a symmetric graph leads back one level at most
        met, size = counted(met.join(seen.select("id"), "id", "left_anti"), "met")
        if not size:
            break
        level = numbered(met.withColumn("depth", F.lit(depth)), ["parent", "id"], "rank")
        level = materialise(level.select(*names), "level")
        done.add(level)
        last = [last[-1], level]
    ordered = numbered(done.all(), ["late", "root", "depth", "rank"], "new_id")
    return ordered.select(F.col("id").alias("old_id"), "new_id")


def bfs_order(graph: Graph) -> DataFrame:
    """(old_id, new_id): the order of a search from the vertex with most neighbours."""
    start = max_degree_node(graph).first()
    return _search_order(graph, start and start["id"])


def gap_bfs_order(graph: Graph) -> DataFrame:
    """(old_id, new_id): the order of a search from the least vertex."""
    return _search_order(graph, graph.vertices.agg(F.min("id")).first()[0])


def relabel(graph: Graph, mapping: DataFrame) -> Graph:
    """The graph under new ids."""
    edges = graph.edges
    for end in ("src", "dst"):
        new = mapping.select(F.col("old_id").alias(end), F.col("new_id").alias(end + "_new"))
        edges = edges.join(new, end).drop(end).withColumnRenamed(end + "_new", end)
    vertices = graph.vertices.join(mapping, F.col("id") == F.col("old_id")).select(F.col("new_id").alias("id"))
    return Graph(vertices, edges.select("src", "dst"), graph.symmetric, graph._n, graph._m)


def reorder(graph: Graph, method: int = Method.GAP_BFS) -> tuple[Graph, DataFrame]:
    """The relabelled graph, and the mapping."""
    order = {Method.BFS: bfs_order, Method.DEGREE: degree_order, Method.GAP_BFS: gap_bfs_order}[Method(method)]
    mapping = materialise(order(graph), "mapping")
    return relabel(graph, mapping), mapping
