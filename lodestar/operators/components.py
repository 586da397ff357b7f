"""Exact connected components by hooking to the least neighbour, pointer jumping and contraction."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lcg, wang_hash
from ..plans.ranks import numbered
from ..plans.tables import discard, materialise


def _hooked(edges: DataFrame) -> DataFrame:
    """(id, to): each vertex's least closed neighbour."""
    both = edges.select(F.col("a").alias("id"), F.col("b").alias("n")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("a").alias("n"))
    )
    return both.groupBy("id").agg(F.least(F.min("n"), F.col("id")).alias("to"))


def _to_roots(hooks: DataFrame) -> DataFrame:
    """Pointer jumping, until all vertices point to the root of their tree."""
    while True:
        up = hooks.select(F.col("id").alias("to"), F.col("to").alias("top"))
        jumped = materialise(hooks.join(up, "to").select("id", "to", "top"), "roots")
        moved = jumped.where("to <> top").limit(1).count()
        discard(hooks)
        after = jumped.select("id", F.col("top").alias("to"))
        after._lodestar_path = jumped._lodestar_path
        hooks = after
        if not moved:
            return hooks


def least_labels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of every endpoint; the component is its least vertex.  Edges count in both directions.

    Each round hooks every vertex to its least neighbour, finds the roots of the resulting forest and
    contracts the edges to them.  Only local minima stay, at most half of the vertices, and the root of
    a tree is its least vertex, so the labels need no correction.  The maps of the rounds shrink as
    fast; they are composed from the last one back.
    """
    left = edges.select(F.least(src, dst).alias("a"), F.greatest(src, dst).alias("b")).where("a is not null and b is not null")
    alone = left.where("a = b").select(F.col("a").alias("id")).distinct()
    left = materialise(left.where("a < b").distinct(), "edges")
    maps: list[DataFrame] = []
    while not left.isEmpty():
        roots = _to_roots(materialise(_hooked(left), "hooks"))
        maps.append(roots)
        a = roots.select(F.col("id").alias("a"), F.col("to").alias("ra"))
        b = roots.select(F.col("id").alias("b"), F.col("to").alias("rb"))
        moved = left.join(a, "a").join(b, "b").where("ra <> rb")
        after = materialise(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(left)
        left = after
    discard(left)
    out = None
    for step in reversed(maps):
        if out is not None:
            later = out.select(F.col("id").alias("to"), F.col("component"))
            step = step.join(later, "to", "left").select("id", F.coalesce("component", "to").alias("component"))
        else:
            step = step.withColumnRenamed("to", "component")
        out = step
    singles = alone.withColumn("component", F.col("id"))
    if out is None:
        return singles
    return out.unionByName(singles.join(out, "id", "left_anti"))


def connected_components(graph, algorithm: str = "exact", picks: int = 2) -> DataFrame:
    """(id, component): weakly connected components, each named by its least vertex; isolated vertices are their own.

    The graph may be compressed; its rows are then decoded as the edges are read.  With algorithm "sampled" a few
    neighbours of each vertex are linked first, which settles most of a giant component; the remaining edges are
    then contracted to what that leaves.  "rounds" samples one neighbour a round, `picks` times, by a linear congruential
    generator, and leaves out from the second round on what the largest component holds already.  Labels are the same.
    """
    if algorithm not in ("exact", "sampled", "rounds"):
        raise ValueError(f"unknown algorithm {algorithm}")
    if not hasattr(graph, "edges"):
        graph = graph.decoded()
    if algorithm == "exact":
        labels = least_labels(graph.edges)
    else:
        if algorithm == "sampled":
            first = materialise(least_labels(sampled_edges(graph, picks)), "sampled")
        else:
            first = _sampled_rounds(graph, picks)
        second = materialise(least_labels(_between(graph.edges, first), "src_c", "dst_c"), "rest")
        ends = graph.edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        labels = _composed(ends, first, second)
    return graph.vertices.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """The edges whose ends have different labels, with the labels."""
    for end in ("src", "dst"):
        label = labels.select(F.col("id").alias(end), F.col("component").alias(end + "_c"))
        edges = edges.join(label, end, "left").withColumn(end + "_c", F.coalesce(end + "_c", end))
    return edges.where("src_c <> dst_c")


def _composed(ends: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(id, component): the label of the label."""
    later = second.select(F.col("id").alias("component"), F.col("component").alias("top"))
    labels = ends.join(first, "id", "left").withColumn("component", F.coalesce("component", "id"))
    return labels.join(later, "component", "left").select("id", F.coalesce("top", "component").alias("component"))


def placed_edges(graph) -> DataFrame:
    """(src, dst, place, deg): neighbours counted off in their order, by global ranks, so that no task holds a whole
    neighbourhood.  Edges must be distinct."""
    ranked = numbered(graph.edges.select("src", "dst"), ["src", "dst"], "k")
    rows = ranked.groupBy("src").agg(F.min("k").alias("start"), F.count("*").alias("deg"))
    return ranked.join(rows, "src").select("src", "dst", (F.col("k") - F.col("start")).alias("place"), "deg")


def sampled_edges(graph, picks: int = 2) -> DataFrame:
    """(src, dst): up to `picks` neighbours of each vertex, in a circle from a place that its Wang hash gives."""
    start = F.pmod(wang_hash(F.col("src")), F.col("deg"))
    return placed_edges(graph).where(F.pmod(F.col("place") - start, F.col("deg")) < picks).select("src", "dst")


def round_edges(placed: DataFrame, turn: int) -> DataFrame:
    """(src, dst): one neighbour of each vertex, at the place that a linear congruential generator gives for a round."""
    return placed.where(F.col("place") == F.pmod(lcg(F.col("src"), F.lit(turn)), F.col("deg"))).select("src", "dst")


def _sampled_rounds(graph, rounds: int) -> DataFrame:
    """(id, component) that sampled neighbours link.  From the second round on, vertices of the largest component so far
    sample no more: nearly all of their neighbours are in it."""
    placed = materialise(placed_edges(graph), "placed")
    labels = materialise(least_labels(round_edges(placed, 0)), "sampled")
    for turn in range(1, rounds):
        picked = round_edges(placed, turn)
        giant = labels.groupBy("component").count().orderBy(F.col("count").desc(), "component").limit(1).select("component")
        inside = labels.join(F.broadcast(giant), "component", "left_semi").select(F.col("id").alias("src"))  # one row
        picked = materialise(picked.join(inside, "src", "left_anti"), "picked")
        more = materialise(least_labels(_between(picked, labels), "src_c", "dst_c"), "more")
        ends = labels.select("id").unionByName(picked.select(F.explode(F.array("src", "dst")).alias("id"))).distinct()
        labels = materialise(_composed(ends, labels, more), "sampled")
    return labels


def component_sizes(labels: DataFrame) -> DataFrame:
    """(component, size)."""
    return labels.groupBy("component").agg(F.count("*").alias("size"))


def component_count(labels: DataFrame) -> DataFrame:
    """One row: the number of components, which is that of the vertices that name one."""
    return labels.where("id = component").agg(F.count("*").alias("num_components"))


def label_propagation(graph, directed: bool = False, active_only: bool = True, counters: dict | None = None) -> DataFrame:
    """(id, label): the least label that reaches a vertex, by rounds of taking the least label among neighbours.

    Undirected, that is the component's least vertex; directed, the least vertex that a vertex leads to.
    With active_only a round looks only at edges into vertices whose label has just changed; otherwise at
    all.  counters gets the number of rounds, and the edges looked at (which takes a count a round).
    """
    pulls = graph.edges.select(F.col("src").alias("id"), F.col("dst").alias("via"))
    if not directed and not graph.symmetric:
        pulls = pulls.unionByName(graph.edges.select(F.col("dst").alias("id"), F.col("src").alias("via")))
    pulls = pulls.where("id <> via").distinct().repartition("via").persist(StorageLevel.MEMORY_AND_DISK)  # each round joins by via
    labels = materialise(graph.vertices.select("id", F.col("id").alias("label")), "labels")
    changed, rounds, edges = labels, 0, 0
    while True:
        source = (changed if active_only else labels).select(F.col("id").alias("via"), F.col("label").alias("seen"))
        looked = pulls.join(source, "via")
        if counters is not None:
            edges += looked.count()
        offers = looked.groupBy("id").agg(F.min("seen").alias("offer"))
        better = materialise(labels.join(offers, "id").where("offer < label").select("id", F.col("offer").alias("label")), "changed")
        rounds += 1
        if better.isEmpty():
            break
        new = better.select("id", F.col("label").alias("new"))
        after = materialise(labels.join(new, "id", "left").select("id", F.coalesce("new", "label").alias("label")), "labels")
        discard(labels)
        labels, changed = after, better
    pulls.unpersist()
    if counters is not None:
        counters |= {"rounds": rounds, "traversed_edges": edges}
    return labels
