"""Random graphs, the same for a seed wherever they are made."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..plans.ranks import numbered


def random_graph(spark: SparkSession, n: int, avg_degree: int, seed: int = 42) -> Graph:
    """Out-degrees uniform in 1 .. 2 * avg_degree, neighbours uniform, without loops; edges may repeat."""
    degree = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(2 * avg_degree)) + 1).cast("int")
    draws = spark.range(n).select("id", F.explode(F.sequence(F.lit(1), degree)).alias("k"))
    edges = draws.select(F.col("id").alias("src"), F.pmod(F.xxhash64(F.lit(seed + 1), "id", "k"), F.lit(n)).alias("dst"))
    return Graph.dense(edges.where("src <> dst"), n)


def uniform_graph(spark: SparkSession, n: int, m: int, seed: int = 42, globally_sorted: bool = False) -> Graph:
    """m edges with uniform ends.  globally_sorted pairs sources and neighbours both in order, which makes a banded graph."""
    draws = spark.range(m).select(
        "id", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).alias("src"), F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(n)).alias("dst")
    )
    if globally_sorted:
        a = numbered(draws.select("src", "id"), ["src", "id"], "k").select("src", "k")
        b = numbered(draws.select("dst", "id"), ["dst", "id"], "k").select("dst", "k")
        draws = a.join(b, "k")
    return Graph.dense(draws.select("src", "dst"), n)
