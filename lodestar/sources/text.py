"""Edge lists: a line `n m`, then m lines `src dst`, white space between, ids from 0."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph


def read_text(spark: SparkSession, path: str, strict: bool = True, symmetrize: bool = False) -> Graph:
    """The directed graph of an edge list.  Edges out of range are dropped; repeated edges and loops stay.

    A number of pairs other than the header's is an error, or with strict=False a warning.  The header's
    own line can't pass for an edge: its first number, n, is out of range.
    """
    lines = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ").alias("p"))
    pairs = lines.where("size(p) >= 2").select(
        F.expr("try_cast(p[0] as bigint)").alias("src"), F.expr("try_cast(p[1] as bigint)").alias("dst")
    )
    rows = spark.read.text(path).where(F.trim("value") != "")
    first = rows.agg(F.min("_metadata.file_path")).first()[0]  # of a folder, the first file with lines
    header = spark.read.text(first).where(F.trim("value") != "").limit(1).collect() if first else []
    parts = header[0][0].split() if header else []
    if len(parts) < 2 or not all(x.isdigit() for x in parts[:2]):
        raise ValueError(f"{path}: the first line must be `n m`")
    n, m = int(parts[0]), int(parts[1])
    found = pairs.where("src is not null and dst is not null").count() - 1
    if found != m:
        if strict:
            raise ValueError(f"{path}: {m} edges announced, {found} found")
        warnings.warn(f"{path}: {m} edges announced, {found} found", stacklevel=2)
    graph = Graph.dense(pairs, n)
    return graph.symmetrized() if symmetrize else graph


def write_text(graph: Graph, path: str) -> None:
    """A folder of part files that `read_text` reads; the header stands in the first one."""
    edges: DataFrame = graph.edges.select(F.concat_ws(" ", "src", "dst").alias("value"), F.lit(1).alias("k"), "src", "dst")
    head = edges.sparkSession.createDataFrame([(f"{graph.n} {graph.m}", 0, -1, -1)], edges.schema)
    rows = head.unionByName(edges)
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(n, "k", "src", "dst").sortWithinPartitions("k", "src", "dst").select("value").write.text(path)
