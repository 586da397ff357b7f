"""Readers and writers of graph files, and generators."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators.graph import Graph
from .csrbin import read_csrbin, write_csrbin  # noqa: F401
from .generators import random_graph, uniform_graph  # noqa: F401
from .mat import read_mat
from .text import read_text, write_text  # noqa: F401


def read_graph(spark: SparkSession, path: str, fmt: str | None = None) -> Graph:
    """By format, or else by the file's ending: .csrbin, .mat, and otherwise an edge list."""
    fmt = fmt or ("csrbin" if path.endswith(".csrbin") else "mat" if path.endswith(".mat") else "text")
    return {"csrbin": read_csrbin, "mat": read_mat, "text": read_text}[fmt](spark, path)
