"""Figures of runs: trials, throughput, records."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trial_stats(trials: DataFrame, traversed_edges: int = 0, column: str = "ms") -> DataFrame:
    """One row: count, least, greatest, mean and median time, population deviation, and giga-edges a second."""
    mean = F.avg(column)
    gteps = F.when(mean > 0, F.lit(float(traversed_edges)) / (mean * 1e6)).otherwise(F.lit(0.0))
    return trials.agg(
        F.count(column).cast("int").alias("num_trials"), F.min(column).alias("min_ms"), F.max(column).alias("max_ms"), mean.alias("mean_ms"),
        F.median(column).alias("median_ms"), F.stddev_pop(column).alias("std_dev_ms"), gteps.alias("gteps"),
    )


def timed(spark: SparkSession, run: Callable[[], DataFrame], trials: int = 3) -> DataFrame:
    """(trial, ms): wall time of computing a result in full, again and again."""
    rows = []
    for k in range(trials):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        rows.append((k, (time.perf_counter() - began) * 1e3))
    return spark.createDataFrame(rows, "trial int, ms double")


def bytes_moved(n: int, m: int, rounds: int = 1) -> int:
    """A model of the memory that rounds over a whole graph touch: offsets, neighbours and labels."""
    return rounds * (8 * (n + 1) + 4 * m + 4 * m + 4 * n)


def bandwidth(moved: int, ms: float) -> float:
    """Gigabytes a second."""
    return moved / (ms * 1e6) if ms > 0 else 0.0


def speedups(times: DataFrame, base: str) -> DataFrame:
    """(variant, ms, speedup) against one variant of (variant, ms)."""
    reference = times.where(F.col("variant") == base).agg(F.avg("ms").alias("reference"))
    return times.join(F.broadcast(reference)).select("variant", "ms", (F.col("reference") / F.col("ms")).alias("speedup"))  # one row


def record(algorithm: str, graph: str, n: int, m: int, stats: dict, traversed: int, **more) -> str:
    """A benchmark record in JSON."""
    return json.dumps({"algorithm": algorithm, "graph": graph, "num_nodes": n, "num_edges": m, "traversed_edges": traversed, **stats, **more})


def report(summary: dict) -> str:
    """A search's summary for people."""
    return (
        f"vertices: {summary['num_nodes']}\nreachable: {summary['reachable']} ({summary['reachable_percent']:.2f} %)\n"
        f"greatest distance: {summary['max_distance']}"
    )


def settings(spark: SparkSession) -> dict[str, str]:
    """What the session runs on."""
    return dict(sorted(spark.sparkContext.getConf().getAll()))
