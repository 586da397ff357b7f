"""Command line: python -m lodestar.cli search|reorder|components GRAPH ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession

from .operators import components, compress, reorder, stats, traverse
from .operators.graph import Graph
from .sources import read_graph, write_csrbin


def arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestar")
    commands = parser.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search", help="hop distances from a source")
    search.add_argument("graph")
    search.add_argument("-s", "--source", type=int, default=0)
    search.add_argument("--algo", choices=["bfs", "adaptive", "afforest", "union_find", "auto"], default="adaptive")
    search.add_argument("--bu-threshold", type=int, default=None, help="bottom-up while the frontier exceeds n divided by this")
    search.add_argument("--compress", action="store_true", help="search over compressed rows")
    search.add_argument("-b", "--benchmark", action="store_true")
    search.add_argument("-n", "--trials", type=int, default=3)
    search.add_argument("--json", action="store_true")
    search.add_argument("--csv", help="write a row (version, time_ms, validated) to this folder")
    search.add_argument("--validate", action="store_true", help="compare with a plain top-down search")
    search.add_argument("--undirected", action="store_true", help="add the other direction of every edge")
    change = commands.add_parser("reorder", help="relabel by an order: 0 search, 1 degree, 2 search from the least vertex")
    change.add_argument("graph")
    change.add_argument("output")
    change.add_argument("method", type=int, nargs="?", default=2)
    count = commands.add_parser("components", help="the number of components")
    count.add_argument("graph")
    count.add_argument("--algorithm", choices=["exact", "sampled", "rounds"], default="sampled")
    count.add_argument("--compress", action="store_true", help="over compressed rows")
    bench = commands.add_parser("bench", help="plain, bottom-up, hybrid and compressed searches, each validated and timed")
    bench.add_argument("graph")
    bench.add_argument("-s", "--source", type=int, default=0)
    bench.add_argument("-n", "--trials", type=int, default=3)
    return parser


def bench_searches(spark: SparkSession, graph: Graph, source: int, trials: int) -> int:
    """Prints the session's settings, then for each way of searching its times, its speed-up and whether it agrees with the first."""
    print(json.dumps({"settings": stats.settings(spark)}))
    small, times, valid = compress.compress(graph), [], True
    plain = traverse.bfs(graph, source).cache()
    edges = traverse.traversed_edges(graph, plain).first()[0]
    for name, over, mode in (("plain", graph, "top_down"), ("bottom_up", graph, "bottom_up"), ("hybrid", graph, "hybrid"), ("compressed", small, "hybrid")):
        figures = stats.trial_stats(stats.timed(spark, lambda: traverse.bfs(over, source, mode), trials), edges).first().asDict()
        agrees = traverse.mismatches(traverse.bfs(over, source, mode), plain).isEmpty()
        valid &= agrees
        times.append((name, figures["mean_ms"]))
        print(stats.record(name, "graph", graph.n, graph.m, figures, edges, validated=agrees))
    for row in stats.speedups(spark.createDataFrame(times, "variant string, ms double"), "plain").collect():
        print(json.dumps(row.asDict()))
    return 0 if valid else 1


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("lodestar").getOrCreate()
    graph = read_graph(spark, args.graph)
    if args.command == "reorder":
        write_csrbin(reorder.reorder(graph, args.method)[0], args.output)
        return 0
    if args.command == "components":
        graph = compress.compress(graph) if args.compress else graph
        print(components.component_count(components.connected_components(graph, args.algorithm)).first()[0])
        return 0
    if args.command == "bench":
        return bench_searches(spark, graph.symmetrized().persist(), args.source, args.trials)
    graph = (graph.symmetrized() if args.undirected else graph).persist()
    searched = compress.compress(graph) if args.compress else graph

    def run() -> DataFrame:
        if args.algo in ("afforest", "union_find"):
            return traverse.reachability(searched, args.source)
        if args.algo == "auto":
            return traverse.traverse(graph, args.source)
        return traverse.bfs(searched, args.source, "hybrid" if args.algo == "adaptive" else "top_down", args.bu_threshold)

    trials = stats.timed(spark, run, args.trials if args.benchmark else 1)
    distances = run().cache()
    edges = traverse.traversed_edges(graph, distances).first()[0]
    figures = stats.trial_stats(trials, edges).first().asDict()
    summary = traverse.bfs_summary(distances).first().asDict()
    valid = None
    if args.validate:
        expected = traverse.bfs(graph, args.source)
        if args.algo in ("afforest", "union_find"):
            expected = expected.selectExpr("id", "cast(least(dist, 1) as int) as dist")
        wrong = traverse.mismatches(distances, expected)
        valid = wrong.isEmpty()
        for row in [] if valid else wrong.orderBy("id").limit(10).collect():
            print(f"vertex {row['id']}: {row['a']}, expected {row['b']}")
    if args.csv:
        rows = [(args.algo, figures["mean_ms"], valid)]
        spark.createDataFrame(rows, "version string, time_ms double, validated boolean").coalesce(1).write.csv(args.csv, header=True)
    if args.json:
        print(stats.record(args.algo, args.graph, graph.n, graph.m, figures, edges, validated=valid))
    else:
        print(stats.report(summary), json.dumps(figures), sep="\n")
    graph.unpersist()
    return 0 if valid in (None, True) else 1


if __name__ == "__main__":
    raise SystemExit(main())
