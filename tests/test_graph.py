import struct
from collections import deque

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar import cli
from lodestar.functions import degree_class, lcg, varint_length, wang_hash
from lodestar.operators import components, compress, reorder, stats, traverse
from lodestar.operators.graph import Graph, valid_row_ptr
from lodestar.plans import ranks
from lodestar.sources import random_graph, read_csrbin, read_graph, read_text, uniform_graph, write_csrbin, write_text


def make(spark, edges, n=None, symmetric=True):
    df = spark.createDataFrame(edges, "src long, dst long")
    graph = Graph.dense(df, n) if n else Graph.from_edges(df)
    return graph.symmetrized() if symmetric else graph


def search(edges, n, source):
    near = {i: [] for i in range(n)}
    for a, b in edges:
        near[a].append(b)
    dist, todo = {source: 0}, deque([source])
    while todo:
        x = todo.popleft()
        for y in near[x]:
            if y not in dist:
                dist[y] = dist[x] + 1
                todo.append(y)
    return {i: dist.get(i) for i in range(n)}


def labels_of(edges, n):
    label = list(range(n))
    for _ in range(n):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    return dict(enumerate(label))


SHAPES = {
    # a path, a cycle, a loop, repeated edges, a complete part and isolated vertices, apart from each other
    "parts": (
        [(0, 1), (1, 2), (2, 3), (0, 1), (6, 5), (5, 4), (4, 6), (7, 7), *[(a, b) for a in range(8, 12) for b in range(8, a)]], 14,
    ),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_traversals_and_components(spark, shape):
    edges, n = SHAPES[shape]
    graph = make(spark, edges, n)
    both = edges + [(b, a) for a, b in edges]
    expected = search(both, n, 0)
    for mode in ("top_down", "hybrid", "bottom_up"):
        assert {r.id: r.dist for r in traverse.bfs(graph, 0, mode).collect()} == expected
    packed = compress.compress(graph)
    assert {r.id: r.dist for r in traverse.bfs(packed, 0, "hybrid").collect()} == expected
    assert sorted(map(tuple, packed.decoded().edges.collect())) == sorted(map(tuple, graph.edges.collect()))
    label = labels_of(both, n)
    for algorithm in ("exact", "sampled"):
        assert {r.id: r.component for r in components.connected_components(graph, algorithm).collect()} == label
    assert {r.id: r.label for r in components.label_propagation(graph).collect()} == label
    counters = {}
    components.label_propagation(graph, active_only=False, counters=counters)
    assert counters["rounds"] >= 1
    reach = {r.id: r.dist for r in traverse.reachability(graph, 0).collect()}
    assert reach == {i: None if d is None else min(d, 1) for i, d in expected.items()}


def test_directed(spark):
    edges = [(0, 1), (1, 2), (3, 1)]
    graph = make(spark, edges, 4, symmetric=False)
    for mode in ("top_down", "bottom_up"):
        assert {r.id: r.dist for r in traverse.bfs(graph, 0, mode).collect()} == search(edges, 4, 0)
    assert {r.id: r.label for r in components.label_propagation(graph, directed=True).collect()} == {0: 0, 1: 1, 2: 2, 3: 1}
    parents = {r.id: r.parent for r in traverse.bfs_parents(graph, traverse.bfs(graph, 0)).collect()}
    assert parents == {0: 0, 1: 0, 2: 1}
    with pytest.raises(ValueError):
        traverse.bfs(graph, 99)
    with pytest.raises(ValueError):
        traverse.bfs(graph, 0, "sideways")


def fifo_order(edges, n, start):
    near = {i: sorted({b for a, b in edges if a == i}) for i in range(n)}
    seen, out = set(), []
    for root in [start, *range(n)]:
        if root in seen:
            continue
        todo = deque([root])
        seen.add(root)
        while todo:
            x = todo.popleft()
            out.append(x)
            for y in near[x]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
    return {x: i for i, x in enumerate(out)}


@pytest.mark.parametrize("shape", SHAPES)
def test_orders(spark, shape):
    edges, n = SHAPES[shape]
    graph = make(spark, edges, n)
    both = edges + [(b, a) for a, b in edges]
    degree = {i: len({b for a, b in both if a == i}) for i in range(n)}
    top = min(range(n), key=lambda i: (-degree[i], i))
    assert reorder.max_degree_node(graph).first()["id"] == top
    assert {r.old_id: r.new_id for r in reorder.bfs_order(graph).collect()} == fifo_order(both, n, top)
    assert {r.old_id: r.new_id for r in reorder.gap_bfs_order(graph).collect()} == fifo_order(both, n, 0)
    order = sorted(range(n), key=lambda i: (-degree[i], -i))
    assert {r.old_id: r.new_id for r in reorder.degree_order(graph).collect()} == {x: i for i, x in enumerate(order)}
    new, mapping = reorder.reorder(graph, reorder.Method.DEGREE)
    place = {r.old_id: r.new_id for r in mapping.collect()}
    assert {tuple(r) for r in new.edges.collect()} == {(place[a], place[b]) for a, b in both}
    assert reorder.Method(7) is reorder.Method.GAP_BFS


def test_directed_order(spark):
    edges = [(0, 2), (2, 1), (3, 0)]
    graph = make(spark, edges, 4, symmetric=False)
    assert {r.old_id: r.new_id for r in reorder.gap_bfs_order(graph).collect()} == fifo_order(edges, 4, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**62), max_size=40))
def test_varints_round_trip(values):
    data, size = compress.encode_varints(np.array(values, np.int64))
    assert compress.decode_varints(data).tolist() == values
    assert size.tolist() == [max(1, -(-v.bit_length() // 7)) for v in values]


def test_functions(spark):
    def wang(x):
        mask = 2**32 - 1
        x = (x ^ 61) ^ (x >> 16)
        x = x * 9 & mask
        x ^= x >> 4
        x = x * 0x27D4EB2D & mask
        return x ^ (x >> 15)

    xs = [0, 1, 7, 12345, 2**31 - 1, 2**32 - 1]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    rows = df.select("x", wang_hash(F.col("x")).alias("w"), lcg(F.col("x"), F.lit(3)).alias("l"), varint_length(F.col("x")).alias("v")).collect()
    for r in rows:
        assert (r.w, r.l) == (wang(r.x), (r.x * 1664525 + 1013904223 + 3) % 2**32)
        assert r.v == max(1, -(-r.x.bit_length() // 7))
    classes = spark.createDataFrame([(31,), (32,), (1023,), (1024,), (1025,)], "d int")
    got = classes.select(degree_class(F.col("d")).alias("a"), degree_class(F.col("d"), True).alias("b")).collect()
    assert [r.a for r in got] == ["small", "medium", "medium", "large", "large"]
    assert [r.b for r in got] == ["small", "small", "medium", "medium", "large"]


def test_star_has_a_large_hub(spark):
    graph = make(spark, [(0, i) for i in range(1, 1101)], 1101)
    assert {r.deg_class: r.n for r in graph.class_counts(inclusive=False).collect()} == {"large": 1, "small": 1100}
    assert graph.stats().first()["max_degree"] == 1100


def test_files(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_text("4 4\n0 1\n1  2\n2 9\n1 0\n")
    graph = read_graph(spark, str(path))
    assert (graph.n, graph.m) == (4, 3)
    (tmp_path / "bad.txt").write_text("3 2\n0 1\n")
    with pytest.raises(ValueError):
        read_text(spark, str(tmp_path / "bad.txt"))
    write_csrbin(graph, str(tmp_path / "g.csrbin"))
    data = (tmp_path / "g.csrbin").read_bytes()
    assert data == struct.pack("<QQ5q3i", 4, 3, 0, 1, 3, 3, 3, 1, 0, 2)
    again = read_csrbin(spark, str(tmp_path / "g.csrbin"))
    assert again.n == 4 and sorted(map(tuple, again.edges.collect())) == [(0, 1), (1, 0), (1, 2)]
    (tmp_path / "short.csrbin").write_bytes(data[:-2])
    with pytest.raises(ValueError):
        read_csrbin(spark, str(tmp_path / "short.csrbin"))
    write_text(graph, str(tmp_path / "out"))
    assert read_text(spark, str(tmp_path / "out")).m == 3
    with pytest.raises((ImportError, OSError)):
        read_graph(spark, str(tmp_path / "none.mat"))


def test_generators_and_checks(spark):
    graph = random_graph(spark, 200, 4)
    assert graph.n == 200 and graph.edges.where("src = dst").isEmpty()
    assert sorted(map(tuple, graph.edges.collect())) == sorted(map(tuple, random_graph(spark, 200, 4).edges.collect()))
    banded = uniform_graph(spark, 100, 1000, globally_sorted=True)
    assert banded.m == 1000 and banded.edges.selectExpr("max(abs(src - dst))").first()[0] < 40
    assert graph.violations().isEmpty() and valid_row_ptr(graph.row_ptr())
    broken = Graph(spark.range(3), spark.createDataFrame([(0, 7)], "src long, dst long"))
    assert [tuple(r) for r in broken.violations().collect()] == [("endpoint", 1)]


def test_empty_graph(spark):
    graph = make(spark, [], 3)
    assert {r.id: r.component for r in components.connected_components(graph).collect()} == {0: 0, 1: 1, 2: 2}
    assert {r.id: r.dist for r in traverse.bfs(graph, 1).collect()} == {0: None, 1: 0, 2: None}


def test_stats_and_strategy(spark):
    trials = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "ms double")
    row = stats.trial_stats(trials, 4_000_000).first()
    assert (row.num_trials, row.min_ms, row.median_ms, row.mean_ms) == (4, 1, 2.5, 4) and row.gteps == 1.0
    assert row.std_dev_ms == pytest.approx(np.std([1, 2, 3, 10]))
    graph = make(spark, [(0, 1), (1, 2)], 4)
    assert {r.id: r.dist for r in traverse.traverse(graph, 0).collect()} == {0: 0, 1: 1, 2: 2, 3: None}
    assert {r.id: r.dist for r in traverse.traverse(graph, 0, limit=1).collect()} == {0: 0, 1: 1, 2: 1, 3: None}
    times = spark.createDataFrame([("a", 10.0), ("b", 2.0)], "variant string, ms double")
    assert {r.variant: r.speedup for r in stats.speedups(times, "a").collect()} == {"a": 1.0, "b": 5.0}
    assert traverse.mismatches(traverse.bfs(graph, 0), traverse.reachability(graph, 0)).count() == 1


def test_command_line(spark, tmp_path, capsys):
    path = tmp_path / "g.txt"
    path.write_text("3 2\n0 1\n1 2\n")
    assert cli.main(["search", str(path), "--undirected", "--validate", "--json"], spark) == 0
    assert '"validated": true' in capsys.readouterr().out
    assert cli.main(["components", str(path)], spark) == 0
    assert cli.main(["reorder", str(path), str(tmp_path / "o.csrbin"), "1"], spark) == 0
    assert read_csrbin(spark, str(tmp_path / "o.csrbin")).m == 2


def sequential(edges, n, start):
    """By brute force: the order of searches one after another, each from the least vertex left."""
    near = {i: sorted({b for a, b in edges if a == i}) for i in range(n)}
    order, met, todo = [], set(), deque()
    for root in [start, *range(n)]:
        if root not in met:
            met.add(root)
            todo.append(root)
            while todo:
                x = todo.popleft()
                order.append(x)
                for y in near[x]:
                    if y not in met:
                        met.add(y)
                        todo.append(y)
    return order


def order_of(mapping):
    return [r["old_id"] for r in mapping.orderBy("new_id").collect()]


def test_directed_orders_against_one_after_another(spark):
    rng = np.random.default_rng(11)
    for n, m in ((14, 18),):
        edges = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b})
        graph = make(spark, edges, n, symmetric=False)
        assert order_of(reorder.gap_bfs_order(graph)) == sequential(edges, n, 0)
        start = reorder.max_degree_node(graph).first()["id"]
        assert order_of(reorder.bfs_order(graph)) == sequential(edges, n, start)


def test_orders_of_an_empty_graph(spark):
    edges = spark.createDataFrame([], "src long, dst long")
    for symmetric in (True, False):
        graph = Graph(spark.range(0), edges, symmetric)
        for order in (reorder.bfs_order, reorder.gap_bfs_order, reorder.degree_order):
            assert order(graph).columns == ["old_id", "new_id"] and order(graph).count() == 0


def test_long_paths(spark):
    """More levels than the visited set has pieces, in either direction of search."""
    n = 16
    edges = [(i, i + 1) for i in range(n - 1)]
    for symmetric, mode in ((True, "bottom_up"), (False, "top_down")):
        graph = make(spark, edges, n, symmetric)
        assert sorted(map(tuple, traverse.bfs(graph, 0, mode).collect())) == [(i, i) for i in range(n)]


def test_rows_in_blocks(spark, monkeypatch):
    """Neighbours beyond a row's size go into further rows."""
    monkeypatch.setattr(compress, "ROW", 4)
    edges = [(0, i) for i in range(1, 40)] + [(3, 4)]
    graph = make(spark, edges, 42)
    small = compress.compress(graph)
    assert small.adjacency.agg(F.max("deg")).first()[0] == 4 and small.n == 42
    assert sorted(map(tuple, small.decoded().edges.collect())) == sorted(map(tuple, graph.edges.collect()))
    assert {r["id"]: r["dist"] for r in traverse.bfs(small, 1, "hybrid", 4).collect()} == {r["id"]: r["dist"] for r in traverse.bfs(graph, 1).collect()}
    assert dict(map(tuple, small.byte_class_counts().collect())) == {"small": 41, "large": 1}


def test_writer_refuses_sparse_ids(spark, tmp_path):
    df = spark.createDataFrame([(0, 5)], "src long, dst long")
    with pytest.raises(Exception):
        write_csrbin(Graph.from_edges(df), str(tmp_path / "sparse.csrbin"))
    assert not list(tmp_path.iterdir())


def test_bench_command(spark, tmp_path, capsys):
    path = str(tmp_path / "g.csrbin")
    write_csrbin(make(spark, [(0, 1), (1, 2), (2, 3)], 5), path)
    assert cli.main(["bench", path, "-n", "1"], spark) == 0
    out = capsys.readouterr().out
    assert '"settings"' in out and out.count('"validated": true') == 4 and out.count("speedup") == 4
    assert cli.main(["components", path, "--compress", "--algorithm", "rounds"], spark) == 0
    assert capsys.readouterr().out.strip() == "2"


def test_rank_columns_leave_their_table_alone(spark):
    """Rows before and sums, over several partitions; the table's own schema stays as it is."""
    rows = sorted({(k * k % 23, k * 7 % 31) for k in range(200)})
    df = spark.createDataFrame(rows[::-1], "src bigint, dst bigint")
    before = ranks.previous(df, ["src", "dst"], "before", 5)
    sums = ranks.running_sum(df, ["src", "dst"], "dst", "total", 5)
    assert df.columns == ["src", "dst"] and before.columns == ["src", "dst", "before"] and sums.columns == ["src", "dst", "total"]
    found = sorted((r.src, r.dst, r.before and tuple(r.before)) for r in before.collect())
    assert found == [(*row, last) for row, last in zip(rows, [None, *rows])]
    assert sorted(map(tuple, sums.collect())) == [(*row, sum(d for _, d in rows[:k])) for k, row in enumerate(rows)]


def test_row_sizes(spark):
    """Deltas, sizes, offsets and whether rows fit, against plain Python; a vertex alone has an empty row."""
    rng = np.random.default_rng(3)
    edges = sorted({(a, b) for a, b in rng.integers(0, 40, (150, 2)).tolist() if a != b} | {(0, 300), (1, 70_000)})
    edges = sorted({*edges, *((b, a) for a, b in edges)})
    graph = Graph(spark.createDataFrame([(k,) for k in sorted({a for a, _ in edges} | {999})], "id bigint"), spark.createDataFrame(edges, "src bigint, dst bigint"), True)
    steps, sizes, last = [], {r.id: 0 for r in graph.vertices.collect()}, None
    for a, b in edges:
        steps.append((a, b, b - last[1] if last and last[0] == a else b))
        sizes[a] += max(1, (steps[-1][2].bit_length() + 6) // 7)
        last = a, b
    assert sorted(map(tuple, compress.deltas(graph).collect())) == steps
    assert dict(map(tuple, compress.row_bytes(graph).collect())) == sizes
    at, ends = 0, {}
    for k in sorted(sizes):
        ends[k] = (at, at := at + sizes[k])
    assert {r.id: (r.byte_start, r.byte_end) for r in compress.byte_offsets(graph).collect()} == ends
    assert {r.id: r.fits for r in compress.fits_in_place(graph).collect()} == {k: e <= 4 * sum(a <= k for a, _ in edges) for k, (_, e) in ends.items()}
    total = compress.ratio(graph).first()
    assert (total.raw_bytes, total.compressed_bytes) == (4 * len(edges), at)
