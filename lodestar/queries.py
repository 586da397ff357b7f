"""The graph queries over lineitem, and their DuckDB SQL.

An order is the vertex 2 * l_orderkey, a part 2 * l_partkey + 1; edges are distinct and run both ways.
dense: all lineitems; sparse: l_quantity >= 45; frag: l_quantity >= 49.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .functions import cyclic_picks, lcg, wang_hash
from .operators import components, compress, reorder, stats, traverse
from .operators.graph import Graph
from .plans.tables import shared_dir

SOURCE = 1
LEAST = {"dense": 0, "sparse": 45, "frag": 49}


def directed(spark: SparkSession, sf_dir: str, kind: str = "dense") -> Graph:
    """Orders point to parts."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_quantity")
    rows = rows.where(F.col("l_quantity") >= LEAST[kind]) if LEAST[kind] else rows
    pairs = rows.select((F.col("l_orderkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst")).distinct()
    return Graph.from_edges(pairs)


def both_ways(spark: SparkSession, sf_dir: str, kind: str = "dense") -> Graph:
    return directed(spark, sf_dir, kind).symmetrized()


def everything(spark: SparkSession, sf_dir: str, kind: str = "frag") -> Graph:
    """With all orders and parts as vertices, so that some are isolated."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_orderkey") * 2).alias("id"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") * 2 + 1).alias("id"))
    graph = both_ways(spark, sf_dir, kind)
    return Graph(orders.unionByName(parts).unionByName(graph.vertices).distinct(), graph.edges, True)


def _distances(graph: Graph, **options) -> DataFrame:
    return traverse.bfs(graph.persist(), SOURCE, **options).where("dist is not null")


def _marked(distances: DataFrame) -> DataFrame:
    """With -1 where the source doesn't lead."""
    return distances.select("id", F.coalesce("dist", F.lit(-1)).alias("dist"))


def _component_rows(graph: Graph, **options) -> DataFrame:
    return components.connected_components(graph, **options)


def _violations(s: SparkSession, d: str) -> DataFrame:
    graph = both_ways(s, d)
    found = graph.violations().agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("violations"))
    return found.withColumn("num_nodes", F.lit(graph.n).cast("bigint"))


def _sampled(s: SparkSession, d: str) -> DataFrame:
    graph = both_ways(s, d, "sparse")
    return graph.adjacency().select("id", F.explode(cyclic_picks(F.col("neighbors"), wang_hash(F.col("id")), 2)).alias("neighbor"))


def _propagated(s: SparkSession, d: str, kind: str, **options) -> DataFrame:
    graph = directed(s, d, kind) if options.get("directed") else both_ways(s, d, kind)
    return components.label_propagation(graph, **options)


def _trials(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_quantity").alias("ms"))
    out = stats.trial_stats(rows, 4_000_000)
    return out.select("num_trials", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


def _relabelled(s: SparkSession, d: str) -> DataFrame:
    graph = both_ways(s, d, "sparse")
    return reorder.relabel(graph, reorder.degree_order(graph)).edges


def _ratio(s: SparkSession, d: str) -> DataFrame:
    return compress.ratio(both_ways(s, d)).select(F.col("raw_bytes").cast("bigint"), F.col("compressed_bytes").cast("bigint"), F.round("ratio", 6).alias("ratio"))


def _stats(s: SparkSession, d: str) -> DataFrame:
    return everything(s, d).stats().withColumn("avg_degree", F.round("avg_degree", 9))


def _dense_ids(graph: Graph) -> Graph:
    return reorder.relabel(graph, graph.dense_ids())


def _file(s: SparkSession, ending: str) -> str:
    """A new place in the shared folder, as a path that Python can open too."""
    return f"{shared_dir(s).removeprefix('file://').removeprefix('file:')}/{uuid.uuid4().hex}{ending}"


def _through_text(s: SparkSession, d: str) -> DataFrame:
    path = _file(s, ".txt")
    sources.write_text(_dense_ids(both_ways(s, d, "sparse")), path)
    return sources.read_graph(s, path).edges


def _through_csrbin(s: SparkSession, d: str) -> DataFrame:
    path = _file(s, ".csrbin")
    sources.write_csrbin(_dense_ids(both_ways(s, d, "sparse")), path)
    return sources.read_graph(s, path).edges


def _reordered_file(s: SparkSession, d: str) -> DataFrame:
    path = _file(s, ".csrbin")
    sources.write_csrbin(reorder.reorder(_dense_ids(both_ways(s, d, "sparse")), reorder.Method.DEGREE)[0], path)
    return sources.read_graph(s, path).degrees()


def _classes_by_level(s: SparkSession, d: str) -> DataFrame:
    graph = both_ways(s, d).persist()
    return traverse.frontier_classes(graph, traverse.bfs(graph, SOURCE))


def _differences(s: SparkSession, d: str) -> DataFrame:
    """Where hop distances differ from mere reachability."""
    graph = both_ways(s, d, "sparse").persist()
    return traverse.mismatches(traverse.reachability(graph, SOURCE), traverse.bfs(graph, SOURCE))


def _validated(s: SparkSession, d: str) -> DataFrame:
    """Each way of searching against the plain one."""
    graph = both_ways(s, d, "frag").persist()
    plain, small = traverse.bfs(graph, SOURCE), compress.compress(graph)
    ways = {"bottom_up": graph, "hybrid": graph, "compressed": small}
    rows = [
        traverse.mismatches(traverse.bfs(g, SOURCE, mode="top_down" if k == "compressed" else k), plain).agg(F.count("*").alias("wrong"))
        .select(F.lit(k).alias("variant"), "wrong")
        for k, g in ways.items()
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def _banded(s: SparkSession, d: str, **options) -> DataFrame:
    """Edges of a generated graph, loops and repeated ones included."""
    return sources.uniform_graph(s, 1000, 20_000, **options).stats().select("num_nodes", "num_edges", F.round("avg_degree", 6).alias("avg_degree"))


def _random_bounds(s: SparkSession, d: str) -> DataFrame:
    """One row: what holds for any seed."""
    graph = sources.random_graph(s, 2000, 8)
    near = graph.degrees().agg(F.count("*").alias("num_nodes"), F.max(F.col("deg")).alias("most"))
    loops = graph.edges.where("src = dst or dst < 0 or dst >= 2000").agg(F.count("*").alias("misplaced"))
    return near.crossJoin(loops).select("num_nodes", (F.col("most") <= 16).alias("bounded"), "misplaced")  # one row each


def _speedups(s: SparkSession, d: str) -> DataFrame:
    """Line statuses as variants, and mean quantities as their times."""
    rows = s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_returnflag").alias("variant")).agg(F.avg("l_quantity").alias("ms"))
    return stats.speedups(rows, "A").select("variant", F.round("ms", 6).alias("ms"), F.round("speedup", 6).alias("speedup"))


def _moved(s: SparkSession, d: str) -> DataFrame:
    """One row: the bytes that a search and a round over all edges touch, by the model, and the bandwidth at 2 ms."""
    graph = both_ways(s, d)
    moved = stats.bytes_moved(graph.n, graph.m, 3)
    return s.createDataFrame([(traverse.estimated_bytes(graph.n, graph.m), moved, round(stats.bandwidth(moved, 2.0), 6))], "held long, moved long, gb_s double")


QUERIES = {
    "edges_in_range": lambda s, d: Graph.dense(both_ways(s, d, "sparse").edges, 1000).edges,
    "edge_list_round_trip": _through_text,
    "csrbin_round_trip": _through_csrbin,
    "reordered_file": _reordered_file,
    "uniform_graph": _banded,
    "banded_graph": lambda s, d: _banded(s, d, globally_sorted=True),
    "random_graph": _random_bounds,
    "frontier_classes": _classes_by_level,
    "byte_classes": lambda s, d: compress.compress(both_ways(s, d)).byte_class_counts(),
    "compressed_neighbors": lambda s, d: compress.neighbours_of(compress.compress(both_ways(s, d)), SOURCE),
    "compressed_rows": lambda s, d: compress.compress(both_ways(s, d, "sparse")).adjacency.select("id", F.col("deg").cast("bigint"), F.col("n_bytes").cast("bigint")),
    "bfs_compressed_top_down": lambda s, d: traverse.bfs(compress.compress(both_ways(s, d)), SOURCE).where("dist is not null"),
    "bfs_partitioned": lambda s, d: _distances(both_ways(s, d), num_partitions=5),
    "bfs_mismatches": _differences,
    "bfs_validated": _validated,
    "traverse_auto": lambda s, d: _marked(traverse.traverse(both_ways(s, d, "frag").persist(), SOURCE)),
    "traverse_over_limit": lambda s, d: _marked(traverse.traverse(both_ways(s, d, "frag").persist(), SOURCE, limit=0)),
    "cc_compressed": lambda s, d: _component_rows(compress.compress(both_ways(s, d, "sparse"))),
    "cc_rounds": lambda s, d: _component_rows(both_ways(s, d, "sparse"), algorithm="rounds"),
    "round_sample": lambda s, d: components.round_edges(components.placed_edges(both_ways(s, d, "sparse")), 1),
    "order_bfs_directed": lambda s, d: reorder.gap_bfs_order(directed(s, d, "frag")),
    "bytes_moved": _moved,
    "speedups": _speedups,
    "degree_stats": _stats,
    "degree_class_counts": lambda s, d: both_ways(s, d).class_counts(),
    "degrees": lambda s, d: everything(s, d).degrees(),
    "max_degree_node": lambda s, d: reorder.max_degree_node(both_ways(s, d)),
    "isolated_vertices": lambda s, d: everything(s, d).isolated(),
    "symmetrize": lambda s, d: both_ways(s, d, "sparse").edges,
    "csr_row_ptr": lambda s, d: everything(s, d).row_ptr(),
    "validate_csr": _violations,
    "adjacency_delta": lambda s, d: compress.deltas(both_ways(s, d, "sparse")),
    "varint_row_bytes": lambda s, d: compress.row_bytes(both_ways(s, d)),
    "byte_offsets": lambda s, d: compress.byte_offsets(both_ways(s, d)),
    "compression_ratio": _ratio,
    "fits_in_place": lambda s, d: compress.fits_in_place(both_ways(s, d)),
    "decoded_edges": lambda s, d: compress.compress(both_ways(s, d, "sparse")).decoded().edges,
    "bfs_dense": lambda s, d: _distances(both_ways(s, d)),
    "bfs_sparse": lambda s, d: _distances(both_ways(s, d, "sparse")),
    "bfs_hybrid_dense": lambda s, d: _distances(both_ways(s, d), mode="hybrid"),
    "bfs_bottom_up_dense": lambda s, d: _distances(both_ways(s, d), mode="bottom_up"),
    "bfs_compressed_dense": lambda s, d: traverse.bfs(compress.compress(both_ways(s, d)), SOURCE, mode="hybrid").where("dist is not null"),
    "bfs_directed": lambda s, d: _marked(traverse.bfs(directed(s, d), 0, mode="hybrid")),
    "bfs_parents": lambda s, d: traverse.bfs_parents(g := both_ways(s, d).persist(), traverse.bfs(g, SOURCE)),
    "frontier_profile": lambda s, d: traverse.frontier_profile(_distances(both_ways(s, d))),
    "bfs_summary": lambda s, d: traverse.bfs_summary(traverse.bfs(both_ways(s, d, "frag"), SOURCE)).withColumn("reachable_percent", F.round("reachable_percent", 6)),
    "traversed_edges": lambda s, d: traverse.traversed_edges(g := both_ways(s, d, "frag").persist(), traverse.bfs(g, SOURCE)),
    "reachability": lambda s, d: _marked(traverse.reachability(both_ways(s, d, "sparse"), SOURCE)),
    "cc_dense": lambda s, d: _component_rows(both_ways(s, d)),
    "cc_sparse": lambda s, d: _component_rows(both_ways(s, d, "sparse")),
    "cc_frag": lambda s, d: _component_rows(both_ways(s, d, "frag")),
    "cc_sampled": lambda s, d: _component_rows(both_ways(s, d, "sparse"), algorithm="sampled"),
    "cc_isolated": lambda s, d: _component_rows(everything(s, d)),
    "component_sizes": lambda s, d: components.component_sizes(_component_rows(both_ways(s, d, "sparse"))),
    "component_count": lambda s, d: components.component_count(_component_rows(both_ways(s, d, "frag"))),
    "label_propagation": lambda s, d: _propagated(s, d, "frag"),
    "label_propagation_full": lambda s, d: _propagated(s, d, "dense", active_only=False),
    "label_propagation_directed": lambda s, d: _propagated(s, d, "dense", directed=True),
    "order_degree": lambda s, d: reorder.degree_order(both_ways(s, d)),
    "order_bfs": lambda s, d: reorder.bfs_order(both_ways(s, d, "frag")),
    "order_gap_bfs": lambda s, d: reorder.gap_bfs_order(both_ways(s, d)),
    "relabel_edges": _relabelled,
    "wang_hash": lambda s, d: everything(s, d).vertices.select("id", wang_hash(F.col("id")).alias("hash")),
    "lcg_sample": lambda s, d: everything(s, d).vertices.select("id", lcg(F.col("id"), F.col("id")).alias("hash")),
    "sampled_neighbors": _sampled,
    "trial_stats": _trials,
}


def _edges(kind: str) -> str:
    where = f" WHERE l_quantity >= {LEAST[kind]}" if LEAST[kind] else ""
    return f"""e0 AS (SELECT DISTINCT l_orderkey * 2 AS a, l_partkey * 2 + 1 AS b FROM lineitem{where}),
 sym AS (SELECT a AS src, b AS dst FROM e0 UNION SELECT b, a FROM e0),
 v AS (SELECT DISTINCT src AS id FROM sym)"""


ALL = " UNION ".join(["SELECT o_orderkey * 2 AS id FROM orders", "SELECT p_partkey * 2 + 1 FROM part", "SELECT id FROM v"])


def _sql(kind: str, select: str, *parts: str) -> str:
    return "WITH RECURSIVE " + ",\n ".join([_edges(kind), *parts]) + "\n" + select


BFS = """r(n, d) USING KEY (n) AS (SELECT 1::BIGINT AS n, 0 AS d UNION
  (SELECT s.dst, min(r.d) + 1 FROM r JOIN sym s ON s.src = r.n
   LEFT JOIN recurring.r k ON k.n = s.dst WHERE k.n IS NULL GROUP BY s.dst))"""
CC = """c(n, l) USING KEY (n) AS (SELECT DISTINCT src, src FROM sym UNION
  (SELECT s.src, min(c.l) FROM sym s JOIN c ON c.n = s.dst
   JOIN recurring.c k ON k.n = s.src GROUP BY s.src, k.l HAVING min(c.l) < k.l))"""
DEG = "deg AS (SELECT src AS id, count(*) AS deg FROM sym GROUP BY src)"
ROW = """step AS (SELECT src, dst, dst - lag(dst, 1, 0) OVER (PARTITION BY src ORDER BY dst) AS delta FROM sym),
 bytes AS (SELECT src AS id, sum(CASE WHEN delta < 128 THEN 1 WHEN delta < 16384 THEN 2 WHEN delta < 2097152 THEN 3
   WHEN delta < 268435456 THEN 4 ELSE 5 END)::BIGINT AS n_bytes FROM step GROUP BY src)"""
STREAM = "stream AS (SELECT id, coalesce(sum(n_bytes) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_start, n_bytes FROM bytes)"
WANG = """(WITH a AS (SELECT {x} & 4294967295 AS h), b AS (SELECT (xor(xor(h, 61), h >> 16) * 9) & 4294967295 AS h FROM a),
  c AS (SELECT (xor(h, h >> 4) * 668265261) & 4294967295 AS h FROM b) SELECT xor(h, h >> 15) FROM c)"""
DISTANCES = "SELECT n AS id, d::INT AS dist FROM r"
LABELS = "SELECT n AS id, l AS component FROM c"

IDS = "ids AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM v)"
#: Searches from their roots (n, late), all at once: a vertex's level, and its place there.
ORDER = """o(n, root, late, d, k) USING KEY (n) AS (
  SELECT root, root, late, 0, row_number() OVER (ORDER BY late, root) FROM roots UNION
  (SELECT n, min(root), min(late), min(d) + 1, row_number() OVER (ORDER BY min(k), n)
   FROM (SELECT s.dst AS n, o.root, o.late, o.d, o.k FROM o JOIN {edges} s ON s.src = o.n
     LEFT JOIN recurring.o AS w ON w.n = s.dst WHERE w.n IS NULL) GROUP BY n))"""
ORDERED = "SELECT n AS old_id, row_number() OVER (ORDER BY late, root, d, k) - 1 AS new_id FROM o"
ROOTS = """start AS ({start}), own AS (SELECT l FROM c WHERE n = (SELECT id FROM start)),
 roots AS (SELECT id AS root, 0 AS late FROM start UNION ALL SELECT DISTINCT l, 1 FROM c WHERE l <> (SELECT l FROM own))"""

ORACLE = {
    "edges_in_range": _sql("sparse", "SELECT src, dst FROM sym WHERE src BETWEEN 0 AND 999 AND dst BETWEEN 0 AND 999"),
    **{k: _sql("sparse", "SELECT x.k AS src, y.k AS dst FROM sym JOIN ids x ON x.id = src JOIN ids y ON y.id = dst", IDS) for k in ("edge_list_round_trip", "csrbin_round_trip")},
    "reordered_file": _sql("sparse", "SELECT row_number() OVER (ORDER BY deg DESC, id DESC) - 1 AS id, deg FROM deg", DEG),
    **{k: "SELECT 1000::BIGINT AS num_nodes, 20000::BIGINT AS num_edges, 20.0::DOUBLE AS avg_degree" for k in ("uniform_graph", "banded_graph")},
    "random_graph": "SELECT 2000::BIGINT AS num_nodes, true AS bounded, 0::BIGINT AS misplaced",
    "frontier_classes": _sql(
        "dense", """SELECT d::INT AS dist, CASE WHEN deg < 32 THEN 'small' WHEN deg < 1024 THEN 'medium' ELSE 'large' END AS deg_class, count(*) AS n
        FROM r JOIN deg ON deg.id = r.n GROUP BY 1, 2""", BFS, DEG),
    "byte_classes": _sql("dense", "SELECT CASE WHEN n_bytes < 32 THEN 'small' ELSE 'large' END AS byte_class, count(*) AS n FROM bytes GROUP BY 1", ROW),
    "compressed_neighbors": _sql("dense", "SELECT src, dst FROM sym WHERE src = 1"),
    "compressed_rows": _sql("sparse", "SELECT id, deg, n_bytes FROM bytes JOIN deg USING (id)", DEG, ROW),
    "bfs_mismatches": _sql("sparse", "SELECT n AS id, 1::INT AS a, d::INT AS b FROM r WHERE d > 1", BFS),
    "bfs_validated": "SELECT variant, 0::BIGINT AS wrong FROM (VALUES ('bottom_up'), ('hybrid'), ('compressed')) t(variant)",
    "traverse_auto": _sql("frag", "SELECT id, coalesce(d, -1)::INT AS dist FROM v LEFT JOIN r ON n = id", BFS),
    "traverse_over_limit": _sql(
        "frag", "SELECT n AS id, CASE WHEN n = 1 THEN 0 WHEN l = (SELECT l FROM c WHERE n = 1) THEN 1 ELSE -1 END::INT AS dist FROM c", CC),
    "round_sample": _sql(
        "sparse", """SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k,
        count(*) OVER (PARTITION BY src) AS deg FROM sym) WHERE k = (((src & 4294967295) * 1664525 + 1013904223 + 1) & 4294967295) % deg"""),
    "order_bfs": _sql("frag", ORDERED, CC, DEG, ROOTS.format(start="SELECT id FROM deg ORDER BY deg DESC, id LIMIT 1"), ORDER.format(edges="sym")),
    "order_gap_bfs": _sql("dense", ORDERED, CC, ROOTS.format(start="SELECT min(id) AS id FROM v"), ORDER.format(edges="sym")),
    #: Orders point to parts, so a part belongs to the search of its least order, or to its own where it comes first.
    "order_bfs_directed": _sql(
        "frag", """SELECT id AS old_id, row_number() OVER (ORDER BY root, d, id) - 1 AS new_id
        FROM (SELECT DISTINCT a AS id, a AS root, 0 AS d FROM e0 UNION ALL
        SELECT b, least(b, min(a)), CASE WHEN b < min(a) THEN 0 ELSE 1 END FROM e0 GROUP BY b)"""),
    "bytes_moved": _sql(
        "dense", """SELECT 8 * (n + 1) + 4 * m + 12 * n AS held, 3 * (8 * (n + 1) + 8 * m + 4 * n) AS moved,
        round(3 * (8 * (n + 1) + 8 * m + 4 * n) / 2e6, 6)::DOUBLE AS gb_s FROM (SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FROM sym) AS m)"""),
    "speedups": """SELECT variant, round(ms, 6) AS ms, round((SELECT avg(l_quantity) FROM lineitem WHERE l_returnflag = 'A') / ms, 6) AS speedup
        FROM (SELECT l_returnflag AS variant, avg(l_quantity) AS ms FROM lineitem GROUP BY 1)""",
    "degree_stats": _sql(
        "frag", """SELECT count(*) AS num_nodes, sum(d)::BIGINT AS num_edges, min(d) AS min_degree, max(d) AS max_degree, round(avg(d), 9) AS avg_degree
        FROM (SELECT id, coalesce(deg, 0) AS d FROM every LEFT JOIN deg USING (id))""", DEG, f"every AS ({ALL})"),
    "degree_class_counts": _sql(
        "dense", """SELECT CASE WHEN deg <= 32 THEN 'small' WHEN deg <= 1024 THEN 'medium' ELSE 'large' END AS deg_class, count(*) AS n FROM deg GROUP BY 1""", DEG),
    "degrees": _sql("frag", "SELECT id, coalesce(deg, 0) AS deg FROM every LEFT JOIN deg USING (id)", DEG, f"every AS ({ALL})"),
    "max_degree_node": _sql("dense", "SELECT id, deg FROM deg ORDER BY deg DESC, id LIMIT 1", DEG),
    "isolated_vertices": _sql("frag", "SELECT id FROM every WHERE id NOT IN (SELECT id FROM v)", f"every AS ({ALL})"),
    "symmetrize": _sql("sparse", "SELECT src, dst FROM sym"),
    "csr_row_ptr": _sql(
        "frag", """SELECT id, (e - d)::BIGINT AS row_start, e::BIGINT AS row_end FROM (SELECT id, coalesce(deg, 0) AS d,
        sum(coalesce(deg, 0)) OVER (ORDER BY id) AS e FROM every LEFT JOIN deg USING (id))""", DEG, f"every AS ({ALL})"),
    "validate_csr": _sql("dense", "SELECT (SELECT count(*) FROM sym WHERE src NOT IN (SELECT id FROM v)) AS violations, count(*) AS num_nodes FROM v"),
    "adjacency_delta": _sql("sparse", "SELECT src, dst, delta FROM step", ROW),
    "varint_row_bytes": _sql("dense", "SELECT id, n_bytes FROM bytes", ROW),
    "byte_offsets": _sql("dense", "SELECT id, byte_start, byte_start + n_bytes AS byte_end FROM stream", ROW, STREAM),
    "compression_ratio": _sql(
        "dense", """SELECT (SELECT count(*) * 4 FROM sym) AS raw_bytes, sum(n_bytes)::BIGINT AS compressed_bytes,
        round((SELECT count(*) * 4 FROM sym) / sum(n_bytes), 6) AS ratio FROM bytes""", ROW),
    "fits_in_place": _sql(
        "dense", """SELECT id, byte_start + n_bytes <= 4 * sum(deg) OVER (ORDER BY id) AS fits FROM stream JOIN deg USING (id)""", DEG, ROW, STREAM),
    "decoded_edges": _sql("sparse", "SELECT src, dst FROM sym"),
    "bfs_sparse": _sql("sparse", DISTANCES, BFS),
    "bfs_directed": _sql("dense", "SELECT id, CASE WHEN id = 0 THEN 0 WHEN id IN (SELECT b FROM e0 WHERE a = 0) THEN 1 ELSE -1 END::INT AS dist FROM v"),
    "bfs_parents": _sql(
        "dense", """SELECT n AS id, 1::BIGINT AS parent FROM r WHERE d = 0 UNION ALL
        SELECT a.n, min(s.src) FROM r a JOIN sym s ON s.dst = a.n JOIN r b ON b.n = s.src AND b.d + 1 = a.d GROUP BY a.n""", BFS),
    "frontier_profile": _sql("dense", "SELECT d::INT AS dist, count(*) AS n FROM r GROUP BY d", BFS),
    "bfs_summary": _sql(
        "frag", """SELECT (SELECT count(*) FROM v) AS num_nodes, count(*) AS reachable,
        round(count(*) * 100.0 / (SELECT count(*) FROM v), 6)::DOUBLE AS reachable_percent, max(d)::INT AS max_distance FROM r""", BFS),
    "traversed_edges": _sql("frag", "SELECT count(*) AS traversed_edges FROM sym JOIN r ON r.n = sym.src", BFS),
    "reachability": _sql(
        "sparse", "SELECT n AS id, CASE WHEN n = 1 THEN 0 WHEN l = (SELECT l FROM c WHERE n = 1) THEN 1 ELSE -1 END::INT AS dist FROM c", CC),
    "cc_dense": _sql("dense", LABELS, CC),
    "cc_sparse": _sql("sparse", LABELS, CC),
    "cc_frag": _sql("frag", LABELS, CC),
    "cc_sampled": _sql("sparse", LABELS, CC),
    "cc_compressed": _sql("sparse", LABELS, CC),
    "cc_rounds": _sql("sparse", LABELS, CC),
    "cc_isolated": _sql("frag", "SELECT id, coalesce(l, id) AS component FROM every LEFT JOIN c ON n = id", CC, f"every AS ({ALL})"),
    "component_sizes": _sql("sparse", "SELECT l AS component, count(*) AS size FROM c GROUP BY l", CC),
    "component_count": _sql("frag", "SELECT count(DISTINCT l) AS num_components FROM c", CC),
    "label_propagation": _sql("frag", "SELECT n AS id, l AS label FROM c", CC),
    "label_propagation_full": _sql("dense", "SELECT n AS id, l AS label FROM c", CC),
    "label_propagation_directed": _sql("dense", "SELECT id, least(id, coalesce(m, id)) AS label FROM v LEFT JOIN (SELECT a AS id, min(b) AS m FROM e0 GROUP BY a) USING (id)"),
    "order_degree": _sql("dense", "SELECT id AS old_id, row_number() OVER (ORDER BY deg DESC, id DESC) - 1 AS new_id FROM deg", DEG),
    "relabel_edges": _sql(
        "sparse", "SELECT x.k AS src, y.k AS dst FROM sym JOIN o x ON x.id = src JOIN o y ON y.id = dst", DEG,
        "o AS (SELECT id, row_number() OVER (ORDER BY deg DESC, id DESC) - 1 AS k FROM deg)"),
    "wang_hash": _sql("frag", f"SELECT id, {WANG.format(x='id')} AS hash FROM every", f"every AS ({ALL})"),
    "lcg_sample": _sql("frag", "SELECT id, ((id & 4294967295) * 1664525 + 1013904223 + id) & 4294967295 AS hash FROM every", f"every AS ({ALL})"),
    "sampled_neighbors": _sql(
        "sparse", """SELECT src AS id, dst AS neighbor FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k,
        count(*) OVER (PARTITION BY src) AS deg FROM sym) JOIN h ON h.id = src WHERE (k - hash % deg + deg) % deg < 2""",
        f"h AS (SELECT id, {WANG.format(x='id')} AS hash FROM v)"),
    "trial_stats": """SELECT count(l_quantity)::INT AS num_trials, round(min(l_quantity), 6) AS min_ms, round(max(l_quantity), 6) AS max_ms,
        round(avg(l_quantity), 6) AS mean_ms, round(median(l_quantity), 6) AS median_ms, round(stddev_pop(l_quantity), 6) AS std_dev_ms,
        round(4000000 / (avg(l_quantity) * 1e6), 6) AS gteps FROM lineitem""",
} | {k: _sql("dense", DISTANCES, BFS) for k in ("bfs_dense", "bfs_hybrid_dense", "bfs_bottom_up_dense", "bfs_compressed_dense", "bfs_compressed_top_down", "bfs_partitioned")}
