"""Approximate nearest neighbours along shifted space-filling curves.

Equal vectors are one class.  Several orderings sort the classes along Hilbert curves, each through a
random rotation, projected to a few dimensions and shifted.  The keys are range-partitioned in
Spark, which gives each class a rank in each ordering.  A query's candidates are the classes
within a window of ranks around its own, in any ordering; they are ranked by exact distances.  A
candidate carries its ranks, so that its distance is taken in the first ordering that has it near, and not again.

Window and number of orderings are measured, not assumed: for a bounded sample of queries the true neighbours are
found by brute force over all vectors.  For each number of orderings the window is the one that holds the wanted share of
them, and the share of all vectors that become candidates is measured over a bounded sample too.  The fewest orderings
with a small share are taken, or else those with the least share.  Every vector is indexed.

Ranks are cut into blocks of fixed size, and the queries in reach of a block into chunks of bounded size; pairs of a
chunk and a block are worked off a bounded number at a time.  So a task's memory is bounded whatever the window and
however many queries lie close together.  Where vectors have structure the window stays small.  Where they have
none at all, the window that holds nine tenths of the neighbours grows with their number, as no index helps there.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part,
nor do rows without an id; vectors of different lengths are searched apart; repeated rows count
once; a query's own id is never among its neighbours; ties go to the smaller id; with fewer
candidates than asked for all are returned; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import begin, materialise, settled

SCHEMA = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class Curves:
    """orderings: the numbers of orderings to choose from, each of `dimensions` projected coordinates with `bits` bits
    each (at most 64 bits in all).  sample: vectors that the projections are fitted on, the first `trials` of which
    measure the window that holds `recall` of the neighbours.  share: of vectors that become candidates, below which
    no more orderings are tried.  block: ranks in a block; chunk: about how many queries meet a block at a time."""

    orderings: tuple[int, ...] = (4, 8, 16, 32)
    dimensions: int = 8
    bits: int = 8
    sample: int = 2048
    trials: int = 192
    recall: float = 0.94
    share: float = 0.05
    block: int = 4096
    chunk: int = 2048
    seed: int = 7


#: Pairs of a query and a candidate that are looked at at a time.
PAIRS = 400_000


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """The places along a Hilbert curve of cells (rows of coordinates under 2**bits), as signed 64-bit keys.

    The transpose form of the curve: coordinates are un-reflected and un-rotated bit by bit from the
    top, then Gray-decoded, and their bits are interleaved.
    """
    x = cells.astype(np.uint64).T.copy()
    zero = np.uint64(0)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(len(x)):
            reflect = (x[i] & bit) != zero
            swap = np.where(reflect, zero, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(reflect, low, swap)
            x[i] ^= swap
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flips = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flips ^= np.where((x[-1] >> np.uint64(level)) & np.uint64(1) != zero, np.uint64((1 << level) - 1), zero)
    x ^= flips
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for row in x:
            key = (key << np.uint64(1)) | ((row >> np.uint64(level)) & np.uint64(1))
    return (key ^ np.uint64(1 << 63)).view(np.int64)


class Orderings:
    """Rotations, scales and shifts, fitted on a sample."""

    def __init__(self, sample: np.ndarray, how: Curves):
        rng, size = np.random.default_rng(how.seed), sample.shape[1]
        self.bits, dimensions = how.bits, min(how.dimensions, size)
        self.frames = []
        for _ in range(max(how.orderings)):
            turn = np.linalg.qr(rng.normal(size=(size, size)))[0][:, :dimensions]
            seen = sample @ turn
            low = seen.mean(0) - 3 * seen.std(0)
            width = np.maximum(6 * seen.std(0), 1e-300)
            self.frames.append((turn, low, width, rng.random(dimensions) * 0.2))

    def keys(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        top = 1 << self.bits
        for turn, low, width, shift in self.frames:
            place = ((vectors @ turn - low) / width * 0.8 + shift) * top
            yield hilbert_keys(np.clip(place, 0, top - 1).astype(np.uint64), self.bits)


def _matrix(column: pa.Array | pa.ChunkedArray, size: int, kind: type = np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), -1 if len(column) else max(size, 0))


def _nearest(queries: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: the k nearest vectors and some that rounding can't tell from them, at most 4 k, and their exact distances."""
    squares = (vectors * vectors).sum(1)
    for a in range(0, len(queries), 64):
        rough = squares - 2 * queries[a : a + 64] @ vectors.T  # ranks like the squared distance, but for rounding
        for q, row in enumerate(rough, a):
            bound = np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf
            few = np.flatnonzero(row <= bound + 1e-9 * (1 + abs(bound))) if len(row) > k else np.arange(len(row))
            few = few[np.lexsort((few, ((vectors[few] - queries[q]) ** 2).sum(1)))][: 4 * k]
            yield q, few, np.sqrt(((vectors[few] - queries[q]) ** 2).sum(1))


def _classes(vectors: DataFrame) -> DataFrame:
    """(cid, n, v): each distinct vector, its smallest id and number of ids."""
    return vectors.groupBy("v").agg(F.min("id").alias("cid"), F.count("*").alias("n")).select("cid", "n", "v")


def _members(vectors: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(cid, id): the k + 1 smallest ids of each class.  Large classes are cut down in parts first."""
    several = vectors.join(classes.where("n > 1").select("cid", "v"), "v").select("cid", "id")
    part = F.pmod(F.xxhash64("id"), F.lit(64))
    few = several.withColumn("part", part).withColumn("r", F.row_number().over(Window.partitionBy("cid", "part").orderBy("id")))
    few = few.where(F.col("r") <= k + 1).select("cid", "id")
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("cid").orderBy("id"))).where(F.col("r") <= k + 1).select("cid", "id")
    return few.unionByName(classes.where("n = 1").select("cid", F.col("cid").alias("id")))


def _ranks(classes: DataFrame, orderings: Orderings, size: int, n: int, parts: int) -> DataFrame:
    """(l, rank, cid): the place of each class in each ordering."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for l, keys in enumerate(orderings.keys(_matrix(batch.column(1), size))):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), l, np.int32)), pa.array(keys), batch.column(0)], ["l", "key", "cid"]
                )

    keyed = classes.select("cid", "v").mapInArrow(run, "l int, key long, cid long")
    placed = keyed.repartitionByRange(parts, "l", "key", "cid").sortWithinPartitions("l", "key", "cid")
    placed = materialise(placed.select("l", "cid", F.monotonically_increasing_id().alias("at")), "curve")
    part = F.shiftright("at", 33)
    sizes = sorted(placed.groupBy(part.alias("p")).count().collect())  # a row a partition
    begins = np.cumsum([0, *[c for _, c in sizes]])[:-1].tolist()
    offsets = classes.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, begins)], "p long, begin long")
    ranked = placed.join(F.broadcast(offsets), part == F.col("p"))
    within = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.select("l", "cid", (F.col("begin") + within - F.col("l") * F.lit(n)).alias("rank"))


def _plan(classes: DataFrame, ranks: DataFrame, sample: list, how: Curves, k: int, size: int) -> tuple[int, int, float]:
    """(number of orderings, window, share of vectors that become candidates), as measured on the sample."""
    ids = [cid for cid, _ in sample[: how.trials]]
    trials = np.array([v for _, v in sample[: how.trials]], np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids = batch.column(0).to_numpy()
            rows = [(ids[q], cids[f], d[j]) for q, few, d in _nearest(trials, _matrix(batch.column(1), size), k + 1) for j, f in enumerate(few)]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()))], ["q", "cid", "d"])

    found = classes.select("cid", "v").mapInArrow(run, "q long, cid long, d double").where("q <> cid")
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "cid"))).where(F.col("r") <= k)
    true = [(r["q"], r["cid"]) for r in best.select("q", "cid").collect()]  # trials * k rows
    if not true:
        return how.orderings[0], 2 * k, 1.0
    wanted = sorted({c for pair in true for c in pair} | {cid for cid, _ in sample})
    named = F.broadcast(classes.sparkSession.createDataFrame([(c,) for c in wanted], "cid long"))
    at = {r["cid"]: r["at"] for r in ranks.join(named, "cid").select("cid", "at").collect()}  # sample + trials * k rows
    near = np.abs(np.array([at[a] for a, _ in true]) - np.array([at[b] for _, b in true]))
    seen = np.array([at[cid] for cid, _ in sample])
    plans = []
    for m in how.orderings:
        apart = np.sort(near[:, :m].min(axis=1))
        window = max(2 * k, int(apart[min(len(apart) - 1, int(how.recall * len(apart)))]))
        share = float(np.mean([(np.abs(seen[:, :m] - np.array(at[c])[:m]).min(axis=1) <= window).mean() for c in ids]))
        plans.append((m, window, share))
        if share <= how.share:
            return plans[-1]
    return min(plans, key=lambda plan: plan[2])


def _meet(left: pa.Table, right: pa.Table, size: int, window: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, candidate, distance) of the k nearest classes, in a block of an ordering, that no ordering before has near."""
    l = left["l"][0].as_py()
    q_at, c_at = (_matrix(x["at"], -1, np.int64) for x in (left, right))
    q_v, c_v, q_ids, c_ids = _matrix(left["v"], size), _matrix(right["v"], size), left["cid"].to_numpy(), right["cid"].to_numpy()
    by = np.argsort(c_at[:, l], kind="stable")
    along = c_at[by, l]
    low = np.searchsorted(along, q_at[:, l] - window)
    width = np.searchsorted(along, q_at[:, l] + window, "right") - low
    cuts = [0]
    for q, n in enumerate(width.tolist()):  # a query meets a block of rows at most
        if int(width[cuts[-1] : q + 1].sum()) > PAIRS and q > cuts[-1]:
            cuts.append(q)
    for a, b in zip(cuts, [*cuts[1:], len(width)]):
        n = width[a:b]
        q = np.repeat(np.arange(a, b), n)
        c = by[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + low[q]]
        keep = q_ids[q] != c_ids[c]
        q, c = q[keep], c[keep]
        for before in range(l):
            keep = np.abs(q_at[q, before] - c_at[c, before]) > window
            q, c = q[keep], c[keep]
        far = np.empty(len(q))
        for i in range(0, len(q), 20_000):
            apart = c_v[c[i : i + 20_000]] - q_v[q[i : i + 20_000]]
            far[i : i + 20_000] = np.sqrt((apart * apart).sum(1))
        order = np.lexsort((c_ids[c], far, q))
        q, c, far = q[order], c[order], far[order]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
        nth = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        yield q_ids[q[nth < k]], c_ids[c[nth < k]], far[nth < k]


def _search(vectors: DataFrame, size: int, is_query: Column, k: int, how: Curves) -> DataFrame:
    """Neighbours among vectors (id, v) of one length."""
    spark, begun = vectors.sparkSession, begin()
    classes = materialise(_classes(vectors), "classes")
    n = classes.count()
    rows = classes.orderBy(F.xxhash64("cid"), "cid").limit(how.sample).select("cid", "v").collect()
    sample = [(r["cid"], r["v"]) for r in rows]
    orderings = Orderings(np.array([v for _, v in sample], np.float64), how)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranks = _ranks(classes, orderings, size, n, parts)
    kind = "array<int>" if n < 1 << 31 else "array<long>"
    listed = F.transform(F.sort_array(F.collect_list(F.struct("l", "rank"))), lambda x: x["rank"]).cast(kind)  # a rank an ordering
    ranks = materialise(ranks.groupBy("cid").agg(listed.alias("at")), "ranks")
    m, window, _ = _plan(classes, ranks, sample, how, k, size)

    asked = vectors.where(is_query).join(classes.select("cid", "v"), "v").select("id", "cid")
    asked = materialise(asked, "asked")
    seekers = asked.select("cid").distinct()
    placed = ranks.withColumn("at", F.slice("at", 1, m)).join(classes.select("cid", "v"), "cid")
    rank = F.col("rank").cast("long")
    held = placed.select("cid", "v", "at", F.posexplode("at").alias("l", "rank")).withColumn("block", F.floor(rank / how.block))
    first, last = F.floor(F.greatest(rank - window, F.lit(0)) / how.block), F.floor(F.least(rank + window, F.lit(n - 1)) / how.block)
    reach = ranks.withColumn("at", F.slice("at", 1, m)).join(seekers, "cid", "left_semi").select("cid", F.posexplode("at").alias("l", "rank"))
    reach = materialise(reach.select("cid", "l", F.explode(F.sequence(first, last)).alias("block")), "reach")
    chunks = reach.groupBy("l", "block").agg(F.ceil(F.count("*") / how.chunk).cast("int").alias("chunks"))
    chunks = materialise(chunks, "chunks")
    sent = reach.join(chunks, ["l", "block"]).withColumn("chunk", F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int"))
    names = ["l", "block", "chunk", "cid", "at", "v"]
    sent = sent.join(placed, "cid").select(*[F.col(c).alias("q_" + c) for c in names])
    held = held.join(chunks, ["l", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.rename_columns([c.removeprefix("q_") for c in left.column_names])
        out = list(_meet(left, right, size, window, k + 1)) if left.num_rows and right.num_rows else []
        columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table({"q": pa.array(columns[0], pa.int64()), "cid": pa.array(columns[1], pa.int64()), "d": pa.array(columns[2], pa.float64())})

    place = ["l", "block", "chunk"]
    asking = sent.groupBy(*["q_" + c for c in place])
    met = asking.cogroup(held.select(*names).groupBy(*place)).applyInArrow(meet, "q long, cid long, d double")
    own = seekers.select(F.col("cid").alias("q"), "cid", F.lit(0.0).alias("d"))
    close = met.unionByName(own).withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "cid"))).where(F.col("r") <= k + 1)
    listed = (
        close.select("q", "cid", "d").join(_members(vectors, classes, k), "cid")
        .groupBy("q").agg(F.sort_array(F.collect_list(F.struct("d", "id"))).alias("found"))  # at most (k + 1)^2 ids
    )
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k)
    answers = asked.join(listed, F.col("cid") == F.col("q")).select(F.col("id").alias("query_id"), F.posexplode(others).alias("r", "x"))
    answers = answers.select("query_id", (F.col("r") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.d").alias("score"))
    return settled(answers, "neighbours", begun)


def neighbours(
    table: DataFrame, k: int = 10, every: int = 100, how: Curves = Curves(), vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row whose id is divisible by `every`."""
    v = F.col("v")
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    vectors = (
        table.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
        .where("id is not null and v is not null")
        .where(F.coalesce(whole, F.lit(False)))
        .dropDuplicates(["id", "v"])
    )
    sizes = [r[0] for r in vectors.select(F.size("v").alias("s")).distinct().orderBy("s").collect()]  # one, as a rule
    found = [_search(vectors.where(F.size("v") == s), s, F.col("id") % every == 0, k, how) for s in sizes]
    return reduce(DataFrame.unionByName, found) if found else table.sparkSession.createDataFrame([], SCHEMA)
