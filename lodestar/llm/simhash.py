"""SimHash near-duplicates by a generalised pigeonhole search.

Every text gets a 64-bit fingerprint.  The search for fingerprints within a Hamming distance works on
distinct fingerprints: correlated bits are grouped into blocks, blocks into partitions, and a dynamic
programme gives each partition its own threshold, from -1 (not searched) up, such that any pair within
the distance must be within the threshold of some partition.  Partitions and thresholds are chosen
by the cost that follows from counts over all fingerprints.  Probing a partition means one key for
each way to flip up to its threshold of bits; candidates are verified on all 64 bits.

Where many fingerprints share a key, pairs would grow with the square of their number.  Those
fingerprints are linked through their neighbours instead: two of them are within an even distance 2r
exactly if flips of at most r bits on either side lead to one value, so every fingerprint posts those
values, and all that post a value are linked to the least of them.  No link is lost, and the rows
are in proportion to the fingerprints.

Defined cases: texts without words have fingerprint zero and are linked like others; texts with
fewer words than a shingle are one shingle; a null text is empty; a null id takes part, and a
component is named by its smallest id (null if it has none); repeated rows each get a row; an empty
table gives an empty result; other columns are ignored, or kept by `keep_first`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import least_labels
from .common import P, begin, identity, lookup, materialise, settled, text_of

BITS = 64
#: Bits of a block, whose 2**BLOCK values are counted.
BLOCK = 8
#: Fingerprints under one key from which on they are linked by neighbours, not in pairs.
CROWD = 64


def fingerprint(text: str, width: int = 3, seed: int = 42) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    words = text.encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    if width == 3 and n > 1:
        shingles = [b"%b %b %b" % x for x in zip(words, words[1:], words[2:])]
    else:
        shingles = [b" ".join(words[i : i + width]) for i in range(n)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], "<u8")
    counts = np.zeros(BITS, np.int64)
    for k in range(0, n, 65536):
        counts += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, key, fp) of every document: 128 bits of its id and text, and the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width, seed) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps)], ["doc_id", "key", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), identity(doc_id, text).alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, key binary, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _tally(fps: DataFrame, count, size: int) -> np.ndarray:
    """The sum over all fingerprints of a function that gives `size` counts: a bounded array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += count(batch.column(0).to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["k", "n"])

    rows = fps.select("fp").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(size, np.int64)
    for k, n in rows:
        out[k] = n
    return out


@dataclass(frozen=True)
class Plan:
    """Partitions, as bit masks, and the threshold of each."""

    masks: tuple[int, ...]
    thresholds: tuple[int, ...]
    cost: float


def bit_blocks(together: np.ndarray, n: int) -> list[list[int]]:
    """Blocks of correlated bits, from how often each two bits are set together (BITS x BITS)."""
    share = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    bond = np.abs(together / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread)
    left, blocks = list(range(BITS)), []
    while left:
        block = [left.pop(0)]
        while len(block) < BLOCK:
            best = max(left, key=lambda b: (bond[b, block].sum(), -b))
            left.remove(best)
            block.append(best)
        blocks.append(block)
    return blocks


def distances(counts: np.ndarray) -> np.ndarray:
    """The distribution of the Hamming distance between two draws from the values of a block."""
    share = counts / max(counts.sum(), 1)
    values = np.arange(len(counts))
    apart = np.bitwise_count(values[:, None] ^ values[None, :])
    return np.bincount(apart.ravel(), np.outer(share, share).ravel(), BLOCK + 1)


def choose_plan(blocks: list[list[int]], spreads: list[np.ndarray], n: int, limit: int) -> Plan:
    """Partitions and thresholds of least cost: keys to post and probe, plus candidates to verify."""
    best = None
    for m in range(1, len(blocks) + 1):
        groups = [blocks[i * len(blocks) // m : (i + 1) * len(blocks) // m] for i in range(m)]
        masks = [sum(1 << b for block in g for b in block) for g in groups]
        first = np.cumsum([0, *map(len, groups)])
        costs = []  # of partition i at threshold t, from t = -1
        for i, g in enumerate(groups):
            apart = reduce(np.convolve, spreads[first[i] : first[i + 1]])
            width, row = BLOCK * len(g), [0.0]
            for t in range(min(limit, width) + 1):
                keys = sum(comb(width, k) for k in range(t + 1))
                row.append(n * (keys + (t > 0)) + n * n / 2 * float(apart[: t + 1].sum()))
            costs.append(row)
        # the thresholds must sum to limit - m + 1
        table = {0: (0.0, ())}
        for row in costs:
            after: dict[int, tuple[float, tuple[int, ...]]] = {}
            for total, (cost, chosen) in table.items():
                for k, c in enumerate(row):
                    new = (cost + c, (*chosen, k - 1))
                    if total + k - 1 not in after or new < after[total + k - 1]:
                        after[total + k - 1] = new
            table = after
        if (found := table.get(limit - m + 1)) and (best is None or found[0] < best.cost):
            best = Plan(tuple(masks), found[1], found[0])
    return best


def plan_search(fps: DataFrame, limit: int) -> Plan:
    """The plan for distinct fingerprints, from counts over all of them."""

    def pairs(x: np.ndarray) -> np.ndarray:
        bits = _bits(x).astype(np.float64)
        return (bits.T @ bits).astype(np.int64).ravel()

    n = fps.count()
    blocks = bit_blocks(_tally(fps, pairs, BITS * BITS).reshape(BITS, BITS), n)

    def values(x: np.ndarray) -> np.ndarray:
        bits = _bits(x).astype(np.int64)
        out = [np.bincount(bits[:, b] @ (1 << np.arange(BLOCK)), minlength=1 << BLOCK) for b in blocks]
        return np.concatenate(out)

    counts = _tally(fps, values, len(blocks) << BLOCK).reshape(len(blocks), -1)
    return choose_plan(blocks, [distances(c) for c in counts], n, limit)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _flips(bits: list[int], most: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(most + 1) for c in combinations(bits, k)]


def _near(a: str, b: str, limit: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= limit


def links(fps: DataFrame, limit: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect whatever is connected within the limit."""
    if limit % 2:
        raise ValueError("the distance must be even")
    plan = plan_search(fps, limit)
    posted, probes = [], []
    for i, (mask, t) in enumerate(zip(plan.masks, plan.thresholds)):
        if t < 0:
            continue
        key = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        posted.append(fps.select(F.lit(i).alias("part"), key.alias("key"), "fp"))
        flips = _flips([b for b in range(BITS) if mask >> b & 1], t)
        if t:
            keys = F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: key.bitwiseXOR(x))
            probes.append(fps.select(F.lit(i).alias("part"), F.explode(keys).alias("key"), "fp"))
        else:
            probes.append(posted[-1])
    posted, probes = (reduce(DataFrame.unionByName, x) for x in (posted, probes))
    sizes = posted.groupBy("part", "key").agg(F.count("*").alias("n"))
    #: Probes see each other only through keys that are posted; a lone poster is met by probes with flips.
    met = sizes if any(t > 0 for t in plan.thresholds) else sizes.where("n > 1")
    keyed = materialise(probes.join(met, ["part", "key"]), "probes")
    quiet = keyed.where(F.col("n") <= CROWD).drop("n").withColumnRenamed("fp", "a")
    partners = posted.join(met.where(F.col("n") <= CROWD).drop("n"), ["part", "key"]).withColumnRenamed("fp", "b")
    pairs = quiet.join(partners, ["part", "key"]).where(F.col("a") != F.col("b")).where(_near("a", "b", limit)).select("a", "b")

    crowded = keyed.where(F.col("n") > CROWD).select("fp").distinct()
    around = F.transform(F.array(*[F.lit(x) for x in _flips(list(range(BITS)), limit // 2)]), lambda x: F.col("fp").bitwiseXOR(x))
    near = crowded.select("fp", F.explode(around).alias("value"))
    least = near.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").select("value", "b")
    stars = near.join(least, "value").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars)


def _classes(hashed: DataFrame, limit: int) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint: the component's least fingerprint and smallest id."""
    begun = begin()
    distinct = materialise(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = materialise(links(distinct.select("fp"), limit), "links")
    linked = distinct.join(least_labels(found, "a", "b").select(F.col("id").alias("fp"), F.col("component").alias("root")), "fp")
    linked = materialise(linked, "linked")
    names = linked.groupBy("root").agg(F.min("least").alias("name"))
    #: A component may hold a large share of all fingerprints.
    named = lookup(linked, names, ["root"]).select("fp", "root", "name")
    joined = distinct.join(named, "fp", "left")
    found = joined.select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("name", "least").alias("component_id"))
    return settled(found, "classes", begun)


def components(docs: DataFrame, limit: int = 2, width: int = 3, seed: int = 42, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    hashed = materialise(fingerprints(docs, width, seed, text, doc_id), "fingerprints")
    digits = F.lower(F.lpad(F.hex("fp"), BITS // 4, "0"))
    return lookup(hashed, _classes(hashed, limit), ["fp"]).select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_first(
    docs: DataFrame, limit: int = 2, width: int = 3, seed: int = 42, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """One document of each component, with its columns: that with the smallest id.  Ids that are null come
    last; of rows with one id, the one that a hash of id and text picks stays."""
    hashed = materialise(fingerprints(docs, width, seed, text, doc_id), "fingerprints")
    ranked = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("key").alias("key"))
    first = lookup(hashed, _classes(hashed, limit), ["fp"]).groupBy("root").agg(F.min(ranked).alias("first"))
    chosen = materialise(first.select(F.col("first.key").alias(P + "key")), "chosen")
    keyed = docs.withColumn(P + "key", identity(doc_id, text))
    return keyed.join(chosen, P + "key", "left_semi").dropDuplicates([P + "key"]).select(*docs.columns)
