"""Toxicity classifier with counterfactual regularisation.

A logistic regression over the words of a text and their beginnings and ends.  Beside the labels it
learns from counterfactuals: identity terms in labelled sentences are swapped for others of their
kind and for a neutral word, and changes of the score are penalised, so that naming a group moves
the score as little as the labels allow.  The same swaps on the bare terms cover groups that the
sample does not name.

The classifier is fitted on a bounded sample of labelled rows (`max_rows`, `max_characters`); scoring
reads every text whole, in one pass without a shuffle.

Defined cases: a null or empty text gets the score of no evidence; a null id is held out; labels
other than 0 and 1 are ignored, and of contradictory labels the higher counts; repeated rows each
get a row and count once in the sample; without labels of both kinds all scores are the share of
label 1 (0.5 without any label); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import plain
from .common import text_of

#: Identity terms by kind, the last of each kind being its neutral word.
IDENTITY = (
    ("women", "men", "girls", "boys", "females", "males", "people"),
    ("woman", "man", "girl", "boy", "female", "male", "person"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "religious"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "believers"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer", "human"),
    ("black", "white", "asian", "latino", "african", "european", "human"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens", "people"),
    ("femmes", "hommes", "musulmans", "juifs", "gens"),
    ("frauen", "männer", "muslime", "juden", "leute"),
    ("mujeres", "hombres", "musulmanes", "judíos", "gente"),
)

_LETTERS = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[bytes]:
    """The distinct words of a text: runs of letters in lower case."""
    low = text.lower()
    if plain(text):
        return set(low.encode().translate(_LETTERS).split())
    return {w.encode() for w in _WORD.findall(low)}


def features(word: bytes) -> list[bytes]:
    """The word, its beginnings and its ends."""
    return [
        b"=" + word,
        *(b"<" + word[:k] for k in range(3, 7) if len(word) > k),
        *(b">" + word[-k:] for k in range(3, 7) if len(word) > k),
    ]


@dataclass(frozen=True)
class Training:
    """Bounds of the sample, and the settings of the fit.  A missed label 1 weighs as much as
    positive_weight false alarms."""

    max_rows: int = 8192
    max_characters: int = 64_000_000
    min_documents: int = 4
    min_z: float = 4.0
    max_features: int = 8192
    l2: float = 1e-3
    positive_weight: float = 3.0
    counterfactual: float = 1.0
    steps: int = 400
    identity: tuple[tuple[str, ...], ...] = IDENTITY


@dataclass(frozen=True)
class Model:
    bias: float
    weights: dict[bytes, float]


def _standing(held: set[bytes], index: dict[bytes, int]) -> set[int]:
    return {index[f] for w in held for f in features(w) if f in index}


def fit(texts: list[str], labels: list[int], how: Training = Training()) -> Model:
    y = np.array(labels, np.float64)
    n, positive = len(y), int(y.sum())
    if positive in (0, n):
        return Model(_logit((positive + 0.5) / (n + 1)), {})
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    held = [words(t) for t in texts]
    for h, label in zip(held, labels):
        counts[label].update({f for w in h for f in features(w)})

    def z(f: bytes) -> float:
        a, b = counts[1][f], counts[0][f]
        share = (a + b + 1) / (n + 2)
        return (a / positive - b / (n - positive)) / math.sqrt(share * (1 - share) * (1 / positive + 1 / (n - positive)))

    often = [f for f in counts[0] | counts[1] if counts[0][f] + counts[1][f] >= how.min_documents]
    ranked = sorted(((-abs(z(f)), f) for f in often))
    index = {f: k for k, (score, f) in enumerate(ranked[: how.max_features]) if -score >= how.min_z}

    def swaps(group: tuple[bytes, ...], h: set[bytes]) -> Iterator[set[bytes]]:
        """Copies of a text with each term of a group that it names swapped for each other term."""
        for term in h.intersection(group):
            for other in group:
                if other != term:
                    yield (h - {term}) | {other}

    groups = [tuple(t.encode() for t in g) for g in how.identity]
    pairs = []  # features of a sentence, and with a term swapped
    for h in [*held, *({t} for g in groups for t in g)]:
        for g in groups:
            own = None
            for other in swaps(g, h):
                own = _standing(h, index) if own is None else own
                new = _standing(other, index)
                if own != new:
                    pairs.append((own, new))
    rows = [sorted(_standing(h, index)) for h in held]
    x = _Sparse([[(k, 1.0) for k in r] for r in rows], len(index))
    before, after = (_Sparse([[(k, 1.0) for k in sorted(pair[i])] for pair in pairs], len(index)) for i in (0, 1))
    w, bias = np.zeros(len(index)), _logit(positive / n)
    heed = np.where(y == 1, how.positive_weight, 1.0)
    m, v, mb, vb, rate = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0, 0.1
    for t in range(1, how.steps + 1):
        off = (_sigmoid(x.times(w) + bias) - y) * heed
        g = x.back(off) / n + how.l2 * w
        gb = float(off.mean())
        if pairs:  # the mean of the squared changes of the score
            p, q = _sigmoid(before.times(w) + bias), _sigmoid(after.times(w) + bias)
            dp, dq = ((2 * how.counterfactual / len(pairs)) * (q - p) * s * (1 - s) for s in (p, q))
            g += after.back(dq) - before.back(dp)
            gb += float((dq - dp).sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        a, b = 1 - 0.9**t, 1 - 0.999**t
        w -= rate * (m / a) / (np.sqrt(v / b) + 1e-8)
        bias -= rate * (mb / a) / (math.sqrt(vb / b) + 1e-8)
    return Model(bias, {f: float(w[k]) for f, k in index.items()})


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


class _Sparse:
    def __init__(self, rows: list[list[tuple[int, float]]], width: int):
        self.shape = len(rows), width
        self.row = np.array([k for k, r in enumerate(rows) for _ in r], np.int64)
        self.col = np.array([c for r in rows for c, _ in r], np.int64)
        self.value = np.array([x for r in rows for _, x in r])

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * w[self.col], self.shape[0])

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.value * e[self.row], self.shape[1])


class Scorer:
    """Scores texts; only words that begin or end like a feature are looked at closely."""

    def __init__(self, model: Model):
        self.model = model
        self.begins = {f[1:4] for f in model.weights if f[:1] in b"=<"}
        self.ends = {f[-3:] for f in model.weights if f[:1] == b">"}

    def score(self, text: str) -> float:
        begins, ends, weights = self.begins, self.ends, self.model.weights
        near = [w for w in words(text) if w[:3] in begins or w[-3:] in ends]
        found = {f for w in near for f in features(w) if f in weights}
        s = self.model.bias + math.fsum(weights[f] for f in found)
        return 1 / (1 + math.exp(-s)) if s > -700 else 0.0


def train(
    docs: DataFrame, labels: DataFrame, how: Training = Training(), text: str = "text", doc_id: str = "doc_id", label: str = "toxic"
) -> Model:
    """Fit on at most max_rows labelled rows, in the order of a hash of their ids, within max_characters."""
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("id"))
        .agg(F.max(F.col(label).cast("int")).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(how.max_rows)
    )
    known = F.broadcast(known)  # bounded by max_rows
    named = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text"))
    sizes = named.join(known, "id").groupBy("id").agg(F.max(F.length("text")).alias("n"), F.xxhash64("id").alias("h"))
    chosen, total = [], 0
    for row in sorted(sizes.collect(), key=lambda r: (r["h"], r["id"])):  # at most max_rows
        total += row["n"]
        if total > how.max_characters:
            break
        chosen.append((row["id"],))
    if not chosen:
        return Model(0.0, {})
    spark = docs.sparkSession
    ids = F.broadcast(spark.createDataFrame(chosen, f"id {docs.schema[doc_id].dataType.simpleString()}"))
    sample = named.join(ids, "id").groupBy("id").agg(F.min("text").alias("text")).join(known, "id")
    rows = sorted(sample.select("id", "text", "label").collect())
    return fit([r["text"] for r in rows], [r["label"] for r in rows], how)


def score(docs: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            scores = pa.array([scorer.score(t.as_py()) for t in batch.column(1)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], ["doc_id", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(docs[doc_id].alias("doc_id"), text_of(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learnt from: a fifth, by the CRC-32 of the id, and those without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))
