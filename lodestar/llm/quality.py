"""Quality rules on documents, with DataFrame functions only.

Two kinds of rule are applied.  The base rules look at one text: too few words, or too large a
part of it in repeated three-word windows.  The cross-document rule looks at a host: lines are
normalised and hashed, the distinct documents of the host that hold a line are counted, a line
above the limit is removed, and a document that is depleted by this is rejected.

Defined cases:

* a null or empty text has no words and fails the base rules;
* a null host is a host of its own;
* copies of a text on one host count as one document and get one verdict, as do repeated rows;
* a frequent line goes from all documents of the host; with `keep_first`, the one with the smallest id
  that holds it keeps it (ties between texts under one id go to the smaller hash);
* an empty table gives an empty result; extra columns are kept by `filter_documents` and are
  otherwise ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, P, text_of, words_of


@dataclass(frozen=True)
class QualityRules:
    """min_words and max_repeat_percent: the base rules.  A line is above the limits if it stands in more than
    max_line_documents of the host's distinct documents, or, on a small host, in at least min_line_documents and in
    more than max_line_percent of them.  A document is depleted if under min_left_percent of its words are left."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_line_documents: int = 10
    max_line_percent: int = 10
    max_line_documents: int = 100
    min_left_percent: int = 30
    keep_first: bool = False


def _normalised(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, SPACE + "+", " ")))


def _host(column: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def _stats(df: DataFrame) -> DataFrame:
    """Adds the base figures, from a column P + text.

    Each step is a projection of its own: the arrays are then computed once a row, and the lambda
    functions below refer to columns, not to expressions that would be evaluated for each element.
    """
    text, words, hashes, order = (F.col(P + c) for c in ("text", "words", "hashes", "order"))
    df = df.withColumn(P + "words", words_of(text))
    df = df.withColumn(P + "n_words", F.size(words).cast("long")).withColumn(
        P + "hashes",
        F.when(
            F.size(words) >= 3,
            F.transform(
                F.sequence(F.lit(0), F.size(words) - 3),
                lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
            ),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn(P + "lines", lines)
    #: Windows in order of their hash, where any is repeated; most texts skip the sort.
    df = df.withColumn(
        P + "order",
        F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
    )
    repeated = F.filter(
        order,
        lambda x, j: ((j > 0) & (F.get(order, j - 1)["h"] == x["h"]))
        | F.coalesce(F.get(order, j + 1)["h"] == x["h"], F.lit(False)),
    )
    df = df.withColumn(P + "at", F.sort_array(F.transform(repeated, lambda x: x["i"])))
    covered = F.aggregate(
        F.col(P + "at"),
        F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
        lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(3), i - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    figures = {
        "n_words": F.col(P + "n_words"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(P + "lines") - F.size(F.array_distinct(F.col(P + "lines")))).cast("long"),
        "n_repeat_words": covered.cast("long"),
    }
    #: A filter on a figure would be pushed below all these steps and be evaluated there as one nested
    #: expression, in quadratic time; a number that is not deterministic keeps it above them.
    df = df.select("*", F.monotonically_increasing_id().alias(P + "row"), *[x.alias(P + "raw_" + c) for c, x in figures.items()])
    df = df.withColumns({P + c: F.when(F.col(P + "row") >= 0, F.col(P + "raw_" + c)) for c in figures})
    return df.drop(*[P + "raw_" + c for c in figures], *[P + c for c in ("row", "words", "hashes", "order", "at", "lines")])


def removable_lines(docs: DataFrame, rules: QualityRules, text: str, host: str, doc_id: str) -> DataFrame:
    """(host, text hash, hashes of the lines to remove, words in them) of each distinct text that holds any."""
    h, t, line, n = P + "host", P + "t", P + "line", P + "n"
    parts = F.transform(
        F.filter(F.split(text_of(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: _normalised(x)
    )
    hashed = F.transform(
        parts, lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).cast("long").alias("w"))
    )
    distinct = (
        docs.select(_host(host).alias(h), F.xxhash64(text_of(text)).alias(t), F.col(doc_id).alias(P + "id"), hashed.alias(P + "parts"))
        .groupBy(h, t)
        .agg(F.min(P + "id").alias(P + "id"), F.first(P + "parts").alias(P + "parts"))
    )
    lines = (
        distinct.select(h, t, P + "id", F.explode(P + "parts").alias("x"))
        .groupBy(h, F.col("x.h").alias(line), t)
        .agg(F.sum("x.w").alias(P + "w"), F.first(P + "id").alias(P + "id"))
    )
    counts = (
        lines.groupBy(h, line)
        .agg(F.count("*").alias(n), F.min(F.struct(F.col(P + "id").isNull(), F.col(P + "id"), F.col(t).alias("t"))).alias(P + "first"))
        .where(F.col(n) >= rules.min_line_documents)
    )
    hosts = distinct.groupBy(h).agg(F.count("*").alias(P + "of"))
    frequent = (
        counts.join(hosts, h)
        .where((F.col(n) * 100 > F.col(P + "of") * rules.max_line_percent) | (F.col(n) > rules.max_line_documents))
        .select(h, line, F.col(P + "first.t").alias(P + "keeper"))
    )
    return (
        lines.join(frequent, [h, line])
        .where((F.col(t) != F.col(P + "keeper")) | ~F.lit(rules.keep_first))
        .groupBy(h, t)
        .agg(F.collect_list(line).alias(P + "remove"), F.sum(P + "w").alias(P + "removed"))
    )


def _judged(docs: DataFrame, rules: QualityRules, text: str, host: str, doc_id: str, keep: list[Column]) -> DataFrame:
    left = docs.select(*keep, F.col(doc_id).alias(P + "id"), _host(host).alias(P + "host"), text_of(text).alias(P + "text"))
    stats = _stats(left.withColumn(P + "t", F.xxhash64(P + "text")))
    n, repeat = F.col(P + "n_words"), F.col(P + "n_repeat_words")
    failed = (n < rules.min_words) | (repeat * 100 > n * rules.max_repeat_percent)
    removed = F.coalesce(F.col(P + "removed"), F.lit(0))
    depleted = (n - removed) * 100 < n * rules.min_left_percent
    return (
        stats.join(removable_lines(docs, rules, text, host, doc_id), [P + "host", P + "t"], "left")
        .withColumn(P + "base_failed", failed)
        .withColumn(P + "kept", ~failed & ~depleted)
    )


def quality_report(
    docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", host: str = "source", doc_id: str = "doc_id"
) -> DataFrame:
    """One row a document: its figures, base_failed, and kept."""
    judged = _judged(docs, rules, text, host, doc_id, [])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(F.col(P + "id").alias("doc_id"), *[F.col(P + c).alias(c) for c in names])


def filter_documents(
    docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", host: str = "source", doc_id: str = "doc_id"
) -> DataFrame:
    """The kept documents, with all their columns, without the frequent lines.  A column n_chars is brought up to date where a text changes."""
    rest = [F.col(c) for c in docs.columns]
    judged = _judged(docs, rules, text, host, doc_id, rest).where(F.col(P + "kept"))
    left = F.array_join(
        F.filter(F.split(P + "text", "\n"), lambda x: ~F.array_contains(F.col(P + "remove"), F.xxhash64(_normalised(x)))), "\n"
    )
    changed = F.col(P + "remove").isNotNull()
    judged = judged.withColumn(P + "new", F.when(changed, left).otherwise(F.col(text)))
    out = {text: F.col(P + "new").alias(text)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(changed, F.length(P + "new").cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return judged.select(*[out.get(c, F.col(c)) for c in docs.columns])
