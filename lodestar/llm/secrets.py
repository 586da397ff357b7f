"""Secret scan over a trigram index, with DataFrame functions only.

From each rule's expression a Boolean trigram query is derived.  One pass over the texts posts the
trigrams that occur in any query; postings are intersected by conjunction, and only the candidates
of a rule are verified with its expression.  Rules without a mandatory trigram scan every text.

The candidates (a key and its rules each) are written out first, so that the join that brings them
to the texts is a broadcast only where Spark finds them below its size limit, and a shuffle beyond.

Defined cases: a null text is empty and has no spans; repeated rows each get a row; documents are
matched by 64 bits over id and text, where a clash could only add candidates, and those are
verified; spans are in code points, end exclusive, and may overlap between kinds; an empty table
gives an empty result; extra columns are kept by `redact` and ignored elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import P, materialise, text_of
from .trigrams import ANY, trigram_query


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches count if the given group has min_length characters."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    min_length: int = 0
    base: bool = False

    @property
    def java(self) -> str:
        return "(?i)" * self.ignore_case + self.pattern


#: The expressions of the base rules, then of well-known key formats.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", False, 0, 24, True),
    #: To the END line; without one, over headers and up to 200 base64 lines, which is beyond RSA keys of 16,384 bits.
    #: A group without a bound would exhaust Java's stack on long texts.
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]+-{1,4}){0,99}[^-]*-----END [A-Z ]*PRIVATE KEY-----"
         r"|(?:[\x20\x09-\x0D]*(?:Proc-Type|DEK-Info):[\x20\x09]*[A-Za-z0-9,-]+){0,4}"
         r"(?:[\x20\x09-\x0D]*(?:\\[nr]){0,2}" + "[A-Za-z0-9+/]" * 16 + r"[A-Za-z0-9+/]*=?=?){0,200}(?:[\x20\x09-\x0D]*[A-Za-z0-9+/]{2,}={1,2})?)"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("url", r"://[A-Za-z0-9._~%+-]+:[A-Za-z0-9._~%+-]+@"),
)

SPAN = "array<struct<start:bigint,rank:int,end:bigint,kind:string>>"


def _scans_fully(rule: Rule) -> bool:
    query = trigram_query(rule.pattern)
    return query == ANY or frozenset() in query


def postings(docs: DataFrame, trigrams: list[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The inverted index of these trigrams: a row (trigram, key) for each that a lower-cased text holds."""
    low = docs.select(
        F.xxhash64(F.col(doc_id), text_of(text)).alias(P + "key"), F.lower(text_of(text)).alias(P + "low")
    )
    held = F.filter(F.array(*[F.lit(t) for t in trigrams]), lambda t: F.contains(F.col(P + "low"), t))
    return low.select(P + "key", F.explode(held).alias(P + "trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(key, rules): the rules whose trigram query a document satisfies.  Rules that scan fully are not among them.
    There is no limit on rules, or on the trigrams of a query."""
    wanted = []  # (trigram, rule, conjunction, trigrams in the conjunction)
    for k, rule in enumerate(rules):
        if _scans_fully(rule):
            continue
        query = trigram_query(rule.pattern)
        for c, conjunction in enumerate(sorted(map(sorted, query))):
            wanted += [(t, k, c, len(conjunction)) for t in conjunction]
    spark = docs.sparkSession
    query = F.broadcast(spark.createDataFrame(wanted, f"{P}trigram string, rule int, part int, size int"))  # a few rows a rule
    index = postings(docs, sorted({w[0] for w in wanted}), text, doc_id)
    return (
        index.join(query, P + "trigram")
        .groupBy(P + "key", "rule", "part", "size")
        .agg(F.size(F.collect_set(P + "trigram")).alias("got"))  # of a conjunction's trigrams
        .where("got = size")
        .groupBy(P + "key")
        .agg(F.collect_set("rule").alias(P + "rules"))
    )


def _spans(df: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds P + spans, in order of start and then of rule, from P + text and P + rules."""
    text = F.col(P + "text")
    none = F.array().cast("array<string>")
    for k, rule in enumerate(rules):
        #: The pieces between matches give their places; without a match there is one piece.
        due = text.rlike(rule.java)
        if not _scans_fully(rule):
            due = F.array_contains(P + "rules", k)
        pattern = F.lit(rule.java)
        df = df.withColumns({
            f"{P}m{k}": F.when(due, F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none),
            f"{P}g{k}": F.when(due, F.regexp_extract_all(text, pattern, F.lit(rule.group))).otherwise(none),
            f"{P}p{k}": F.when(due, F.split(text, rule.java)).otherwise(none),
        })
    found = []
    for k, rule in enumerate(rules):
        matches, groups, pieces = (F.col(f"{P}{c}{k}") for c in "mgp")
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

        def step(a: Column, x: Column) -> Column:
            begin = a["at"] + F.length(x["p"])
            end = begin + F.length(x["m"])
            span = F.struct(begin.alias("start"), F.lit(k).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"))
            kept = F.when(F.length(x["g"]) >= rule.min_length, F.concat(a["out"], F.array(span))).otherwise(a["out"])
            return F.struct(end.alias("at"), kept.cast(SPAN).alias("out"))

        zipped = F.arrays_zip(matches.alias("m"), groups.alias("g"), F.slice(pieces, 1, F.size(matches)).alias("p"))
        found.append(F.when(F.size(matches) > 0, F.aggregate(zipped, start, step, lambda a: a["out"])).otherwise(F.array().cast(SPAN)))
    df = df.withColumn(P + "spans", F.sort_array(F.concat(*found)))
    return df.drop(*[f"{P}{c}{k}" for c in "mgp" for k in range(len(rules))])


def _scanned(docs: DataFrame, rules: tuple[Rule, ...], text: str, doc_id: str, keep: list[Column]) -> DataFrame:
    hits = materialise(candidates(docs, rules, text, doc_id), "secret-candidates")
    left = docs.select(
        *keep, F.col(doc_id).alias(P + "id"), text_of(text).alias(P + "text"),
        F.xxhash64(F.col(doc_id), text_of(text)).alias(P + "key"),
    )
    return _spans(left.join(hits, P + "key", "left"), rules)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, spans) of every document; a span has start, rank (of its rule), end and kind."""
    return _scanned(docs, rules, text, doc_id, []).select(F.col(P + "id").alias("doc_id"), F.col(P + "spans").alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id", mark: str = "[secret]") -> DataFrame:
    """The documents with their columns; spans, merged where they overlap, give way to the mark, and n_chars follows."""
    df = _scanned(docs, rules, text, doc_id, [F.col(c) for c in docs.columns])
    whole = F.col(P + "text")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(a: Column, s: Column) -> Column:
        apart = F.concat(a["out"], F.substring(whole, (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")), F.lit(mark))
        out = F.when((s["start"] >= a["at"]) & ((a["at"] > 0) | (a["out"] == "")), apart).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    def finish(a: Column) -> Column:
        return F.concat(a["out"], F.substring(whole, (a["at"] + 1).cast("int"), F.length(whole)))

    new = F.when(F.size(P + "spans") > 0, F.aggregate(F.col(P + "spans"), start, step, finish)).otherwise(F.col(text))
    df = df.withColumn(P + "new", new)
    out = {text: F.col(P + "new").alias(text)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out["n_chars"] = F.when(F.size(P + "spans") > 0, F.length(P + "new").cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
    return df.select(*[out.get(c, F.col(c)) for c in docs.columns])


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts and digests of the spans of `scan`."""

    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)

    base = [k for k, rule in enumerate(rules) if rule.base]
    return found.select(
        "doc_id", *[count(rules[k].kind) for k in base],
        F.sha2(line(F.filter("spans", lambda s: s["rank"].isin(base))), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"),
    )
