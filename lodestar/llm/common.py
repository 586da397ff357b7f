"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import begin, discard, materialise, settled, shared_dir  # noqa: F401

#: White space that separates words, as a character class of Java, RE2 and Python alike.
SPACE = r"[\x20\x09-\x0D]"
#: Internal columns carry this prefix, so that a caller's extra columns can't clash with them.
P = "__ls_"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A text column with null taken as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def identity(doc_id: str, text: str) -> Column:
    """128 bits that tell a row from all with another id or text."""
    return F.unhex(F.md5(F.concat_ws(" ", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(text_of(text)))))


def words_of(text: Column) -> Column:
    """Maximal runs without ASCII white space."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def lookup(rows: DataFrame, named: DataFrame, keys: list[str], counts: str | None = None) -> DataFrame:
    """rows joined (inner, null keys left out) with what `named` has for their keys, one row a key.

    Keys with over a ten-thousandth of the counted rows, of which there are at most 10,000, are broadcast, so that no task gets
    all rows of a frequent key.  Both are written tables, or cheap to read twice.  counts: the column of `named` that
    has the rows of a key, or more than those, where that is known.
    """
    of = named.select(*keys, F.col(counts).alias(P + "n")) if counts else rows.groupBy(*keys).agg(F.count("*").alias(P + "n"))
    total, most = of.agg(F.sum(P + "n"), F.max(P + "n")).first()
    bound = max(32, (total or 0) / 10_000)
    if (most or 0) <= bound:
        return rows.join(named, keys)
    often = of.where(F.col(P + "n") > bound).select(*keys)
    often = F.broadcast(materialise(often, "often"))  # at most 10,000 rows
    rest = rows.join(often, keys, "left_anti").join(named, keys)
    return rows.join(F.broadcast(named.join(often, keys, "left_semi")), keys).unionByName(rest)
