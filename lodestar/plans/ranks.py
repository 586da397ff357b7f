"""Global ranks and running sums without a window over a single partition.

Rows are range-partitioned and sorted, written with their place in their partition, and moved by the
totals of the partitions before; only those totals, a row a partition, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .tables import materialise

_PLACE = (1 << 33) - 1


def _spread(df: DataFrame, order: list, partitions: int | None) -> DataFrame:
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def _with(df: DataFrame, *fields: tuple) -> StructType:
    """A schema of its own: `StructType.add` changes the one that df keeps."""
    return StructType([*df.schema.fields, *(StructField(*f) for f in fields)])


def _offsets(placed: DataFrame, total: Column) -> DataFrame:
    rows = sorted(placed.groupBy(F.shiftright("__at", 33).alias("p")).agg(total.alias("n")).collect())
    begins = np.cumsum([0, *[r["n"] for r in rows]])[:-1].tolist()
    pairs = [(r["p"], b) for r, b in zip(rows, begins)]
    return F.broadcast(placed.sparkSession.createDataFrame(pairs, "__p long, __begin long"))  # a row a partition


def numbered(df: DataFrame, order: list, name: str, partitions: int | None = None) -> DataFrame:
    """Adds a column with 0, 1, 2, ... in the given order."""
    placed = materialise(_spread(df, order, partitions).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    joined = placed.join(_offsets(placed, F.count("*")), F.shiftright("__at", 33) == F.col("__p"))
    rank = F.col("__begin") + F.col("__at").bitwiseAND(F.lit(_PLACE))
    return joined.select(*df.columns, rank.alias(name))


def running_sum(df: DataFrame, order: list, value: str, name: str, partitions: int | None = None) -> DataFrame:
    """Adds the sum of a bigint column over all rows before, in the given order."""
    schema = _with(df, ("__at", LongType()), ("__sum", LongType()))
    place = df.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = 0
        for batch in batches:
            x = batch.column(place).to_numpy().astype(np.int64)
            sums = np.cumsum(x) + before
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums - x)], names=[*batch.schema.names, "__sum"])
            before = int(sums[-1]) if len(sums) else before

    spread = _spread(df, order, partitions).withColumn("__at", F.monotonically_increasing_id())
    placed = materialise(spread.mapInArrow(run, schema), "sums")
    joined = placed.join(_offsets(placed, F.sum(value)), F.shiftright("__at", 33) == F.col("__p"))
    return joined.select(*df.columns, (F.col("__begin") + F.col("__sum")).alias(name))


def previous(df: DataFrame, order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """Adds, as a struct, the row before in the order of bigint columns; null for the first one.  No window, so that
    rows with one value in a column needn't meet in one task."""
    kind = StructType([StructField(c, LongType()) for c in order])
    schema = _with(df, ("__at", LongType()), (name, kind))
    places = [df.columns.index(c) for c in order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[int | None] = [None] * len(order)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).cast(pa.int64()) for i in places]
            before = [pa.concat_arrays([pa.array([x], pa.int64()), c.slice(0, len(c) - 1)]) for x, c in zip(last, columns)]
            absent = np.zeros(batch.num_rows, bool)
            absent[0] = last[0] is None
            row = pa.StructArray.from_arrays(before, order, mask=pa.array(absent))
            last = [c[-1].as_py() for c in columns]
            yield pa.RecordBatch.from_arrays([*batch.columns, row], names=[*batch.schema.names, name])

    spread = _spread(df, order, partitions).withColumn("__at", F.monotonically_increasing_id())
    placed = materialise(spread.mapInArrow(run, schema), "previous")
    part = F.shiftright("__at", 33)
    ends = sorted(placed.groupBy(part.alias("p")).agg(F.max(F.struct(*order)).alias("x")).collect())  # a row a partition
    pairs = [(after["p"], tuple(before["x"])) for before, after in zip(ends, ends[1:])]
    carried = F.broadcast(df.sparkSession.createDataFrame(pairs, StructType([StructField("__p", LongType()), StructField("__x", kind)])))
    joined = placed.join(carried, part == F.col("__p"), "left")
    return joined.select(*df.columns, F.coalesce(name, "__x").alias(name))
