"""Intermediate tables that all executors share and that survive lost ones."""

from __future__ import annotations

import atexit
import itertools
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


#: Written tables that haven't been discarded: path -> number.
_written: dict[str, int] = {}
_numbers = itertools.count()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir.  Where it is unset, a folder of our own, on one machine only: executors elsewhere would
    each write to a disk of their own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="lodestar-")
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: lineage is cut, and the planner knows the size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestar/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written[path] = next(_numbers)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodestar_path = path
    return out


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """As `materialise`, with the number of rows, which is counted as they are written."""
    seen = Observation()
    out = materialise(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, int(seen.get["n"])


class Pieces:
    """A table that grows piece by piece.  Beyond `most` pieces they are written as one, so that plans stay short and a
    row is rewritten a few times only, however many pieces there are.  Pieces are written tables, and deleted then, but for
    the last two."""

    def __init__(self, first: DataFrame, most: int = 12):
        self.most, self.ages = most, [(0, first)]

    def add(self, piece: DataFrame) -> None:
        self.ages.append((0, piece))
        while len(same := [k for k, (age, _) in enumerate(self.ages) if age == self.ages[-1][0]]) >= self.most:
            age, old = self.ages[-1][0], [self.ages[k][1] for k in same]
            whole = materialise(reduce(DataFrame.unionByName, old), "pieces")
            for piece in old if age else old[:-2]:  # the last two as they came may still be read
                discard(piece)
            self.ages = [x for k, x in enumerate(self.ages) if k not in same] + [(age + 1, whole)]

    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, [piece for _, piece in self.ages])


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
    _written.pop(path, None)


def discard(df: DataFrame) -> None:
    """Delete a table that `materialise` wrote and that nothing reads any more."""
    path = getattr(df, "_lodestar_path", None)
    if path:
        _delete(df.sparkSession, path)


def settled(df: DataFrame, name: str, begun: int, *kept: DataFrame) -> DataFrame:
    """Write df, and delete the tables that were written on the way to it, since `begun`, but for some."""
    out = materialise(df, name)
    stay = {x._lodestar_path for x in (out, *kept)}
    for path in [p for p, n in _written.items() if n > begun and p not in stay]:
        _delete(df.sparkSession, path)
    return out


def begin() -> int:
    """A mark for `settled`: the number of the last table so far."""
    return next(_numbers)
