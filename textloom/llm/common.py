"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words in every contract of this subpackage (fixed values).
SPACE = r"\x20\x09-\x0D"
#: Lets Spark delete a query's shuffle files when it has ended, rather than at some later garbage collection.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where it is unset, a local session (tests) gets one of its own; on a
    cluster that raises, since executors and driver share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="textloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_scope: ContextVar[list[str] | None] = ContextVar("staged tables", default=None)


def _delete(spark: SparkSession, path: str) -> None:
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def discard(df: DataFrame) -> None:
    """Delete the table behind a result of staged(), which nothing may read any more."""
    if path := _paths.pop(df, None):
        _delete(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """At the end, delete what has been staged inside, but for tables whose name is in `keep`.

    Whatever reads the other tables must be written by then. Without a scratch around it, a lazy result leaves its tables
    to the retention of the shared folder. Scopes belong to a thread or task, so that concurrent jobs don't meet.
    """
    tables: list[str] = []
    token = _scope.set(tables)
    try:
        yield
    finally:
        _scope.reset(token)
        for path in tables:
            if path.rsplit("/", 1)[1].rsplit("-", 1)[0] not in keep:
                _delete(spark, path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    Cuts lineage and outlives lost executors; unlike checkpoint() it keeps column pruning and size statistics.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if (tables := _scope.get()) is not None:
        tables.append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before or "false")
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unique_and_other(docs: DataFrame, id_col: str, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose id no other row has, and the rest (null or repeated ids), staged with a number of each row, `_row`.

    The largest long goes with the rest, since null ids count as that.
    """
    known = docs.where(F.col(id_col) < 2**63 - 1)
    repeated = staged(known.groupBy(F.col(id_col).alias("_id")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("_id"), f"{name}-repeated")
    same = F.col(id_col) == F.col("_id")
    rest = docs.where(F.col(id_col).isNull() | (F.col(id_col) == 2**63 - 1)).unionByName(known.join(repeated, same, "left_semi"))
    return known.join(repeated, same, "left_anti"), staged(rest.withColumn("_row", F.monotonically_increasing_id()), f"{name}-rest")
