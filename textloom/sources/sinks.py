"""Writers; every write is a directory with Spark's commit marker, which is also the completeness mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, *partition: str, mode: str = "overwrite") -> None:
    """JSON Lines; with partition columns a folder for each of their values. Stale parts go with overwrite."""
    w = df.write.mode(mode)
    (w.partitionBy(*partition) if partition else w).json(path)


def in_parts(df: DataFrame, path: str, group: str, order: str, size: int = 800) -> None:
    """Parts of exactly `size` rows in order (the last may be shorter), one folder a group and part."""
    w = Window.partitionBy(group).orderBy(order)
    jsonl(df.withColumn("part", F.floor((F.row_number().over(w) - 1) / size)), path, group, "part")


def aligned_text(df: DataFrame, folder: str, left: str, right: str, order: str) -> None:
    """Two text files of equal length, a line a row in order; line ends inside a value become spaces."""
    for name in (left, right):
        line = F.regexp_replace(F.coalesce(name, F.lit("")), r"[\r\n]+", " ").alias("value")
        df.select(order, line).orderBy(order).select("value").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


def upserted(log: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """The log with newer rows, the latest of each key; write it beside the old one and swap."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return log.unionByName(rows, allowMissingColumns=True).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def is_complete(spark, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
