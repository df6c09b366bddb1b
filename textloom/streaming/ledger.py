"""Incremental batches with a ledger of states: what remains to do, and how a state leads to the next step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed", "expired", "cancelled")


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The latest row of each key; later columns of `order` break ties."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return events.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def next_step(status: Column) -> Column:
    """download, wait, retry or submit."""
    return F.when(status == "completed", "download").when(status.isin("in_progress", "validating", "finalizing"), "wait").when(status.isin("failed", "expired", "cancelled"), "retry").otherwise("submit")


def remaining(requests: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Requests whose latest state is not completed."""
    return requests.join(ledger.where("status = 'completed'").select(key).distinct(), key, "left_anti")


def run_batches(requests: DataFrame, call: Callable[[DataFrame], DataFrame] | None, key: str = "key") -> DataFrame:
    """Responses of a batch service given as a function of DataFrames; None is a dry run, which gives the requests with an
    empty response. A deterministic stand-in for tests is `echo`."""
    return call(requests) if call else requests.select(key, F.lit("").alias("response"))


def echo(requests: DataFrame) -> DataFrame:
    return requests.select("key", F.concat(F.lit("english_translation: "), F.col("prompt")).alias("response"))


def follow(spark, folder: str, schema: str, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame]):
    """Process each new file of a folder once, through Structured Streaming with available-now triggers."""
    rows = spark.readStream.schema(schema).json(folder)
    return transform(rows).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
