"""Corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def box_statistics(rows: DataFrame, group: str, value: str) -> DataFrame:
    """group, n, q1, median, q3, low and high whisker (within 1.5 interquartile ranges), outliers; quartiles are exact."""
    q = rows.groupBy(group).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    limits = q.select(group, *[F.col("q")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))]).withColumns({"_lo": F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), "_hi": F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))})
    inside = F.col(value).between(F.col("_lo"), F.col("_hi"))
    return rows.join(limits, group).groupBy(group, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(inside, F.col(value))).cast("double").alias("low"), F.max(F.when(inside, F.col(value))).cast("double").alias("high"), F.count_if(~inside).alias("outliers")
    )


def class_shares(rows: DataFrame, group: str, label: str, top: int = 7, keep: int = 6, default: str = "UNKNOWN") -> DataFrame:
    """group, label, n, percent of the `keep` most frequent labels: of the `top` overall, without the default label. The
    percentage is of all rows of the group."""
    named = rows.withColumn(label, F.coalesce(label, F.lit(default)))
    counts = named.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy(label).agg(F.sum("n").alias("_all")).orderBy(F.desc("_all"), label).limit(top).where(F.col(label) != default).orderBy(F.desc("_all"), label).limit(keep)
    whole = Window.partitionBy(group)
    return counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(whole), 6)).join(F.broadcast(best.select(label)), label)  # at most `keep` rows


def totals(rows: DataFrame, book: str) -> DataFrame:
    """Rows a book and, with a null book, of all."""
    return rows.rollup(book).agg(F.count(F.lit(1)).alias("n"))
