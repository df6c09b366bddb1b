"""Row numbers inside groups that one task need not hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType


def row_numbers(rows: DataFrame, group: str, order: list[str], name: str, pieces: int | None = None) -> DataFrame:
    """Adds `name`, the row number (from 0) inside the group in the given order, nulls first.

    The first column of the order is cut at approximate quantiles of the whole table, read once beforehand, so that a task
    sorts about 1 / pieces (two for each shuffle partition, 1,000 at most) of all rows however large a group is; a count of each (group, piece) gives its offset. Ties in
    the whole order are numbered in any order. A first column that is no number, date or time is not cut.
    """
    by = order[0]
    kind, piece = rows.schema[by].dataType, F.lit(0)
    if isinstance(kind, (NumericType, DateType, TimestampType, TimestampNTZType)):
        pieces = pieces or min(1000, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        shares = ", ".join(str(i / pieces) for i in range(1, pieces))
        found = rows.agg(F.expr(f"cast(percentile_approx(`{by}`, array({shares})) as array<string>)")).first()[0] if shares else None
        if found:  # one foldable expression, since hundreds of literals take long to plan
            limits = F.split(F.lit(",".join(dict.fromkeys(found))), ",").cast(f"array<{kind.simpleString()}>")
            piece = F.size(F.filter(limits, lambda b: b < F.col(by)))
    cut = rows.withColumn("_piece", piece)
    before = Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(F.col(group).alias("_g"), F.col("_piece").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_g", "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy(group, "_piece").orderBy(*order)
    return (
        cut.withColumn("_own", F.row_number().over(own) - 1)
        .join(offsets, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_piece") == F.col("_p")))
        .withColumn(name, (F.col("_before") + F.col("_own")).cast("long"))
        .drop("_piece", "_own", "_g", "_p", "_before")
    )
