"""From spans and lines to sections: sizes, headings, islands, clusters of positions.

Every table carries an explicit ordinal; every sort and arg-max ends in it, so that results do not depend on partitions.
All windows are partitioned by book (or page), the unit the order is defined in.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import pairwise
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import n_words, strip

#: Spans that a task sorts, about.
SPANS = 200_000


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """book, line_no, text, size of the non-empty lines of every text; the size stands in for a font size: its words."""
    rows = docs.select(F.col(id_col).alias("book"), F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("line_no", "text"))
    return rows.where(strip(F.col("text")) != "").select("book", F.col("line_no").cast("long").alias("line_no"), "text", n_words(F.col("text")).cast("double").alias("size"))


def size_histogram(lines: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per size: number of lines, their code points, and the first place it occurs."""
    return lines.groupBy(*keys, "size").agg(
        F.count(F.lit(1)).alias("occurrences"), F.sum(F.length("text")).cast("long").alias("total_chars"), F.min(F.struct("book", "line_no")).alias("first")
    )


def main_size(histogram: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The size with most code points; of equals the one that occurs first."""
    best = F.max_by("size", F.struct("total_chars", -F.col("first.book"), -F.col("first.line_no")))
    return histogram.groupBy(*keys).agg(best.alias("main_size"), F.max("total_chars").alias("total_chars"))


def heading_sizes(histogram: DataFrame, body: float | Column, tolerance: float = 0.5, min_chars: int = 1, min_occurrences: int = 1, limit: int = 4) -> DataFrame:
    """The largest sizes above the body size with enough code points and occurrences, numbered as heading levels."""
    body = body if isinstance(body, Column) else F.lit(body)
    kept = histogram.where((F.col("size") > body + tolerance) & (F.col("total_chars") >= min_chars) & (F.col("occurrences") >= min_occurrences))
    top = kept.orderBy(F.desc("size"), F.desc("total_chars"), F.desc("occurrences")).limit(limit)
    return top.select((F.row_number().over(Window.orderBy(F.desc("size")))).cast("long").alias("level"), "size", "total_chars", "occurrences")  # at most `limit` rows


def sections(lines: DataFrame, level: Column, is_body: Column | None = None) -> DataFrame:
    """book, section, heading, level, text: a line whose level is not null starts a section; lines before the first go.

    The texts of body lines are joined by spaces in order. `is_body` leaves other lines out of the text.
    """
    w = Window.partitionBy("book").orderBy("line_no")
    marked = lines.withColumn("level", level).withColumn("section", F.count("level").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.col("level").isNull() if is_body is None else F.col("level").isNull() & is_body
    pieces = F.array_sort(F.collect_list(F.when(body, F.struct("line_no", strip(F.col("text")).alias("t")))))
    return (
        marked.where("section > 0")
        .groupBy("book", "section")
        .agg(
            F.max(F.when(F.col("level").isNotNull(), strip(F.col("text")))).alias("heading"),
            F.max("level").cast("long").alias("level"),
            F.array_join(F.transform(pieces, lambda p: p["t"]), " ").alias("text"),
        )
    )


def collapse_empty(found: DataFrame) -> DataFrame:
    """Runs of empty sections of one level become one, which takes in the section with text that follows: after two or more
    empty ones whatever its level, after a single one if it is of the same level. Section numbers keep their gaps."""
    w = Window.partitionBy("book").orderBy("section")
    empty = strip(F.coalesce("text", F.lit(""))) == ""
    rows = found.withColumn("_empty", empty).withColumns({"_after": F.coalesce(F.lag("_empty").over(w), F.lit(False)), "_level": F.lag("level").over(w)})
    goes_on = F.col("_empty") & F.col("_after") & F.col("level").eqNullSafe(F.col("_level"))
    rows = rows.withColumn("_run", F.sum((~goes_on).cast("int")).over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("book", "_run")))
    taken = ~F.col("_empty") & F.col("_after") & ((F.lag("_n").over(w) >= 2) | F.col("level").eqNullSafe(F.col("_level")))
    rows = rows.withColumn("_starts", (~goes_on & ~taken).cast("int")).withColumn("_group", F.sum("_starts").over(w))
    headings = F.array_sort(F.collect_list(F.struct("section", F.coalesce("heading", F.lit("")).alias("h"))))
    return rows.groupBy("book", "_group").agg(
        F.min("section").alias("section"),
        F.when(F.count(F.lit(1)) == 1, F.max("heading")).otherwise(F.array_join(F.transform(headings, lambda x: x["h"]), " ")).alias("heading"),
        F.min_by("level", "section").alias("level"),
        F.max_by("text", "section").alias("text"),
    ).select(*found.columns)


def visual_lines(spans: DataFrame, keys: Sequence[str], order: str, share: float = 0.4) -> DataFrame:
    """keys, line, n, text, x0, common_size of the lines that spans (x0, y0, y1, font, size, text) form on each page.

    By height, a span within `share` of the page's median span height of the one before is on its line. Texts are joined
    from left to right; the common size is that of the font and size with most code points, the leftmost of equals.
    """
    # one dealing of the spans serves every step, and a task has about SPANS of them; spans without a page have no lines
    pages = max(spans.sparkSession.sparkContext.defaultParallelism, -(-spans.count() // SPANS))
    spans = spans.where(reduce(and_, [F.col(k).isNotNull() for k in keys])).repartition(pages, *keys)
    w = Window.partitionBy(*keys).orderBy("y0", order)
    reach = F.percentile(F.col("y1") - F.col("y0"), F.lit(0.5)).over(Window.partitionBy(*keys)) * share
    near = F.coalesce(F.abs(F.col("y0") - F.lag("y0").over(w)) < F.col("_reach"), F.lit(False))
    lined = spans.withColumn("_reach", reach).withColumn("_starts", (~near).cast("int")).withColumn("line", F.sum("_starts").over(w).cast("long"))
    pieces = F.collect_list(F.when(strip(F.col("text")) != "", F.struct("x0", order, "text")))
    fonts = lined.groupBy(*keys, "line", "font", "size").agg(F.sum(F.length("text")).alias("c"), F.min(F.struct("x0", order)).alias("f"), F.count(F.lit(1)).alias("_n"), F.min("x0").alias("_x"), pieces.alias("_p"))
    text = F.array_join(F.transform(F.array_sort(F.flatten(F.collect_list("_p"))), lambda x: x["text"]), " ")
    return fonts.groupBy(*keys, "line").agg(F.sum("_n").alias("n"), text.alias("text"), F.min("_x").alias("x0"), F.min_by("size", F.struct(-F.col("c"), "f")).alias("common_size"))


def most_common(rows: DataFrame, keys: Sequence[str], value: str, order: str) -> DataFrame:
    """keys and the value that most of their rows have, the first of equals (then the smallest)."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("f"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("n"), "f", value)).alias(value))


def gap_clusters(spans: DataFrame, keys: Sequence[str], position: str, tie: str, share: float = 0.4) -> DataFrame:
    """Numbers the clusters of positions in each key: a gap to the one before of `share` times the median gap or more
    starts a new one. The median is exact."""
    w = Window.partitionBy(*keys).orderBy(position, tie)
    gaps = spans.withColumn("gap", F.col(position) - F.lag(position).over(w))
    medians = gaps.groupBy(*keys).agg(F.percentile("gap", F.lit(0.5)).alias("median_gap"))
    starts = F.when(F.col("gap").isNull() | (F.col("gap") >= share * F.col("median_gap")), 1).otherwise(0)
    return gaps.join(medians, list(keys)).withColumn("cluster", F.sum(starts).over(w).cast("long"))


def column_positions(spans: DataFrame, keys: Sequence[str], x: str, order: str, columns: int = 2) -> DataFrame:
    """The `columns` most frequent positions (rounded half even to two places) of each key; ties by first occurrence."""
    counts = spans.groupBy(*keys, F.bround(F.col(x), 2).alias("position")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), "first", "position")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= columns).select(*keys, "position", "n", "rank")


def merged_gaps(gaps: list[float], width: float = 0.5, top: int = 2) -> tuple[float | None, float | None]:
    """(normal, continuation) line height of a page's gaps: a value less than `width` from a group's first value joins it, in
    order of first sight; the two largest groups count, the first of equals. One group alone gives half its value as
    continuation, none gives nulls."""
    counts: dict[float, int] = {}
    for g in gaps:
        counts[round(g, 2)] = counts.get(round(g, 2), 0) + 1
    groups: dict[float, int] = {}
    for value, n in counts.items():
        near = next((g for g in groups if abs(g - value) < width), value)
        groups[near] = groups.get(near, 0) + n
    best = sorted(groups, key=lambda g: -groups[g])[:top]
    if not best:
        return None, None
    return (max(best), min(best)) if len(best) > 1 else (best[0], best[0] * 0.5)


def line_heights(spans: DataFrame, key: str, y: str, order: str) -> DataFrame:
    """merged_gaps of the distances between the distinct positions of each key, in ascending order.

    The distinct positions of a key are one row, so that Python folds thousands of keys in a batch."""

    @F.pandas_udf("normal double, continuation double")
    def fold(positions: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([merged_gaps([b - a for a, b in pairwise(at.tolist())]) for at in positions], columns=["normal", "continuation"], dtype="float64")

    place = F.col(y).cast("double") + 0.0  # no second zero
    pages = spans.groupBy(key).agg(F.array_sort(F.collect_set(F.when(~F.isnan(place), place))).alias("_at"))
    return pages.withColumn("_h", fold("_at")).select(key, "_h.normal", "_h.continuation")


def quantised(y: Column, step: float = 2.0) -> Column:
    """Rounded half even to a multiple of `step`."""
    return F.bround(y / step) * step


def forward_filled(rows: DataFrame, keys: Sequence[str], order: str, value: str, to: str) -> DataFrame:
    """The last non-null value up to each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(to, F.last(value, ignorenulls=True).over(w))


def continuation(rows: DataFrame, keys: Sequence[str], y: str, order: str, height: Column, within: float = 0.5) -> DataFrame:
    """Whether a row stands about one continuation height below the one before; false for the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("continuation", F.coalesce(F.abs(F.col(y) - F.lag(y).over(w) - height) < within, F.lit(False)))
