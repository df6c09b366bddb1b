"""Paragraphs of rules, book text, page tables and lookups over nested rows."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import estimated_tokens, strip

#: Feature, its value, and the word of a rule's description that selects it (fixed values).
FEATURE_WORDS = (
    ("gender", "Masc", "masculine"), ("gender", "Fem", "feminine"), ("number", "Plur", "plural"), ("case", "Nom", "nominative"), ("case", "Acc", "accusative"), ("case", "Dat", "dative"),
    ("case", "Gen", "genitive"), ("case", "Loc", "locative"), ("case", "Abl", "ablative"), ("case", "Voc", "vocative"), ("tense", "Past", "past"), ("tense", "Pres", "present"), ("tense", "Fut", "future"),
)


def rules_for(rules: DataFrame, description: str = "description", cap: int = 50, order: str = "ord", **features: str | None) -> DataFrame:
    """Rules whose description names a given feature value, distinct on the description, the first `cap` by order."""
    from textloom.operators.rules import distinct_on

    words = [w for f, v, w in FEATURE_WORDS if features.get(f) == v]
    low = F.lower(F.coalesce(description, F.lit("")))
    hit = F.lit(False)
    for w in words:
        hit = hit | low.contains(w)
    return distinct_on(rules.where(hit), [description], [order]).orderBy(order).limit(cap)


def bullets(rows: DataFrame, group: str, text: str, order: str, mark: str = "- ") -> DataFrame:
    """One string of lines a group, in order."""
    lines = F.array_sort(F.collect_list(F.struct(order, F.concat(F.lit(mark), F.col(text)).alias("t"))))
    return rows.where(F.col(text).isNotNull()).groupBy(group).agg(F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("bullets"))


def or_fallback(c: Column, fallback: str) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", F.lit(fallback)).otherwise(c)


def trimmed_examples(c: Column, keep: int = 2) -> Column:
    """A paragraph whose examples stand between pipes: with more than `keep` of them only the shortest by tokens stay,
    joined by " | "; the text before the first and after the last pipe stays."""
    parts = F.split(c, r"\|")
    middle = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    ranked = F.array_sort(F.transform(middle, lambda s, i: F.struct(estimated_tokens(s).alias("n"), i.alias("i"), s.alias("s"))))
    short = F.array_join(F.transform(F.slice(ranked, 1, keep), lambda x: x["s"]), " | ")
    return F.when(F.size(parts) - 2 > keep, F.concat(F.get(parts, 0), short, F.element_at(parts, -1))).otherwise(c)


def best_paragraphs(candidates: DataFrame, query: str, rule_rank: str, top_k: int, most_tokens: int = 1000, text: str = "text", ref: str = "ref_no") -> DataFrame:
    """query, rank, text: of each rule the shortest trimmed paragraph within the token limit (first reference of equals),
    distinct texts by rule rank, the first top_k of them."""
    sized = candidates.withColumn("_t", trimmed_examples(F.col(text))).withColumn("_n", estimated_tokens(F.col("_t"))).where(F.col("_n") <= most_tokens)
    best = sized.groupBy(query, rule_rank).agg(F.min_by("_t", F.struct("_n", ref)).alias("text"))
    first = best.groupBy(query, "text").agg(F.min(rule_rank).alias("_r"))
    w = Window.partitionBy(query).orderBy("_r", "text")
    return first.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k).select(query, "rank", "text")


def book_text(paragraphs: DataFrame, book: str = "book") -> DataFrame:
    """book, text: headings with level + 1 hashes (if not empty) and paragraphs, a line each. paragraphs: book, section,
    heading, level, index, text; index and text are null for a section without any."""
    body = paragraphs.where("text is not null").select(book, "section", F.col("index").cast("long").alias("o"), "text")
    heads = paragraphs.where("coalesce(heading, '') <> ''").select(book, "section", F.lit(-1).cast("long").alias("o"), F.concat(F.expr("repeat('#', coalesce(level, -1) + 1)"), F.lit(" "), "heading").alias("text")).distinct()
    lines = F.array_sort(F.collect_list(F.struct("section", "o", "text")))
    return heads.unionByName(body).groupBy(book).agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("text"))


def between_full_rows(rows: DataFrame, page: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Rows of each page from the first to one after the last that has all columns; pages without such a row go."""
    full = F.lit(True)
    for c in columns:
        full = full & (F.coalesce(c, F.lit("")) != "")
    w = Window.partitionBy(page)
    marked = rows.withColumns({"_a": F.min(F.when(full, F.col(order))).over(w), "_b": F.max(F.when(full, F.col(order))).over(w)})
    return marked.where(F.col(order).between(F.col("_a"), F.col("_b") + 1)).drop("_a", "_b")


def dictionary_pages(rows: DataFrame, page: str, columns: Sequence[str], min_rows: int = 25, max_length: float = 50.0, max_breaks: int = 4) -> DataFrame:
    """Pages that look like dictionary columns: many short rows, few of which don't continue the one before."""
    length = sum((F.length(F.coalesce(c, F.lit(""))) for c in columns), F.lit(0))
    found = rows.groupBy(page).agg(F.count(F.lit(1)).alias("n_rows"), F.avg(length).alias("avg_length"), F.count_if(~F.coalesce("continuation", F.lit(False))).alias("breaks"))
    return found.where((F.col("n_rows") > min_rows) & (F.col("avg_length") < max_length) & (F.col("breaks") < max_breaks))


def averaged_rows(ys: list[float], within: float = 2.0) -> list[int]:
    """Row of each height, in order: a height joins when within reach of the row's running middle, which then moves half
    way towards it."""
    out, row, middle = [], -1, None
    for y in ys:
        if middle is not None and abs(y - middle) <= within:
            middle = (middle + y) / 2
        else:
            row, middle = row + 1, y
        out.append(row)
    return out


def group_by_height(spans: DataFrame, page: str, y: str, order: str, within: float = 2.0) -> DataFrame:
    """Adds row, averaged_rows of each page by height; a fold over one page's spans."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([y, order], kind="stable")
        return g.assign(row=averaged_rows(g[y].tolist(), within))

    kinds = ", ".join(f"{c} {t}" for c, t in spans.dtypes)
    return spans.groupBy(page).applyInPandas(fold, f"{kinds}, row long")


def marked_spans(lines: DataFrame, book: str, order: str, text: str = "text", x: str = "x", indent: float = 3.0) -> DataFrame:
    """Adds span to lines from a marker "(n)" up to the next marker or a line more than `indent` left of the marker's."""
    w = Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    starts = strip(F.col(text)).rlike(r"^\(\d+\)")
    marked = lines.withColumn("span", F.count_if(starts).over(w)).withColumn("_x", F.last(F.when(starts, F.col(x)), ignorenulls=True).over(w))
    inside = Window.partitionBy(book, "span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.where("span > 0").withColumn("_out", F.max((F.col(x) < F.col("_x") - indent).cast("int")).over(inside)).where("_out = 0").drop("_x", "_out")


def by_page(sections: DataFrame, page: str = "page", order: str = "id") -> DataFrame:
    """page, n, headings in order; a missing page is 'Unknown'."""
    p = F.coalesce(F.col(page).cast("string"), F.lit("Unknown")).alias("page")
    heads = F.array_sort(F.collect_list(F.struct(order, F.coalesce("heading", F.lit("")).alias("h"))))
    return sections.groupBy(p).agg(F.count(F.lit(1)).alias("n"), F.transform(heads, lambda x: x["h"]).alias("headings"))


def rules_of_sections(sections: DataFrame, mapping: DataFrame, rules: DataFrame) -> DataFrame:
    """Two-hop lookup: section index -> filtered index -> its rules in order; sections without any stay with nulls."""
    return sections.join(mapping, "idx", "left").join(rules, "filtered_idx", "left")
