"""Prompts, token budgets, nested buckets and quota backfill."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ranks import row_numbers


def templated(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by its value; null values are empty."""
    parts, at = [], 0
    import re

    for m in re.finditer(r"\{(\w+)\}", template):
        if m[1] in values:
            parts += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit(""))]
            at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def chat_json(prompt: Column, answer: Column | None = None) -> Column:
    """A request of one user turn, and a model turn if there is an answer, in the nested form of chat fine-tuning files."""
    turns = [("user", prompt)] + ([("model", answer)] if answer is not None else [])
    shape = [F.struct(F.lit(r).alias("role"), F.array(F.struct(t.alias("text"))).alias("parts")) for r, t in turns]
    return F.to_json(F.struct(F.array(*shape).alias("contents")))


def request_json(key: Column, prompt: Column) -> Column:
    return F.to_json(F.struct(key.alias("key"), F.struct(F.array(F.struct(F.array(F.struct(prompt.alias("text"))).alias("parts"))).alias("contents")).alias("request")))


def item_key(*parts: Column | str) -> Column:
    return F.concat_ws("_", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def next_fit(tokens: list[int], limit: int) -> list[int]:
    """Chunk of each item: a new chunk begins when the next item would exceed the limit; none is empty."""
    out, chunk, used = [], 0, 0
    for t in tokens:
        if used and used + t > limit:
            chunk, used = chunk + 1, 0
        out.append(chunk)
        used += t
    return out


def token_chunks(rows: DataFrame, group: str, order: str, tokens: str, limit: int) -> DataFrame:
    """Adds chunk, next_fit inside each group: an order-dependent fold over the narrow columns of a group."""

    def fold(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(order)
        return g.assign(chunk=next_fit(g[tokens].tolist(), limit))

    narrow = rows.select(group, order, tokens)
    kinds = ", ".join(f"{c} {t}" for c, t in narrow.dtypes)
    return narrow.groupBy(group).applyInPandas(fold, f"{kinds}, chunk long")


def fixed_parts(rows: DataFrame, group: str, order: str, size: int = 800) -> DataFrame:
    """Adds part: parts of `size` rows of a group, in order."""
    return row_numbers(rows, group, [order], "part").withColumn("part", F.floor(F.col("part") / size).cast("long"))


def nested_buckets(rows: DataFrame, group: str, order: str, limits: Sequence[int] = (5, 10, 15, 20), block: int = 20) -> DataFrame:
    """A row of each nested bucket a row falls into: its rank modulo the block is below the bucket's limit."""
    at = row_numbers(rows, group, [order], "index")
    fits = F.filter(F.array(*map(F.lit, limits)), lambda x: F.pmod(F.col("index"), F.lit(block)) < x)
    return at.withColumn("bucket", F.explode(F.transform(fits, lambda x: x.cast("long"))))


def quota_backfill(stages: Sequence[DataFrame], group: str, order: str, limit: int, group_size: int = 1) -> DataFrame:
    """Union of the stages in order, cut to `limit` whole groups of `group_size` rows: earlier stages first, an incomplete
    group of a stage is left out. Adds stage and quota_no. The limit is the feature; only ranks are global."""
    tagged = None
    for i, s in enumerate(stages):
        s = s.withColumn("stage", F.lit(i).cast("long"))
        tagged = s if tagged is None else tagged.unionByName(s)
    sizes = tagged.groupBy("stage", group).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first")).where(F.col("_n") >= group_size)
    once = sizes.withColumn("_s", F.row_number().over(Window.partitionBy(group).orderBy("stage"))).where("_s = 1")
    top = once.orderBy("stage", "_first", group).limit(limit).withColumn("quota_no", F.row_number().over(Window.orderBy("stage", "_first", group)).cast("long"))  # at most `limit` rows
    inside = Window.partitionBy("stage", group).orderBy(order)
    return tagged.join(F.broadcast(top.select("stage", group, "quota_no")), ["stage", group]).withColumn("_k", F.row_number().over(inside)).where(F.col("_k") <= group_size).drop("_k")


def seeded_sample(rows: DataFrame, group: str, item: str, k: int, seed: int = 0) -> DataFrame:
    """k rows of each group in the order of a seeded hash, ties by item; a sampling operator."""
    w = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), item), item)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
