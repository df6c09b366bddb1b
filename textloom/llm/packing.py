"""Packing into optimal length buckets.

1. Every document's words are counted natively; a document longer than `max_len` becomes several pieces, so that no
   word is lost and the length histogram has at most `max_len` entries whatever the input.
2. Dynamic programming over that histogram chooses at most `buckets` upper bounds with the least total padding.
3. Inside a bucket pieces are numbered in a seeded order and cut into batches of floor(budget / bound) pieces each, so
   that a batch's padded size never exceeds the token budget. The numbering is distributed: pieces are dealt by
   (bucket, salt), numbered in their salt group, and offset by the counts of the salt groups before, a table of at most
   buckets * salts rows. A bucket with a third of all rows is therefore spread over `salts` groups.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import SPACE, staged, text_or_empty


def bucket_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """The upper bounds (at most `buckets`, the last is the largest length) with the least padding.

    best[k][j] = min over i of best[k-1][i] + padding of lengths i..j-1 under the bound lengths[j-1]. The split point
    is monotone in j, so each row is filled by divide and conquer in O(m log m); m is the number of distinct lengths.
    Of equal totals the smallest split point is taken.
    """
    if not lengths:
        return []
    order = np.argsort(lengths)
    x = np.asarray(lengths, dtype=np.int64)[order].tolist()
    n = [0, *np.cumsum(np.asarray(counts, dtype=object)[order]).tolist()]
    s = [0, *np.cumsum((np.asarray(counts, dtype=object)[order]) * np.asarray(x, dtype=object)).tolist()]
    m = len(x)

    def cost(i: int, j: int) -> int:
        return x[j - 1] * (n[j] - n[i]) - (s[j] - s[i])

    last = [0, *(cost(0, j) for j in range(1, m + 1))]
    splits: list[list[int]] = []
    for _ in range(1, min(buckets, m)):
        now, split = [0] * (m + 1), [0] * (m + 1)
        todo = [(1, m, 0, m - 1)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            now[j], split[j] = min((last[i] + cost(i, j), i) for i in range(a, min(b, j - 1) + 1))
            todo += [(lo, j - 1, a, split[j]), (j + 1, hi, split[j], b)]
        splits.append(split)
        last = now
    bounds, j = [], m
    for split in reversed(splits):
        bounds.append(x[j - 1])
        j = split[j]
        if not j:
            break
    if j:
        bounds.append(x[j - 1])
    return sorted(bounds)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_len: int = 4096, buckets: int = 16, budget: int = 65536, salts: int = 256, seed: int = 7) -> DataFrame:
    """One row per piece: id, piece, start (its first word), n_tokens, bucket (upper bound), batch, slot.

    Batches are numbered from 0 within a bucket, slots from 0 within a batch; all batches of a bucket but the last are
    full. Null, empty and blank texts hold no tokens and give no row; rows that repeat an id are packed each; ties in
    the seeded order are broken by id and piece. An empty table gives no rows. Reruns agree.
    """
    if budget < max_len:
        raise ValueError("the token budget must hold one piece of max_len")
    words = docs.select(F.col(id_col).alias("id"), n_words(text_or_empty(text_col)).alias("n")).where("n > 0")
    pieces = staged(
        words.select("id", "n", F.explode(F.sequence(F.lit(0), F.expr(f"cast((n - 1) div {max_len} as int)"))).alias("piece")).select(
            "id",
            "piece",
            (F.col("piece") * max_len).cast("long").alias("start"),
            F.least(F.col("n") - F.col("piece") * max_len, F.lit(max_len)).cast("long").alias("n_tokens"),
        ),
        "packing-pieces",
    )
    histogram = pieces.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("c")).collect()  # at most max_len rows
    bounds = bucket_bounds([r.n_tokens for r in histogram], [r.c for r in histogram], buckets)
    limits = F.array(*map(F.lit, bounds)) if bounds else F.array(F.lit(0))
    dealt = pieces.withColumn("bucket", F.element_at(F.filter(limits, lambda b: b >= F.col("n_tokens")), 1).cast("long")).withColumns(
        {"order": F.xxhash64(F.lit(seed), "id", "piece"), "salt": F.pmod(F.xxhash64(F.lit(seed + 1), "id", "piece"), F.lit(salts))}
    )
    before = Window.partitionBy("bucket").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("bucket", "salt").agg(F.count(F.lit(1)).alias("c")).select("bucket", "salt", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    own = Window.partitionBy("bucket", "salt").orderBy("order", "id", "piece")
    per_batch = F.expr(f"{budget} div bucket")
    return (
        dealt.withColumn("rn", F.row_number().over(own) - 1)
        .join(F.broadcast(offsets), ["bucket", "salt"])  # at most buckets * salts rows
        .withColumn("at", F.col("offset") + F.col("rn"))
        .select(F.col("id").alias(id_col), "piece", "start", "n_tokens", "bucket", F.expr(f"at div ({budget} div bucket)").alias("batch"), F.pmod(F.col("at"), per_batch).alias("slot"))
    )
