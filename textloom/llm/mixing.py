"""Mixing overlapping sources to target weights by min-cost flow.

1. Documents are aggregated by membership pattern (the set of sources they belong to): one row a pattern.
2. On the driver, a min-cost flow routes each pattern's word capacity to the sources' quotas. A pattern offers its words
   `max_repeats` times; the r-th time costs r - 1 more than the one before, so costs are convex and words repeat only
   where quotas can't be met without. The network has a node a pattern and a source; `max_patterns` bounds it.
3. A pattern's flow becomes whole passes over its documents and a rest. The rest goes to documents in a seeded order:
   whole hash bins first, then, in a zone of bins around the boundary, each document that still fits. Only one zone a
   pattern, about `zone_docs` rows or one bin, meets in a task.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import staged, text_or_empty
from textloom.llm.packing import n_words


def weighted_targets(sizes: list[float], weights: list[float], share: float = 1.5, cap: float = 2.0) -> list[float]:
    """Share `share` times all sizes by weight; a target stops at `cap` times its size and the excess is reshared."""
    targets, active, rest = [0.0] * len(sizes), list(range(len(sizes))), share * sum(sizes)
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if rest * weights[i] / total > cap * sizes[i]]
        if not over:
            for i in active:
                targets[i] = rest * weights[i] / total
            break
        for i in over:
            targets[i] = float(cap * sizes[i])
        rest -= sum(targets[i] for i in over)
        active = [i for i in active if i not in set(over)]
    return targets


def route(capacity: list[int], members: list[list[int]], quotas: list[int], max_repeats: int = 2) -> list[dict[int, int]]:
    """Words that each pattern gives to each of its sources: the largest flow of the least convex repetition cost.

    Successive shortest paths on the residual network sink <- source <- pattern <- start; the r-th unit of a pattern's
    capacity costs r - 1, so a search runs once for every tier and follows back-edges between patterns that share sources.
    """
    flow: list[dict[int, int]] = [dict.fromkeys(m, 0) for m in members]
    givers: dict[int, list[int]] = {}
    for p, m in enumerate(members):
        for s in m:
            givers.setdefault(s, []).append(p)
    left = list(quotas)
    used = [0] * len(capacity)
    # A tier's units are all cheaper than the next tier's; rerouting never changes what a pattern gives in all, so that
    # filling tier by tier with augmenting paths gives the least cost.
    for tier in range(1, max_repeats + 1):
        again = True
        while again:
            again = False
            for start in range(len(capacity)):
                room = capacity[start] * tier - used[start]
                while room > 0:
                    came: dict[int, tuple[int, int | None]] = {s: (start, None) for s in members[start]}
                    queue, end = deque(members[start]), None
                    while queue:
                        s = queue.popleft()
                        if left[s] > 0:
                            end = s
                            break
                        for p in givers[s]:
                            if flow[p][s] > 0:
                                for t in members[p]:
                                    if t not in came:
                                        came[t] = (p, s)
                                        queue.append(t)
                    if end is None:
                        break
                    amount, path, s = min(room, left[end]), [], end
                    while s is not None:
                        p, back = came[s]
                        path.append((p, s, back))
                        if back is not None:
                            amount = min(amount, flow[p][back])
                        s = back
                    for p, s, back in path:
                        flow[p][s] += amount
                        if back is not None:
                            flow[p][back] -= amount
                    left[end] -= amount
                    used[start] += amount
                    room -= amount
                    again = True
    return flow


def _fill(zone: pd.DataFrame) -> pd.DataFrame:
    """Of a zone's documents in seeded order, take each that still fits; at the end the least one if that comes nearer."""
    zone = zone.sort_values(["order", "id"], kind="stable", na_position="last").reset_index(drop=True)
    rest, extra = int(zone["rest"].iloc[0]), [0] * len(zone)
    for i, size in enumerate(zone["size"].tolist()):
        if 0 < size <= rest:
            extra[i], rest = 1, rest - size
    spare = [(size, i) for i, size in enumerate(zone["size"].tolist()) if size and not extra[i]]
    if rest and spare and min(spare)[0] - rest < rest:
        extra[min(spare)[1]] = 1
    return zone.assign(repeats=zone["base"] + pd.Series(extra, dtype="int64"))[["id", "pattern", "size", "repeats"]]


def mix(docs: DataFrame, quota_of, id_col: str = "doc_id", size: Column | None = None, sources: Column | None = None, max_repeats: int = 2, bins: int = 4096, zone_docs: int = 1000, seed: int = 11, max_patterns: int = 20_000):
    """(rows, plan): rows has id, pattern, size, repeats for every input row; plan has each source's size, target, taken.

    `size` is the row's size in words (null counts as 0), `sources` an array of source names (nulls are a source of
    their own). quota_of(names, sizes) gives the sources' targets; names are sorted by code point, null last. A row
    without sources is never taken. Rows that repeat an id are separate documents; ties in the seeded order go by id. An
    empty table gives no rows. More than `max_patterns` patterns raise ValueError before anything large is collected.
    """
    size = F.coalesce(F.col("size") if size is None else size, F.lit(0)).cast("long")
    sources = F.array("source") if sources is None else sources
    named = F.array_sort(F.array_distinct(F.transform(sources, lambda s: F.coalesce(F.concat(F.lit("="), s.cast("string")), F.lit("")))))
    rows = staged(
        docs.select(F.col(id_col).alias("id"), F.coalesce(named, F.array().cast("array<string>")).alias("pattern"), size.alias("size"))
        .withColumn("order", F.xxhash64(F.lit(seed), "id"))
        .withColumn("bin", F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(bins)).cast("int")),
        "mixing-rows",
    )
    spark = docs.sparkSession
    by_bin = rows.groupBy("pattern", "bin").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    found = by_bin.groupBy("pattern").agg(F.sum("words").alias("words")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    patterns = sorted(((tuple(r["pattern"]), int(r["words"])) for r in found), key=lambda x: x[0])
    names = sorted({s for p, _ in patterns for s in p}, key=lambda s: (not s, s))
    at = {s: i for i, s in enumerate(names)}
    sizes = [sum(w for p, w in patterns if s in p) for s in names]
    targets = quota_of([s[1:] if s else None for s in names], sizes)
    flow = route([w for _, w in patterns], [[at[s] for s in p] for p, _ in patterns], [round(t) for t in targets], max_repeats)
    plan = [{"name": s[1:] if s else None, "key": s, "size": sizes[i], "target": float(targets[i]), "taken": sum(f.get(i, 0) for f in flow)} for i, s in enumerate(names)]
    totals = [sum(f.values()) for f in flow]
    passes = [(list(p), *(divmod(t, w) if w else (0, 0))) for (p, w), t in zip(patterns, totals, strict=True)]
    shares = spark.createDataFrame(passes or [([], 0, 0)], "pattern array<string>, base long, rest long")
    ordered = Window.partitionBy("pattern").orderBy("bin")
    edge = (
        by_bin.withColumns({"upto": F.sum("words").over(ordered), "docs_upto": F.sum("n").over(ordered)})
        .join(F.broadcast(shares), "pattern")  # at most max_patterns rows
        .groupBy("pattern", "base", "rest")
        .agg(
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("bin"))), F.lit(-1)).alias("full"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("filled"),
            F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("docs_upto"))), F.lit(0)).alias("before"),
            F.collect_list(F.struct("bin", "docs_upto")).alias("all"),  # at most `bins` of them
        )
        .withColumn("zone", F.coalesce(F.array_min(F.transform(F.filter("all", lambda b: (b["docs_upto"] - F.col("before") >= zone_docs) & (b["bin"] > F.col("full"))), lambda b: b["bin"])), F.lit(bins)))
        .select("pattern", "base", F.when(F.col("rest") > F.col("filled"), F.col("rest") - F.col("filled")).otherwise(0).alias("rest"), "full", "zone")
    )
    edges = spark.createDataFrame(edge.collect(), "pattern array<string>, base long, rest long, full int, zone int")
    marked = rows.join(F.broadcast(edges), "pattern")  # at most max_patterns rows
    in_zone = (F.col("rest") > 0) & (F.col("bin") > F.col("full")) & (F.col("bin") <= F.col("zone"))
    sure = marked.where(~in_zone).select("id", "pattern", "size", (F.col("base") + F.when(F.col("bin") <= F.col("full"), 1).otherwise(0)).cast("long").alias("repeats"))
    rest = marked.where(in_zone).select("id", "pattern", "size", "order", "base", "rest")
    filled = rest.groupBy("pattern").applyInPandas(_fill, "id long, pattern array<string>, size long, repeats long")
    return sure.unionByName(filled), plan


#: Weights of the sources in code-point order, repeating (fixed values of the contract).
WEIGHTS = (3.0, 1.0, 2.0)


def source_mix(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[float, ...] = WEIGHTS, **options):
    """mix() of a table with columns source and text: sizes are words, targets are weighted_targets()."""
    return mix(docs, lambda names, sizes: weighted_targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share, cap), size=n_words(text_or_empty()), **options)


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken, repeats, for a table whose rows have one source each."""
    rows, plan = source_mix(docs, **options)
    sources = docs.sparkSession.createDataFrame([([p["key"]], p["size"], p["target"]) for p in plan] or [([], 0, 0.0)], "pattern array<string>, source_size long, target double")
    return rows.join(F.broadcast(sources), "pattern").select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")  # max_patterns rows
