"""Vector and hybrid retrieval, adjacency of vectors, and boundaries between dissimilar neighbours."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Scores that a worker holds at a time: a matrix of them takes 2 MB, whatever the blocks.
SCORES = 1 << 18


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product of two arrays, summed in order as doubles."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: str, b: str) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    query_id: str = "query_id",
    item_id: str = "item_id",
    vector: str = "embedding",
    places: int = 6,
    score: Callable[[np.ndarray, pd.DataFrame, pd.DataFrame], np.ndarray] | None = None,
    sense: str | None = None,
    others_only: bool = False,
    query_block: int = 4096,
    item_block: int = 16384,
) -> DataFrame:
    """query_id, item_id, score, rank: each query's k best items by cosine (rounded), ties by item id.

    `score` makes the scores of a block from its similarities, its queries and its items (all their columns), and is rounded
    likewise. With `sense`, a column of the items, only the best item of each sense counts, and the column is returned.
    `others_only` leaves out the item of the query's own id. Rows without a vector are left out; zero vectors score 0.

    Both tables are dealt into blocks of bounded size, every block of queries meets every block of items in one matrix
    product, and only k candidates a query and block of items are shuffled further. Nothing is collected or broadcast.
    """
    queries, items = (t.where(F.col(vector).isNotNull()) for t in (queries, items))
    n_q, n_i = max(1, -(-queries.count() // query_block)), max(1, -(-items.count() // item_block))

    def dealt(rows: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        block = F.pmod(F.monotonically_increasing_id(), F.lit(n_own)).cast("int")
        return rows.withColumn(own, block).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))))

    types = dict(items.dtypes) | {query_id: dict(queries.dtypes)[query_id]}
    names = [query_id, item_id] + ([sense] if sense else [])

    def meet(q: pd.DataFrame, i: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(i):
            return pd.DataFrame({c: [] for c in [*names, "score"]})
        i = i.sort_values(item_id, na_position="first", kind="stable")
        right = _unit(np.stack(i[vector].to_list()).astype(np.float64)).T
        kinds = pd.factorize(i[sense], use_na_sentinel=False)[0] if sense else None
        found = []
        step = max(1, SCORES // len(i))  # bounds the matrix of scores and all that is made of it
        for at in range(0, len(q), step):
            part = q.iloc[at : at + step]
            s = _rounded(_unit(np.stack(part[vector].to_list()).astype(np.float64)) @ right, places)
            if score:
                s = _rounded(score(s, part, i), places)
            if others_only:
                s[part[query_id].to_numpy()[:, None] == i[item_id].to_numpy()[None, :]] = -np.inf
            order = np.argsort(-s, axis=1, kind="stable")
            if sense:  # the first place of each sense, in order of score
                best = [o[np.sort(np.unique(kinds[o], return_index=True)[1])[:k]] for o in order]
            else:
                best = list(order[:, :k])
            rows, cols = np.repeat(np.arange(len(part)), [len(b) for b in best]), np.concatenate(best)
            some = pd.DataFrame({query_id: part[query_id].to_numpy()[rows], **{c: i[c].to_numpy()[cols] for c in names[1:]}, "score": s[rows, cols]})
            found.append(some[some["score"] > -np.inf])
        return pd.concat(found)

    shape = ", ".join(f"`{c}` {types[c]}" for c in names) + ", score double"
    left = dealt(queries, "_q", n_q, "_i", n_i).groupBy("_q", "_i")
    right = dealt(items, "_i", n_i, "_q", n_q).groupBy("_q", "_i")
    near = left.cogroup(right).applyInPandas(meet, shape)
    if sense:
        return distinct_top_k(near, query_id, item_id, sense, k)
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), item_id)
    return near.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def _rounded(m: np.ndarray, places: int) -> np.ndarray:
    """Halves away from zero."""
    return np.copysign(np.floor(np.abs(m) * 10.0**places + 0.5), m) / 10.0**places + 0.0


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def adjacent_cosine(rows: DataFrame, keys: list[str], order: str, vector: str = "embedding", places: int = 6) -> DataFrame:
    """Cosine of each row and the one after it; the last row of a key has none."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumn("_next", F.lead(vector).over(w)).where("_next is not null").withColumn("similarity", F.round(cosine(vector, "_next"), places)).drop("_next", vector)


def feature_score(same_pos: Column, same_feature: Column, *agreements: Column) -> Column:
    """0 to 1: part of speech counts 1, feature and value 2, each agreement a half, of 4.5."""
    total = F.when(same_pos, 1.0).otherwise(0.0) + F.when(same_feature, 2.0).otherwise(0.0)
    for a in agreements:
        total = total + F.when(a, 0.5).otherwise(0.0)
    return total / 4.5


def hybrid(similarity: Column, features: Column) -> Column:
    return 0.7 * similarity + 0.3 * features


def distinct_top_k(scored: DataFrame, query_id: str, item_id: str, sense: str, k: int, score: str = "score") -> DataFrame:
    """Of each query the best item of every sense, then the k best of those; ties by item id."""
    first = Window.partitionBy(query_id, sense).orderBy(F.desc(score), item_id)
    best = Window.partitionBy(query_id).orderBy(F.desc(score), item_id)
    return scored.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r").withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k)


def pick_boundaries(similarities: list[float], words: int, target: int, min_gap: int = 0) -> list[int]:
    """After which sentences to split: the words // target least similar places, each at least min_gap from those chosen.

    A candidate i is compared with the chosen boundaries as stored, which is i + 1 (kept as it is in the results that
    this must equal). Ties go to the earlier place.
    """
    chosen: list[int] = []
    for i in sorted(range(len(similarities)), key=lambda i: (similarities[i], i)):
        if len(chosen) >= words // target:
            break
        if all(abs(i - c) >= min_gap for c in chosen):
            chosen.append(i + 1)
    return sorted(chosen)


def split_boundaries(rows: DataFrame, key: str, order: str, target: int, min_gap: int = 0) -> DataFrame:
    """key, boundary: pick_boundaries of each key from columns similarity (null for the last) and words."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values(order)
        found = pick_boundaries(g["similarity"].dropna().tolist(), int(g["words"].sum()), target, min_gap)
        return pd.DataFrame({key: [g[key].iloc[0]] * len(found), "boundary": found})

    kind = dict(rows.dtypes)[key]
    return rows.select(key, order, "similarity", "words").groupBy(key).applyInPandas(fold, f"{key} {kind}, boundary long")
