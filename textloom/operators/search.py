"""Exact and fuzzy search over several text fields."""

from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import strip


#: Windows that are scored at once, so that their state stays in the cache.
CHUNK = 1 << 14


@lru_cache(maxsize=64)
def _masks(needle: str) -> np.ndarray:
    """By word of bits and code point, the places of the needle where it stands; the last code stands for all others."""
    codes = [ord(c) for c in needle]
    bits = next((b for b in (16, 32) if len(codes) <= b), 64)
    table = np.zeros((-(-len(codes) // bits), max(codes) + 2), f"uint{bits}")
    for i, c in enumerate(codes):
        table[i // bits, c] |= table.dtype.type(1 << i % bits)
    return table


def _common(masks: np.ndarray, m: int) -> np.ndarray:
    """Of every window of m code points, the longest common subsequence with the needle (bit-parallel, all windows abreast)."""
    n = masks.shape[1] - m + 1
    state = np.full((len(masks), n), np.iinfo(masks.dtype).max, masks.dtype)
    for j in range(m):
        carry = None
        for s, mask in zip(state, masks[:, j : j + n], strict=True):
            both = s & mask
            up = s + both
            if len(masks) > 1:
                over = up < s
                if carry is not None:
                    up += carry
                    over |= up < carry
                carry = over
            np.subtract(s, both, out=s)
            np.bitwise_or(s, up, out=s)
    return np.bitwise_count(~state).sum(axis=0, dtype=np.int64)


def partial_ratio(query: str, text: str) -> float:
    """0 to 100: the best similarity of the shorter string and a window of the longer one: every equally long window, and
    the shorter ones at both edges. Similarity is twice the longest common subsequence by the sum of both lengths."""
    a, b = sorted((query.casefold(), text.casefold()), key=len)
    if not a:
        return 100.0 if not b else 0.0
    if a in b:
        return 100.0
    best = _best_window(a, b)
    return max(best, _best_window(b, a)) if len(a) == len(b) else best


def _best_window(a: str, b: str) -> float:
    table, m, n = _masks(a), len(a), len(b)
    codes = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    other = table.shape[1] - 1
    codes = np.pad(np.minimum(codes, other), m - 1, constant_values=other)  # windows at the edges reach over them
    windows = n + m - 1
    common = np.concatenate([_common(table[:, codes[at : at + CHUNK + m - 1]], m) for at in range(0, windows, CHUNK)])
    edge = np.arange(1, m)
    return max(100 * int(common[m - 1 : n].max()) / m, *(200 * np.concatenate([common[: m - 1], common[:n - 1 : -1]]) / (m + np.concatenate([edge, edge]))), 0.0)


def exact_hits(rows: DataFrame, query: str, fields: Sequence[str]) -> DataFrame:
    """Adds matched_in (names of the fields that contain the stripped query, case-insensitively) and score 100; others go."""
    q = query.strip().lower()
    names = F.array(*[F.when(F.lower(F.coalesce(f, F.lit(""))).contains(q), F.lit(f)) for f in fields])
    return rows.withColumns({"matched_in": F.array_join(names, ", "), "score": F.lit(100.0)}).where("matched_in <> ''")


def fuzzy_hits(rows: DataFrame, query: str, fields: Sequence[str], threshold: float = 70.0) -> DataFrame:
    """Adds matched_in and score, the best field's partial_ratio, of rows that reach the threshold. Scored in Arrow
    batches; columns other than the fields stay in the JVM."""
    q = query.strip()

    @F.pandas_udf("double")
    def ratio(texts: pd.Series) -> pd.Series:
        return texts.fillna("").map(lambda t: partial_ratio(q, t))

    scored = rows.withColumns({f"_s{i}": ratio(F.col(f)) for i, f in enumerate(fields)})
    names = F.array(*[F.when(F.col(f"_s{i}") >= threshold, F.lit(f)) for i, f in enumerate(fields)])
    best = F.greatest(*[F.col(f"_s{i}") for i in range(len(fields))], F.lit(0.0))
    out = scored.withColumns({"matched_in": F.array_join(names, ", "), "score": F.round(best, 6)}).where("matched_in <> ''")
    return out.drop(*[f"_s{i}" for i in range(len(fields))])


def ranked(hits: DataFrame, book: str, idx: str, limit: int = 100) -> DataFrame:
    """The best `limit` hits by score, then book and index (a top-k report)."""
    return hits.orderBy(F.desc("score"), book, idx).limit(limit)


def with_word_count(rows: DataFrame, text: str, least: int, most: int) -> DataFrame:
    from textloom.functions.text import n_words

    return rows.where(n_words(F.col(text)).between(least, most))


def entry_matches(rows: DataFrame, query: str, *fields: str) -> DataFrame:
    """Dictionary rows with the query in any of the fields."""
    q = query.strip().lower()
    any_ = F.lit(False)
    for f in fields:
        any_ = any_ | F.lower(F.coalesce(f, F.lit(""))).contains(q)
    return rows.where(any_)


def index_lines(kind: Column, heading: Column, idx: Column, columns: int = 3) -> tuple[Column, Column]:
    """(line, column) of an index: headers bold, subheaders italic, dealt in turn over the columns."""
    h = strip(F.coalesce(heading, F.lit("")))
    return F.when(kind == "header", F.concat(F.lit("**"), h, F.lit("**"))).when(kind == "subheader", F.concat(F.lit("*"), h, F.lit("*"))).otherwise(h), F.pmod(idx, F.lit(columns))
