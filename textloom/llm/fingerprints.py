"""Improbable-feature digests: rare byte windows in chained Bloom filters.

A feature is a window of 64 bytes. Its entropy (a fixed-point score from 0 to 1000) is computed for every offset; a first
pass over all documents counts how often each score occurs, and rare scores rank first. In every run of 64 consecutive
windows the best ranked (then leftmost) window gets a point, windows with enough points are selected, hashed, and
inserted in order into Bloom filters of 2048 bits that are chained each time one holds 160 features. Two digests compare
by normalised bit overlap.

Everything is vectorised over buffers of many documents: the sliding entropy needs the number of equal bytes within 63
positions ahead and behind, which is a sum of 63 shifted comparisons.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import text_or_empty
from textloom.llm.shingles import ODD, mixed

WINDOW = 64
SCORES = 1001
#: Windows of a lower entropy score (one byte repeated, and the like) are no features.
LEAST = 100
#: Points that select a window.
POINTS = 16
FILTER_BITS = 2048
FEATURES = 160
SUBHASHES = 5
#: Share of the way from chance overlap to full overlap that counts as nothing.
ALPHA = 0.1
BUFFER = 1 << 16

_FULL = int(WINDOW * np.log2(WINDOW) * 65536)
_T = np.array([0, *(round(c * np.log2(c) * 65536) for c in range(1, WINDOW + 1))], dtype=np.int64)
_STEP = np.diff(_T, prepend=0)


def scores(data: np.ndarray) -> np.ndarray:
    """Entropy score of each window of a byte array with at least WINDOW bytes."""
    n = len(data)
    ahead, behind = np.ones(n, dtype=np.uint8), np.ones(n, dtype=np.uint8)
    equal = np.empty(n, dtype=bool)
    for k in range(1, WINDOW):
        e = np.equal(data[:-k], data[k:], out=equal[: n - k]).view(np.uint8)
        ahead[: n - k] += e
        behind[k:] += e
    change = _STEP[behind[WINDOW:]] - _STEP[ahead[: n - WINDOW]]
    first = int(_T[np.bincount(data[:WINDOW], minlength=256)].sum())
    s = np.cumsum(np.concatenate([[first], change]))
    return ((_FULL - s) * (SCORES - 1) // _FULL).astype(np.uint16)


def _buffers(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about BUFFER bytes together, with the position of the first."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BUFFER:
            yield start, texts[start:i]
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, texts[start:]


def _windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes, the score of each window, and each text's first window and number of windows."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = np.frombuffer(b"".join(texts) + bytes(2 * WINDOW), dtype=np.uint8)
    return data, scores(data), np.cumsum(sizes) - sizes, np.maximum(0, sizes - WINDOW + 1)


def _inside(first: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Whether a window lies within one text."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, first[count > 0], 1)
    np.add.at(edge, (first + count)[count > 0], -1)
    return np.cumsum(edge[:-1]) > 0


def score_counts(texts: list[bytes]) -> np.ndarray:
    total = np.zeros(SCORES, dtype=np.int64)
    for _, part in _buffers(texts):
        _, s, first, count = _windows(part)
        total += np.bincount(s[_inside(first, count, len(s))], minlength=SCORES)
    return total


def rarity(counts: np.ndarray) -> np.ndarray:
    """Rank of each score: scores that occurred, rare ones first (then higher ones); others and low ones are no features."""
    order = np.lexsort((-np.arange(SCORES), counts))
    ranks = np.empty(SCORES, dtype=np.uint32)
    ranks[order] = np.arange(SCORES, dtype=np.uint32)
    ranks[:LEAST] = SCORES
    return ranks


def digests(texts: list[bytes], ranks: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Of each text the number of features and the filters (rows of 2048 / 8 bytes)."""
    out: list[tuple[int, np.ndarray]] = []
    for _, part in _buffers(texts):
        out += _digests(part, ranks)
    return out


def _digests(texts: list[bytes], ranks: np.ndarray) -> list[tuple[int, np.ndarray]]:
    data, s, first, count = _windows(texts)
    n = len(s)
    inside = _inside(first, count, n)
    key = np.where(inside, ranks[s], np.uint32(SCORES)).astype(np.uint64)
    none = key >= SCORES
    key = (key << np.uint64(40)) | np.arange(n, dtype=np.uint64)
    best, width = np.concatenate([key, np.full(WINDOW, np.iinfo(np.uint64).max, dtype=np.uint64)]), 1
    while width < WINDOW:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    at = (best[:n][inside] & np.uint64((1 << 40) - 1)).astype(np.int64)
    points = np.bincount(at, minlength=n)
    found = np.flatnonzero((points > 0) & ~none)
    owner = np.searchsorted(first, found, side="right") - 1
    enough = points[found] >= np.minimum(POINTS, np.maximum(1, count[owner] // 4))
    found, owner = found[enough], owner[enough]
    cut = np.lib.stride_tricks.sliding_window_view(data, WINDOW)[found].view(np.uint64) if len(found) else np.empty((0, 8), np.uint64)
    h = np.zeros(len(found), dtype=np.uint64)
    for k in range(cut.shape[1]):
        h = mixed((h ^ cut[:, k]) * ODD[k] + np.uint64(k))
    _, keep = np.unique(np.stack([owner.astype(np.uint64), h], axis=1), axis=0, return_index=True) if len(h) else (None, np.empty(0, np.int64))
    keep.sort()
    h, owner = h[keep], owner[keep]
    per = np.bincount(owner, minlength=len(texts))
    for i in np.flatnonzero(per == 0):  # without a selected window the whole text is the one feature
        if texts[i]:
            at_i = np.searchsorted(owner, i)
            h = np.insert(h, at_i, np.uint64(xxhash.xxh3_64_intdigest(texts[i])))
            owner = np.insert(owner, at_i, i)
            per[i] = 1
    chains = -(-per // FEATURES)
    base = np.cumsum(chains) - chains
    turn = np.arange(len(h)) - np.repeat(np.cumsum(per) - per, per)
    row = base[owner] + turn // FEATURES
    bits = np.zeros((int(chains.sum()), FILTER_BITS), dtype=bool)
    for k in range(SUBHASHES):
        bits[row, ((h >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = True
    packed = np.packbits(bits, axis=1)
    return [(int(per[i]), packed[base[i] : base[i] + chains[i]]) for i in range(len(texts))]


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    """0 to 1: each filter of the digest with fewer features against its best match, weighted by its features.

    The overlap is normalised: what chance gives plus ALPHA of the rest counts as 0, full overlap as 1. Two empty
    digests are alike, an empty one is like no other.
    """
    if a[0] > b[0]:
        a, b = b, a
    if not a[0]:
        return float(not b[0])
    x, y = a[1].view(np.uint64), b[1].view(np.uint64)
    nx, ny = np.bitwise_count(x).sum(axis=1, dtype=np.int64), np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    weight = np.full(len(x), FEATURES)
    weight[-1] = a[0] - FEATURES * (len(x) - 1)
    total = 0.0
    for i in range(len(x)):
        common = np.bitwise_count(y & x[i]).sum(axis=1, dtype=np.int64)
        most = np.minimum(nx[i], ny)
        chance = nx[i] * ny / FILTER_BITS
        low = chance + ALPHA * (most - chance)
        total += weight[i] * float(np.clip((common - low) / np.maximum(most - low, 1e-9), 0, 1).max())
    return min(1.0, total / a[0])


def as_string(d: tuple[int, np.ndarray]) -> str:
    """Number of features, a colon, and the filters in base64."""
    return f"{d[0]}:{base64.b64encode(d[1].tobytes()).decode()}"


def from_string(s: str) -> tuple[int, np.ndarray]:
    n, _, body = s.partition(":")
    return int(n), np.frombuffer(base64.b64decode(body), dtype=np.uint8).reshape(-1, FILTER_BITS // 8)


def score_histogram(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often each entropy score occurs in all texts; 1001 numbers reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = score_counts(batch.column(0).to_pylist())
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["score", "n"])

    total = np.zeros(SCORES, dtype=np.int64)
    texts = docs.select(text_or_empty(text_col).cast("binary").alias("t"))
    for r in texts.mapInArrow(count, "score int, n long").groupBy("score").agg(F.sum("n").alias("n")).collect():
        total[r["score"]] = r["n"]
    return total


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", histogram: np.ndarray | None = None) -> DataFrame:
    """Per row: id, n_features, fingerprint. Null texts count as empty ("0:"); equal texts have equal fingerprints."""
    ranks = rarity(score_histogram(docs, text_col) if histogram is None else histogram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = digests(batch.column(1).to_pylist(), ranks)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in d], pa.int64()), pa.array(map(as_string, d), pa.string())], ["id", "n_features", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "id long, n_features long, fingerprint string").withColumnRenamed("id", id_col)


def edited(text: str, following: str) -> str:
    """The text whose last half (rounded down) gives way to the first as many code points of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(ranks: np.ndarray):
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def rows_of(block: list[tuple], follower: tuple) -> pa.RecordBatch:
        texts = [r[3] for r in block] + [follower[3]]
        changed = [edited(a, b).encode() for a, b in zip(texts, texts[1:], strict=False)]
        own, other = digests([t.encode() for t in texts], ranks), digests(changed, ranks)
        out = [
            (None if r[2] == -(2**63) else r[2], len(r[3]), hashlib.sha256(c).hexdigest(), as_string(a), as_string(o), likeness(a, o), likeness(a, b))
            for r, c, a, b, o in zip(block, changed, own, own[1:], other, strict=False)
        ]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []  # rows that wait for the one that follows them
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block and (size > 1 << 20 or row[0] != block[0][0] or row[1]):
                    if row[0] == block[0][0]:
                        yield rows_of(block, row)
                    block, size = [], 0
                if not row[1]:
                    block.append(row)
                    size += len(row[3])

    return run, ", ".join(f"{n} {t}" for n, t in zip(names, ["long", "long", "string", "string", "string", "double", "double"], strict=True))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprint each text, its edited text and the next document, which is the next smaller id (after the last the first).

    Rows are dealt into ranges of ids (3 a shuffle partition unless given); the first row of each range is also sent, as
    a copy, behind the range before it, so that each row meets its follower in one task and texts are shuffled once.
    Only the range bounds and the ranges' first ids reach the driver. Null texts count as empty, a null id as the
    smallest; rows that repeat an id follow one another in the order of their texts' hashes. With one row the next
    document is the row itself. An empty table gives an empty result.
    """
    from pyspark.sql.functions import pandas_udf

    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = buckets or 3 * partitions
    ranks = rarity(score_histogram(docs, text_col))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), text_or_empty(text_col).alias("t"))
    bounds = np.unique(np.array(rows.select(F.percentile_approx("id", F.array(*[F.lit(i / n) for i in range(1, n)]), 10000)).first()[0] or [], dtype=np.int64)) if n > 1 else np.empty(0, np.int64)

    @pandas_udf("int")
    def bucket_of(ids):
        import pandas as pd

        return pd.Series(len(bounds) - np.searchsorted(bounds, ids.to_numpy(), side="left")).astype("int32")

    heads = sorted((r["b"], r["id"]) for r in rows.select("id", bucket_of("id").alias("b")).groupBy("b").agg(F.max("id").alias("id")).collect())  # one a bucket
    copy_to = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}

    @pandas_udf("array<int>")
    def places(ids):
        import pandas as pd

        own = (len(bounds) - np.searchsorted(bounds, ids.to_numpy(), side="left")).tolist()
        return pd.Series([[b, -1 - copy_to[i]] if i in copy_to else [b] for b, i in zip(own, ids.tolist(), strict=True)])

    dealt = rows.select("id", "t", F.explode(places("id")).alias("place")).select(
        F.when(F.col("place") < 0, -1 - F.col("place")).otherwise(F.col("place")).alias("bucket"), (F.col("place") < 0).alias("copy"), "id", "t"
    )
    met = dealt.repartition(partitions, "bucket").sortWithinPartitions("bucket", "copy", F.col("id").desc(), F.xxhash64("t"), "t")
    run, schema = _compared(ranks)
    return met.mapInArrow(run, schema)
