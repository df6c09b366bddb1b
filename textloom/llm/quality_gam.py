"""Quality classifier: a generalised additive model with pairwise interactions.

Features come from the text alone. The model is fitted on the driver from a sample of labelled rows whose size is a
parameter (`train_rows`, the labelled rows of smallest hash): cyclic boosting visits the features in turn and adds a
shallow tree of one feature each time, which sums to one lookup table a feature; then the pairs that reduce the loss
most get two-dimensional tables in the same way. Scoring every text is a few vectorised bin lookups and additions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import text_or_empty

FEATURES = ("log_words", "word_length", "letters", "upper", "digits", "marks", "symbols", "space", "high_bytes", "lines", "distinct_words", "marked_words", "upper_words", "short_words", "line_words", "repeated_lines")

_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LOWER = (_BYTE >= 97) & (_BYTE <= 122)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_MARK = np.isin(_BYTE, np.frombuffer(b".,;:'\"()-", dtype=np.uint8))
_SPACE = np.isin(_BYTE, np.frombuffer(b" \t\n\r\x0b\x0c", dtype=np.uint8))
_HIGH = _BYTE >= 128
_SYMBOL = ~(_UPPER | _LOWER | _DIGIT | _MARK | _SPACE | _HIGH)
_CLASSES = np.stack([_UPPER | _LOWER, _UPPER, _DIGIT, _MARK, _SYMBOL, _SPACE, _HIGH]).astype(np.float64)


def features_of(text: str) -> np.ndarray:
    """The features of a whole text; of an empty text all are 0."""
    out = np.zeros(len(FEATURES))
    data = text.encode()
    words = data.split()
    if not words:
        return out
    letters, upper, digits, marks, symbols, space, high = _CLASSES @ np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256) / len(data)
    n = len(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    marked = sum(w[-1:] in b"!#$%&*|?+=~^@<>" for w in words)
    out[:] = (
        np.log1p(n), (len(data) - n) / n, letters, upper, digits, marks, symbols, space, high, len(lines) / n, len(set(words)) / n,
        marked / n, sum(w.isupper() for w in words) / n, sum(len(w) <= 3 for w in words) / n, np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines),
    )
    return out


def feature_rows(texts) -> np.ndarray:
    return np.array([features_of(t) for t in texts]).reshape(-1, len(FEATURES))


@dataclass
class Gam:
    """Bin edges and a table a feature, tables of pairs, and the intercept; scores are sigmoids of sums of look-ups."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    intercept: float

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            total += table[b[j]]
        for i, j, table in self.pairs:
            total += table[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The steps of a tree with up to `leaves` leaves over ordered bins, grown best split first (leftmost of ties)."""
    cuts = [0, len(g)]
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    while len(cuts) <= leaves:
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < 2:
                continue
            at = np.arange(a + 1, b)
            gain = _gain(cg[at] - cg[a], ch[at] - ch[a], ridge) + _gain(cg[b] - cg[at], ch[b] - ch[at], ridge) - _gain(cg[b] - cg[a], ch[b] - ch[a], ridge)
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), int(at[k]))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    steps = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        steps[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return steps


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """The best cross of one cut a feature over a grid of bins: its gain and its four steps spread over the grid."""
    cg, ch = (np.pad(np.cumsum(np.cumsum(m, 0), 1), ((1, 0), (1, 0))) for m in (g, h))
    n, m = g.shape
    if n < 2 or m < 2:
        return 0.0, np.zeros_like(g)

    def quarters(c):
        a = c[1:n, 1:m]
        b = c[1:n, m][:, None] - a
        d = c[n, 1:m][None, :] - a
        return a, b, d, c[n, m] - a - b - d

    gain = sum(_gain(x, y, ridge) for x, y in zip(quarters(cg), quarters(ch), strict=True))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    steps = np.zeros_like(g)
    cut = (slice(0, i + 1), slice(i + 1, n)), (slice(0, j + 1), slice(j + 1, m))
    for rows in cut[0]:
        for cols in cut[1]:
            steps[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + ridge)
    return float(gain[i, j]) - float(_gain(g.sum(), h.sum(), ridge)), steps


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.15, leaves: int = 3, pairs: int = 6, pair_rounds: int = 40, ridge: float = 4.0) -> Gam:
    """Fit on features x and labels y (0 or 1). Rows of both labels are weighed alike; with one label the score is constant."""
    k = x.shape[1]
    if not len(y) or y.min() == y.max():
        rate_of = (y.sum() + 1) / (len(y) + 2)
        return Gam([np.empty(0)] * k, [np.zeros(1)] * k, [], float(np.log(rate_of / (1 - rate_of))))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="nearest")) for j in range(k)]
    model = Gam(edges, [np.zeros(len(e) + 1) for e in edges], [], 0.0)
    b = model.bins(x)
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    total = np.zeros(len(y))

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return weight * (y - p), weight * p * (1 - p)

    for _ in range(rounds):
        for j in range(k):
            g, h = slopes()
            size = len(model.tables[j])
            steps = rate * _tree(np.bincount(b[j], g, size), np.bincount(b[j], h, size), leaves, ridge)
            model.tables[j] += steps
            total += steps[b[j]]

    def grid(i, j, v):
        n, m = len(model.tables[i]), len(model.tables[j])
        return np.bincount(b[i] * m + b[j], v, n * m).reshape(n, m)

    g, h = slopes()
    ranked = sorted(((-_pair_tree(grid(i, j, g), grid(i, j, h), ridge)[0], i, j) for i in range(k) for j in range(i)))[:pairs]
    chosen = [[i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))] for gain, i, j in ranked if gain < 0]
    for _ in range(pair_rounds):
        for pair in chosen:
            i, j, table = pair
            g, h = slopes()
            steps = rate * _pair_tree(grid(i, j, g), grid(i, j, h), ridge)[1]
            table += steps
            total += steps[b[i], b[j]]
    model.pairs = [(i, j, t) for i, j, t in chosen]
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_rows: int = 12_000) -> Gam:
    """Fit on at most `train_rows` labelled rows outside the held-out third, those of smallest hash of the id.

    Rows without id or label are left out. The sample's features, at most train_rows * 16 numbers for distinct ids,
    reach the driver.
    """
    named = labels.select(F.col(id_col).cast("long").alias("lid"), F.col(label_col).cast("int").alias("y")).where("lid is not null and y in (0, 1)")
    sample = named.where(~held_out(F.col("lid"))).orderBy(F.xxhash64("lid"), "lid", "y").limit(train_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("t")).join(F.broadcast(sample), F.col("id") == F.col("lid"))  # train_rows rows

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "y": pdf["y"], "x": list(feature_rows(pdf["t"]))})

    got = texts.select("id", "y", "t").mapInPandas(run, "id long, y int, x array<double>").limit(2 * train_rows).toPandas()
    got = got.sort_values(["id", "y"], kind="stable")
    return fit(np.array(got["x"].tolist()).reshape(-1, len(FEATURES)), got["y"].to_numpy(dtype=np.float64))


def scorer(model: Gam):
    """A vectorised function from a text column to scores."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(feature_rows(texts)))

    return score


def score_quality(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted. Null texts count as empty; repeated rows are scored each; an empty table
    gives an empty result; a null id is not held out. Other columns are ignored."""
    rows = docs.select(F.col(id_col).alias("id"), scorer(model)(text_or_empty(text_col)).alias("score"))
    return rows.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Gam, text_col: str = "text") -> DataFrame:
    """The rows of docs that the model accepts, with all their columns."""
    return docs.withColumn("_gam_score", scorer(model)(text_or_empty(text_col))).where("_gam_score >= 0.5").drop("_gam_score")
