"""Corpus BLEU, ChrF and ChrF++.

Definitions: BLEU as in Papineni et al. 2002 with the 13a-style tokenisation, clipped counts summed over the corpus, n up
to 4, and exponential smoothing of zero matches; ChrF as in Popovic 2015 and 2017: character n-grams up to 6 without
white space, for ChrF++ also word n-grams up to 2 with punctuation set apart, precision and recall averaged over the
orders that occur, beta 2.

A pair's n-grams only ever meet each other, so that they are counted in an Arrow batch without a shuffle; what is summed
over the corpus is 36 numbers a pair.
"""

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kind and length of the n-grams that are counted: words of BLEU, characters and words of ChrF.
ORDERS = [("b", n) for n in range(1, 5)] + [("c", n) for n in range(1, 7)] + [("w", n) for n in range(1, 3)]

#: Punctuation is set apart, but for points and commas between digits (fixed values of the tokenisation).
_APART = ((re.compile(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])"), r" \1 "), (re.compile(r"([^0-9])([\.,])"), r"\1 \2 "), (re.compile(r"([\.,])([^0-9])"), r" \1 \2"), (re.compile(r"([0-9])(-)"), r"\1 \2 "))
_MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def tokens_13a(text: str) -> list[str]:
    for pattern, to in _APART:
        text = pattern.sub(to, text)
    return text.split()


def chrf_words(text: str) -> list[str]:
    """Words, each with one trailing or else leading punctuation mark set apart."""
    out: list[str] = []
    for w in text.split():
        if len(w) > 1 and w[-1] in _MARKS:
            out += [w[:-1], w[-1]]
        elif len(w) > 1 and w[0] in _MARKS:
            out += [w[0], w[1:]]
        else:
            out.append(w)
    return out


def pair_counts(hypothesis: str, reference: str) -> list[int]:
    """(matched, hypothesis total, reference total) of each order, in one list."""
    sides = [{"b": tokens_13a(t), "c": "".join(t.split()), "w": chrf_words(t)} for t in (hypothesis, reference)]
    out: list[int] = []
    for kind, n in ORDERS:
        h, r = (Counter(x[kind][i : i + n] if kind == "c" else tuple(x[kind][i : i + n]) for i in range(len(x[kind]) - n + 1)) for x in sides)
        out += [(h & r).total(), h.total(), r.total()]
    return out


def bleu(matched: list[int], total: list[int], reference_length: int) -> float:
    """Score from corpus counts, 0 to 100. Zero matches count as halving fractions of one; no unigram match gives 0."""
    if not total or not total[0] or not matched[0]:
        return 0.0
    logs, smooth = 0.0, 1.0
    for m, t in zip(matched, total, strict=True):
        if not t:
            return 0.0
        if not m:
            smooth *= 2
        logs += math.log((m or 1 / smooth) / t)
    penalty = 1.0 if total[0] >= reference_length else math.exp(1 - reference_length / total[0])
    return 100 * penalty * math.exp(logs / len(matched))


def chrf(counts: list[tuple[int, int, int]], beta: float = 2.0) -> float:
    """Score from (matched, hypothesis, reference) counts of each order, 0 to 100; orders missing on a side are left out."""
    used = [(m / h, m / r) for m, h, r in counts if h and r]
    if not used:
        return 0.0
    p, r = (sum(x) / len(used) for x in zip(*used, strict=True))
    return 100 * (1 + beta**2) * p * r / (beta**2 * p + r) if p + r else 0.0


def corpus_scores(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_evaluated, n_skipped, BLEU, ChrF, ChrFpp (rounded to two places). pairs: keys, hypothesis, reference; a pair
    without a non-empty reference or without a hypothesis is skipped."""
    ok = (F.coalesce("reference", F.lit("")) != "") & F.col("hypothesis").isNotNull()

    @F.pandas_udf("array<long>")
    def count(hypotheses: pd.Series, references: pd.Series) -> pd.Series:
        return pd.Series([pair_counts(h, r) for h, r in zip(hypotheses, references, strict=True)])

    @F.pandas_udf("BLEU double, ChrF double, ChrFpp double")
    def score(sums: pd.Series) -> pd.DataFrame:
        out = []
        for s in sums:
            at = {o: tuple(int(x or 0) for x in s[3 * i : 3 * i + 3]) for i, o in enumerate(ORDERS)}
            b, c, w = ([v for (kind, _), v in at.items() if kind == k] for k in "bcw")
            out.append((round(bleu([x[0] for x in b], [x[1] for x in b], b[0][2]), 2), round(chrf(c), 2), round(chrf(c + w), 2)))
        return pd.DataFrame(out, columns=["BLEU", "ChrF", "ChrFpp"])

    n = 3 * len(ORDERS)
    counts = pairs.groupBy(*keys).agg(F.count_if(ok).alias("n_evaluated"), F.count_if(~ok).alias("n_skipped"))
    counted = pairs.where(ok).select(*keys, count("hypothesis", "reference").alias("c"))
    sums = counted.groupBy(*keys).agg(*[F.sum(F.col("c")[i]).alias(f"s{i}") for i in range(n)])
    scores = sums.select(*keys, F.array(*[f"s{i}" for i in range(n)]).alias("s")).select(*keys, score("s").alias("m"))
    return counts.join(scores, keys, "left").select(
        *keys, F.col("n_evaluated").cast("long").alias("n_evaluated"), F.col("n_skipped").cast("long").alias("n_skipped"), *[F.coalesce(f"m.{c}", F.lit(0.0)).alias(c) for c in ("BLEU", "ChrF", "ChrFpp")]
    )
