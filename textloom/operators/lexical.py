"""Matching sentences against dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import strip

#: Word classes that are never replaced (fixed values).
FIXED_POS = ("CLITIC", "PARTICLE", "ADPOSITION", "AUX")
#: What may stand before and after a match (fixed values).
LEFT, RIGHT = r"(?<!\w)", r"(?=[=\-~]|\b|$)"
#: A dictionary of at most so many rows and bytes of text is broadcast.
SMALL = (2**17, 2**23)


def _pieces(sentences: DataFrame, key: str, text: str) -> DataFrame:
    """key, form: the distinct parts of a sentence's tokens at = and -, and the tokens that hold one of these."""
    whole = F.filter(F.split(F.col(text), r"\s+"), lambda t: t.contains("=") | t.contains("-"))
    return sentences.select(key, F.explode(F.array_distinct(F.concat(F.split(F.col(text), r"[\s=\-]+"), whole))).alias("form"))


def _forms(dictionary: DataFrame) -> DataFrame:
    """form, word, translations: each word with its first two translations (by ord) joined by "; ". The form is the piece of
    a sentence that the word is met by: of "=" + part the part, since that stands wherever the word does, else the word."""
    w = Window.partitionBy("word").orderBy("ord")
    two = dictionary.where("word <> ''").withColumn("_r", F.row_number().over(w)).where("_r <= 2").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("ord", "translation"))).alias("t"))
    return two.select(F.regexp_replace("word", r"^=(?=[^=\-]+$)", "").alias("form"), "word", F.array_join(F.transform("t", lambda x: x["translation"]), "; ").alias("translations"))


def _join_of(dictionary: DataFrame, rows: int, size: int) -> str:
    """The join that keeps the sentences' words unsorted: the dictionary, read once for that, is broadcast if it has at most
    so many rows and bytes; else both sides are dealt by hash, and a task holds its share of the dictionary."""
    bulk = F.sum(F.octet_length("word") + F.coalesce(F.octet_length("translation"), F.lit(0)))
    n, b = dictionary.agg(F.count(F.lit(1)), F.coalesce(bulk, F.lit(0))).first()
    return "broadcast" if n <= rows and b <= size else "shuffle_hash"


def lookup_words(sentences: DataFrame, dictionary: DataFrame, key: str, text: str = "text", rows: int = SMALL[0], size: int = SMALL[1]) -> DataFrame:
    """key, word, translations: sentence tokens, their parts at = and -, and "=" + part, looked up case-sensitively; the
    first two translations (by ord) joined by "; "."""
    forms = _forms(dictionary).hint(_join_of(dictionary, rows, size))
    return _pieces(sentences, key, text).join(forms, "form").select(key, "word", "translations")


def lookup_last(sentences: DataFrame, dictionary: DataFrame, key: str, text: str = "text", rows: int = SMALL[0], size: int = SMALL[1]) -> DataFrame:
    """key, n, word, translations: how many words lookup_words gives for a key, and the last of them by bytes.

    Words are numbered in their order, by their first four bytes and inside these, since the maximum of a number is kept in
    a hash table of keys; that of a string would have all words of a task sorted by key first."""
    head = F.conv(F.rpad(F.hex(F.substring(F.col("word").cast("binary"), 1, 4)), 8, "0"), 16, 10).cast("long")
    at = F.row_number().over(Window.partitionBy("_head").orderBy("word"))
    forms = _forms(dictionary).withColumn("_head", head).withColumn("_no", F.col("_head") * 2**31 + at)
    how = _join_of(dictionary, rows, size)
    last = _pieces(sentences, key, text).join(forms.select("form", "_no").hint(how), "form").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("_no").alias("_no"))
    return last.join(forms.select("_no", "word", "translations").hint(how), "_no").select(key, "n", "word", "translations")


def whitespace_matches(sentences: DataFrame, words: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, word, rank: dictionary words that stand between white space in the sentence without punctuation, lower-cased;
    longest first, then by word. A word of one token is met by an equi-join, one of several by containment of its first."""
    plain = strip(F.regexp_replace(F.regexp_replace(F.lower(F.col(text)), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))
    base = sentences.select(key, plain.alias("_s"))
    tokens = base.select(key, "_s", F.explode(F.array_distinct(F.split("_s", " "))).alias("_first"))
    heads = words.select(F.lower(strip(F.col("word"))).alias("word")).where("word <> ''").distinct().withColumn("_first", F.substring_index("word", " ", 1))
    met = tokens.join(heads, "_first").where(F.concat(F.lit(" "), F.col("_s"), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("word"), F.lit(" "))))
    w = Window.partitionBy(key).orderBy(F.desc(F.length("word")), "word")
    return met.select(key, "word").distinct().withColumn("rank", F.row_number().over(w).cast("long"))


def greedy_matches(sentence: str, words: list[str]) -> list[tuple[str, int]]:
    """(word, start) of non-overlapping matches, longer words first, in one shared mask; affixes (= or - first) are skipped."""
    taken, out, low = [False] * len(sentence), [], sentence.lower()
    for word in sorted({w for w in words if w and w[0] not in "=-"}, key=lambda w: (-len(w), w)):
        for m in re.finditer(LEFT + re.escape(word.lower()) + RIGHT, low):
            if not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = [True] * (m.end() - m.start())
                out.append((word, m.start()))
    return sorted(out, key=lambda x: x[1])


def longest_matches(sentences: DataFrame, words: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, word, start of each sentence's greedy_matches. Sentences first meet words on a shared token, so that a sentence
    is only matched against words that may stand in it; the mask is kept a sentence at a time."""
    piece = r"[\p{L}\p{N}_]+"
    heads = words.select("word").where("word <> ''").distinct().withColumn("_t", F.regexp_extract(F.lower("word"), piece, 0))
    tokens = sentences.select(key, F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(piece), F.lit(0)))).alias("_t"))
    likely = tokens.join(heads, "_t").groupBy(key).agg(F.collect_set("word").alias("_words"))  # words met by one sentence
    both = sentences.select(key, F.col(text).alias("_text")).join(likely, key)
    kind = dict(sentences.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, w, at) for k, t, ws in zip(batch[key], batch["_text"], batch["_words"], strict=True) for w, at in greedy_matches(t, list(ws))]
            yield pd.DataFrame(rows, columns=[key, "word", "start"])

    return both.mapInPandas(run, f"{key} {kind}, word string, start long")


def predominant(senses: DataFrame, key: str, hit: Column, least: float = 0.5) -> DataFrame:
    """Keys of which at least a share of all senses hit; senses without analysis count in the whole."""
    shares = senses.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    return shares.withColumn("share", F.col("hits") / F.col("n")).where(F.col("share") >= least)


def replaceable(word: Column, pos: Column) -> Column:
    return ~word.startswith("=") & ~word.startswith("-") & (F.length(word) >= 3) & ~F.coalesce(pos.isin(*FIXED_POS), F.lit(False))


def dictionary_senses(lines: DataFrame, keys: list[str], order: str, headword: str, senses: str) -> DataFrame:
    """keys, headword, sense_no, translation: the last headword is carried to continuation lines, senses are split at
    commas, stripped and numbered in order."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = lines.withColumn("_h", F.last(headword, ignorenulls=True).over(w)).where("_h is not null")
    parts = filled.select(*keys, F.col("_h").alias("headword"), order, F.posexplode(F.split(F.col(senses), ",")).alias("_i", "_s")).withColumn("translation", strip(F.col("_s"))).where("translation <> ''")
    n = Window.partitionBy(*keys, "headword").orderBy(order, "_i")
    return parts.withColumn("sense_no", F.row_number().over(n).cast("long")).select(*keys, "headword", "sense_no", "translation")
