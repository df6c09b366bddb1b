"""Keyword tagging of sections by a weighted keyword table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import normalised, tokens

#: tag: keywords. A keyword given twice counts twice; one with a space is a phrase. Function words of four languages,
#: for corpora of general prose; pass a table of your own for other subjects.
FUNCTION_WORDS = {
    "article": ["the", "the", "a", "an", "la", "le", "les", "der", "die", "das", "el", "los"],
    "conjunction": ["and", "et", "und", "y", "or"],
    "preposition": ["of", "for", "in", "with", "de", "en", "mit", "von", "of the", "in the"],
    "copula": ["is", "was", "be", "are", "est", "ist", "es"],
    "demonstrative": ["this", "that", "that the"],
}


def keyword_table(spark, keywords: dict[str, list[str]]) -> DataFrame:
    """tag, keyword, is_phrase, multiplicity of a keyword dictionary; keywords are stripped and lower-cased."""
    counts: dict[tuple[str, str], int] = {}
    for tag, words in keywords.items():
        for w in words:
            k = (tag, w.strip().lower())
            counts[k] = counts.get(k, 0) + 1
    return spark.createDataFrame([(t, k, " " in k, n) for (t, k), n in counts.items()], "tag string, keyword string, is_phrase boolean, multiplicity int")


def keyword_counts(docs: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """key, tag, keyword, n: tokens equal to a single keyword, and occurrences of phrases in the joined tokens.

    Tokens are counted per document before they meet the table, so that the join sees each distinct token once. Phrases
    are counted by one expression each; the phrase table is small by its nature and is read on the driver.
    """
    base = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    seen = base.select("_k", F.explode(tokens(F.col("_t"))).alias("keyword")).join(F.broadcast(keywords.where("not is_phrase")), "keyword")  # the caller's keyword list
    singles = seen.groupBy("_k", "tag", "keyword").agg(F.sum("multiplicity").cast("long").alias("n"))
    phrases = keywords.where("is_phrase").select("tag", "keyword", "multiplicity").collect()
    if phrases:
        found = F.array(*[F.struct(F.lit(p.tag).alias("tag"), F.lit(p.keyword).alias("keyword"), (F.regexp_count("_n", F.lit(rf"\b{p.keyword}\b")) * p.multiplicity).cast("long").alias("n")) for p in phrases])
        pairs = base.select("_k", normalised(F.col("_t")).alias("_n")).select("_k", F.explode(found).alias("f")).where("f.n > 0")
        singles = singles.unionByName(pairs.select("_k", "f.tag", "f.keyword", "f.n"))
    return singles.select(F.col("_k").alias(key), "tag", "keyword", "n")


def keyword_tags(sections: DataFrame, key: str, heading: str, text: str, keywords: DataFrame, heading_weight: float = 2.0, threshold: float = 2.0, strong: float = 4.0) -> DataFrame:
    """key, tag, body, heading, score, strong, rank of the tags whose body count plus weighted heading count reaches the
    threshold; rank 1 is the best score, ties by tag."""
    from pyspark.sql import Window

    both = keyword_counts(sections, key, text, keywords).select(key, "tag", F.col("n").alias("body"), F.lit(0).cast("long").alias("heading")).unionByName(
        keyword_counts(sections, key, heading, keywords).select(key, "tag", F.lit(0).cast("long").alias("body"), F.col("n").alias("heading"))
    )
    sums = both.groupBy(key, "tag").agg(F.sum("body").alias("body"), F.sum("heading").alias("heading")).withColumn("score", F.col("body") + heading_weight * F.col("heading"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "tag")
    return sums.where(F.col("score") >= threshold).withColumns({"strong": F.col("score") >= strong, "rank": F.row_number().over(w).cast("long")})


def usable_sections(sections: DataFrame, key: str = "section", text: str = "text", least: int = 10) -> DataFrame:
    """Sections with a key and at least `least` code points of text."""
    return sections.where(F.col(key).isNotNull() & (F.length(text) >= least))
