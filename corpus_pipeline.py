"""A training-data pipeline over documents: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import scratch, staged
from textloom.llm.exact_dedup import drop_copies
from textloom.llm.mixing import source_mix
from textloom.llm.ngram_join import drop_near_copies, numbered
from textloom.llm.packing import pack
from textloom.llm.quality_gam import keep_good, train
from textloom.session import table

#: Near copies share five-word shingles with a Jaccard similarity of at least 0.8.
SHINGLE_WORDS, NEAR_PERCENT = 5, 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model accepts; it is fitted on this stage's own documents.

    Every row is judged by its text alone: null texts count as empty, repeated rows fare alike, a score of exactly one half
    is accepted, and rows without id or label teach nothing. Without labels every score is one half and all rows stay. An
    empty table stays empty; other columns come through untouched.
    """
    return keep_good(docs, train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row: most code points, then smallest id, null ids last; of rows alike in both any one.

    Null, empty and blank texts are one group. Texts are compared whole. An empty table stays empty; other columns come
    through untouched.
    """
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row of smallest id, null ids last; of rows that share that id any one.

    Every row is a node of its own, so that null and repeated ids neither link strangers nor lose rows. Rows without words
    link with nothing and all stay. An empty table stays empty; other columns come through untouched.
    """
    return drop_near_copies(docs, SHINGLE_WORDS, NEAR_PERCENT)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them: rows taken twice appear twice, others not taken at all.

    Null sources are a source of their own; rows without words add nothing and are taken as often as whole passes go.
    Rows are told apart by an internal number, so that null and repeated ids are mixed row by row. Ties in the seeded order
    go by that number. An empty table stays empty; other columns come through untouched whatever their names.
    """
    names = docs.columns
    at = {n.lower(): f"c{i}" for i, n in enumerate(names)}
    plain = docs.toDF(*at.values())
    rows, _ = numbered(plain, at["doc_id"])
    taken, _ = source_mix(rows.select("_row", F.col(at["source"]).alias("source"), F.col(at["text"]).alias("text")), id_col="_row")
    repeats = staged(taken.where("repeats > 0").select(F.col("id").alias("_id"), F.col("repeats").alias("_repeats")), "mixture-repeats")
    chosen = rows.join(repeats, F.col("_row") == F.col("_id"))
    return chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_repeats")))).select(*at.values()).toDF(*names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces in batches of one length bucket each.

    Null, empty and blank texts give no piece; repeated rows, and rows of null id, are packed each; ties in the seeded order
    are broken by id and piece. An empty table gives no pieces; other columns are ignored.
    """
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixture", mixture),
    ("packing", packing),
]

#: A fitted model, seeded selection and dynamic programming have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. What a stage has staged is deleted when its result is written; the last result is lazy, and
    what it reads stays in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        if i + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with scratch(spark, f"pipeline-{name}"):
            docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
