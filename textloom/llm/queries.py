"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import oracle
from textloom.llm.chat_pairs import format_preferences, records, swapped_answers
from textloom.llm.exact_dedup import exact_dedup
from textloom.llm.fingerprints import compare_with_next
from textloom.llm.html_text import extract_text
from textloom.llm.license_scan import scan_licenses, scan_windows
from textloom.llm.mixing import taken_words
from textloom.llm.ngram_join import near_components
from textloom.llm.packing import pack
from textloom.llm.quality_gam import score_quality, train
from textloom.llm.url_filters import filter_urls
from textloom.session import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op3_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken_words(table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op8_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))


def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen, rejected = swapped_answers(table(spark, sf_dir, "conversations"))
    return format_preferences(chosen, rejected, "conv_id")


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def license_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_windows(table(spark, sf_dir, "documents"))


def preference_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs of op9, one row each."""
    return records(op9_preference_format(spark, sf_dir), "conv_id")


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_url_filter, op2_license_scan, op3_length_packing, op4_ngram_jaccard, op5_source_mix, op6_html_text, op7_exact_dedup, op8_quality_gam, op9_preference_format, op10_fingerprint)
    return {f.__name__: f for f in (*ops, license_windows, preference_records)} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
