"""Readers of the file formats that corpora come in; all go through Spark, so that any Hadoop path works."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILE = "_metadata.file_name"


def json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one JSON array (or object) each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def _whole_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select("value", F.col(FILE).alias("file"))


def _mended(c: Column) -> Column:
    """Without a byte-order mark and without commas before a closing bracket."""
    return F.regexp_replace(F.regexp_replace(c, "^﻿", ""), r",\s*([\]}])", "$1")


def envelope_or_list(spark: SparkSession, path: str, item: str, field: str = "sentences") -> DataFrame:
    """file, ord and the items of files that hold a list, or an object with the list under `field` (missing: none).

    `item` is the DDL of one item. A file is one row, as JSON of this form can't be split.
    """
    text = _mended(F.col("value"))
    options = {"allowUnquotedControlChars": "true"}
    listed = F.when(text.rlike(r"^\s*\["), F.from_json(text, f"array<struct<{item}>>", options)).otherwise(F.from_json(text, f"struct<{field}: array<struct<{item}>>>", options)[field])
    return _whole_files(spark, path).select("file", F.posexplode(listed).alias("ord", "s")).select("file", "ord", "s.*")


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON Lines with byte-order marks, trailing commas, control characters or blank lines."""
    rows = spark.read.text(path).select(_mended(F.col("value")).alias("value")).where(r"value rlike '\\S'")
    return rows.select(F.from_json("value", schema, {"allowUnquotedControlChars": "true"}).alias("r")).select("r.*")


def dictionary_csv(spark: SparkSession, path: str) -> DataFrame:
    """page, line_idx, continuation, col1, col2 of rows with five cells or more below the header; shorter rows go."""
    rows = spark.read.option("header", True).option("mode", "PERMISSIVE").schema("page int, line_idx int, continuation string, col1 string, col2 string, _bad string").option("columnNameOfCorruptRecord", "_bad").csv(path)
    long = F.coalesce(F.size(F.split("_bad", ",")) >= 5, F.lit(True))
    return rows.where(long).select("page", "line_idx", (F.lower("continuation") == "true").alias("continuation"), "col1", "col2")


def tsv_log(spark: SparkSession, path: str, key: str = "file") -> DataFrame:
    """The last row of each key of a tab-separated log with a header, by file and position."""
    rows = spark.read.option("header", True).option("sep", "\t").csv(path)
    at = rows.select("*", F.col(FILE).alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_o"))
    w = Window.partitionBy(key).orderBy(F.desc("_f"), F.desc("_b"), F.desc("_o"))
    return at.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_f", "_b", "_o", "_r")


def matching_files(spark: SparkSession, folder: str, glob: str, fmt: str = "text") -> DataFrame:
    return spark.read.format(fmt).option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select("*", F.col(FILE).alias("file"))


#: Suffixes that a book's name loses (fixed values).
BOOK_SUFFIXES = ("_parallel_sentences_cleaned", "_cleaned")


def book_of(file: Column) -> Column:
    stem = F.regexp_replace(file, r"\.[^.]*$", "")
    for s in BOOK_SUFFIXES:
        stem = F.replace(stem, F.lit(s), F.lit(""))
    return stem


def language_of(file: Column) -> Column:
    return F.substring_index(F.regexp_replace(file, r"\.[^.]*$", ""), "_", 1)


#: Roles of files by the end of their names, first match wins (fixed values).
FILE_ROLES = (("train_baseline.jsonl", "train_baseline"), ("_train.jsonl", "train"), ("test_inference.jsonl", "test_inference"), ("test.jsonl", "test"))


def role_of(file: Column) -> Column:
    out = F.lit("other")
    for end, role in reversed(FILE_ROLES):
        out = F.when(file.endswith(end), role).otherwise(out)
    return out


def nested_rules(spark: SparkSession, path: str, fields_: tuple[str, ...] = ("description", "fst_rule", "unimorph")) -> DataFrame:
    """section, paragraph and fields of files that hold {section: {paragraph: [rules]}}."""
    inner = ", ".join(f"{f}: string" for f in fields_)
    whole = F.from_json(_mended(F.col("value")), f"map<string, map<string, array<struct<{inner}>>>>")
    sections = _whole_files(spark, path).select(F.explode(whole).alias("section", "p"))
    return sections.select("section", F.explode("p").alias("paragraph", "r")).select("section", "paragraph", F.posexplode("r").alias("ord", "x")).select("section", "paragraph", "ord", "x.*")


def or_empty(read, spark: SparkSession, schema: str) -> DataFrame:
    """What `read` gives, or an empty table of the schema where its path is missing."""
    from pyspark.errors import AnalysisException

    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def spans_of_pages(pages: DataFrame, id_col: str = "page_id", html: str = "html") -> DataFrame:
    """page, ord, level, text of headings (h1 to h6) and paragraphs of raw pages: the layout source where no page-layout
    library is at hand."""
    blocks = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:h[1-6]|p)\b[^>]*>.*?(?=</?(?:h[1-6]|p|article|footer|div|ul|body)\b)"), F.lit(0))
    rows = pages.select(F.col(id_col).alias("page"), F.posexplode(blocks).alias("ord", "b"))
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace("b", r"(?s)<[^>]*>", " "), r"\s+", " "), r"^ | $", "")
    level = F.try_to_number(F.nullif(F.regexp_extract("b", r"(?i)^<h([1-6])", 1), F.lit("")), F.lit("9")).cast("int")
    return rows.select("page", F.col("ord").cast("long").alias("ord"), level.alias("level"), text.alias("text")).where("text <> ''")


@dataclass
class Config:
    """Parameters of a pipeline run; unknown keys of a mapping are ignored, missing ones keep their defaults."""

    heading_tolerance: float = 0.5
    max_headings: int = 4
    heading_weight: float = 2.0
    tag_threshold: float = 2.0
    strong_threshold: float = 4.0
    target_words: int = 200
    min_gap: int = 0
    token_limit: int = 1_800_000
    dry_run: bool = True

    @classmethod
    def of(cls, values: dict | None) -> Config:
        known = {f.name for f in fields(cls)}
        return cls(**{k: v for k, v in (values or {}).items() if k in known})
