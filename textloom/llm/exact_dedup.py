"""Exact deduplication by salted combining of digest groups, native DataFrame operations only.

Plan
1. A narrow table (id, digest, length) of all rows is staged. Rows whose digest occurs once have no copy and need
   nothing more; their texts are never shuffled for comparison.
2. The texts of rows with a shared digest go through three levels, each grouping on digest *and* whole normalised text:
   the map-side partial aggregate drops copies inside a task, whose rows all have one salt; a salted aggregate merges each
   digest's copies in `salts` independent groups, and a last aggregate combines the salt winners. A group with a third of
   all rows therefore leaves each task as one row and reaches the last level as at most `salts` rows.
3. Every row finds its group's winner by a join on the narrow table; the hot side of that join is one that adaptive
   execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SPACE, staged, text_or_empty, unique_and_other

#: Largest long, and the span of a long as a decimal: a winner (most code points, then smallest id) is packed into one
#: decimal, which hash aggregates can hold in place (fixed values).
TOP = 9223372036854775807
SPAN = 18446744073709551616


def normalised(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, f"[{SPACE}]+", "")


def _rank(n_chars: str, doc_id: str) -> Column:
    """Larger for more code points, then for a smaller id. A null id counts as the largest id."""
    return F.expr(
        f"cast({n_chars} as decimal(10,0)) * cast({SPAN} as decimal(20,0))"
        f" + (cast({TOP} as decimal(20,0)) - cast(coalesce({doc_id}, {TOP}) as decimal(20,0)))"
    ).cast("decimal(38,0)")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after white space is deleted; a null text counts as empty, so null, empty and blank
    texts form one group. Of equal texts the row with the most code points stays, then the smallest id; a null id comes
    last and its keep_id is the largest long when it wins. Rows that repeat an id with the same text share one verdict.
    An empty table gives an empty result; other columns of docs are ignored whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    narrow = staged(
        rows.select("id", F.length("t").alias("n"), normalised(F.col("t")).alias("s")).select(
            "id", "n", F.sha2(F.col("s"), 256).alias("digest"), F.xxhash64("s").alias("mark")
        ),
        "exact-dedup",
    )
    # Small sides are staged, so that both sides of their joins are plain shuffles and a hot digest's rows can be split.
    shared = staged(narrow.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("digest"), "exact-dedup-shared")
    repeated = staged(narrow.join(shared, "digest", "left_semi").where("id is not null").select(F.col("id").alias("rid")).distinct(), "exact-dedup-repeated")
    texts = (
        rows.join(repeated, F.col("id") == F.col("rid"), "left_semi")
        .unionByName(rows.where("id is null"))  # as a join key, null would be a hot one
        .select("id", F.length("t").alias("n"), normalised(F.col("t")).alias("s"))
        .select(
            F.sha2(F.col("s"), 256).alias("digest"), "s", F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"), _rank("n", "id").alias("rank")
        )
    )
    salted = texts.groupBy("digest", "s", "salt").agg(F.max("rank").alias("rank"), F.count(F.lit(1)).alias("c"))
    groups = staged(
        salted.groupBy("digest", "s").agg(F.max("rank").alias("top"), F.sum("c").alias("c")).where("c > 1").select("digest", F.xxhash64("s").alias("mark"), "top", "c"),
        "exact-dedup-groups",
    )
    keep = F.expr(f"cast({TOP} - pmod(top, cast({SPAN} as decimal(20,0))) as bigint)")
    return narrow.join(groups, ["digest", "mark"], "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("top").isNull(), F.col("id")).otherwise(keep).alias("keep_id"),
        F.coalesce("c", F.lit(1)).cast("long").alias("group_size"),
        (F.col("top").isNull() | (F.col("top") == _rank("n", "id"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts exactly one. exact_dedup's verdict is by id; rows
    that share their id with others, null ids among them, are numbered to tell them apart."""
    unique, others = unique_and_other(docs, id_col, "drop-copies")
    verdicts = staged(exact_dedup(docs, id_col, text_col, salts).where("kept").select(F.col(id_col).alias("_kept_id"), "text_sha256"), "drop-copies-kept")
    first = (
        others.select("_row", F.coalesce(F.col(id_col), F.lit(TOP)).alias("_id"), text_or_empty(text_col).alias("_t"))
        .select(F.sha2(normalised(F.col("_t")), 256).alias("_digest"), F.struct(-F.length("_t"), "_id", "_row").alias("_rank"))
        .groupBy("_digest")
        .agg(F.min("_rank").alias("_rank"))
        .select("_digest", F.col("_rank._row").alias("_first"), F.col("_rank._id").alias("_id"))
    )
    # A digest's best row among the others stays where the verdict is for its id.
    won = verdicts.select(F.coalesce("_kept_id", F.lit(TOP)).alias("_won"), "text_sha256").distinct()
    stays = first.join(won, (F.col("_digest") == F.col("text_sha256")) & (F.col("_id") == F.col("_won")), "left_semi").select("_first")
    rest = others.join(stays, F.col("_row") == F.col("_first"), "left_semi").drop("_row")
    return unique.join(verdicts.select("_kept_id"), F.col(id_col) == F.col("_kept_id"), "left_semi").unionByName(rest)
