"""Deduplication, filtering, merging and codification of extracted rules, and related joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import strip
from textloom.operators.ranks import row_numbers

#: Descriptions that say there is no rule (fixed values).
NO_RULE = ("no applicable rule found", "no valid rules")


def distinct_on(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order. An aggregate, so that copies of a hot key are combined before they are
    shuffled and no task sorts them."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("_first")
    return rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(first).select("_first.*")


def distinct_capped(rows: DataFrame, group: str, keys: Sequence[str], order: Sequence[str], cap: int) -> DataFrame:
    """Distinct on (group, keys), then the first `cap` rows of each group (a top-k report)."""
    one = distinct_on(rows, [group, *keys], order)
    return row_numbers(one, group, list(order), "index").withColumn("index", F.col("index") + 1).where(F.col("index") <= cap)


def with_rule(rows: DataFrame, description: str = "description") -> DataFrame:
    """Rows whose description is not blank and does not say that there is no rule."""
    low = F.lower(description)
    none = low.contains(NO_RULE[0]) | low.contains(NO_RULE[1]) | (strip(F.col(description)) == "")
    return rows.where(~F.coalesce(none, F.lit(True)))


def joined(values: Column, by: str) -> Column:
    """Sorted distinct strings in one."""
    return F.array_join(F.array_sort(F.collect_set(values)), by)


def merge_rules(rules: DataFrame, keys: Sequence[str] = ("target_pos", "morpheme", "unimorph_feature", "unimorph_value"), order: str = "ord") -> DataFrame:
    """One rule a key (nulls group together): other columns from the member with the longest context ("N/A" counts 0,
    the first of equals), sorted distinct descriptions and triggers joined by " | ", contexts other than "N/A" by " AND "
    (or "N/A"), and the sources of all members in order."""
    context = F.col("context_dependency")
    weight = F.when(context.isNull() | (context == "N/A"), 0).otherwise(F.length(context))
    pick = F.struct(weight.alias("w"), (-F.col(order)).alias("o"))
    used = joined(F.when(context != "N/A", context), " AND ")
    refs = F.array_sort(F.collect_list(F.when(F.col("section_id").isNotNull() & F.col("paragraph_id").isNotNull(), F.struct(order, "section_id", "paragraph_id"))))
    merged = rules.groupBy(*keys).agg(
        F.max_by("category", pick).alias("category"),
        F.max_by("application_string", pick).alias("application_string"),
        joined(F.col("description"), " | ").alias("description"),
        joined(F.col("semantic_trigger"), " | ").alias("semantic_trigger"),
        F.when(used == "", "N/A").otherwise(used).alias("context_dependency"),
        F.transform(refs, lambda r: F.struct(r["section_id"].alias("section_id"), r["paragraph_id"].alias("paragraph_id"))).alias("section_paragraph_ids"),
        F.min(order).alias(order),
    )
    return merged


def target_pos(kind: str, c: Column) -> Column:
    """A list becomes its sorted members joined by commas, a string stays."""
    return F.array_join(F.array_sort(c), ",") if kind.startswith("array") else c


def codify(rules: DataFrame, results: DataFrame, key: str = "rule_id", columns: Sequence[str] = ("description",), added: str = "lrl_code") -> DataFrame:
    """Left join: a result overrides the named columns, also by null; rows without a result keep theirs; the added column
    is empty without one."""
    r = results.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in (*columns, added)])
    out = rules.join(r, F.col(key) == F.col("_key"), "left")
    there = F.col("_key").isNotNull()
    return out.withColumns({c: F.when(there, F.col(f"_{c}")).otherwise(F.col(c)) for c in columns} | {added: F.coalesce(f"_{added}", F.lit(""))}).select(*rules.columns, added)


def paired_by_position(left: DataFrame, right: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """keys, pos and both sides' columns (l_, r_), matched by rank inside the keys; the longer side is cut."""
    w = Window.partitionBy(*keys).orderBy(order)
    sides = [df.withColumn("pos", F.row_number().over(w).cast("long")).select(*keys, "pos", *[F.col(c).alias(f"{p}{c}") for c in columns]) for df, p in ((left, "l_"), (right, "r_"))]
    return sides[0].join(sides[1], [*keys, "pos"])


def paragraphs_of(refs: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The paragraph each reference (section, index) names; references out of range match nothing."""
    return refs.join(paragraphs, ["section", "index"])


def unresolved(requests: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Requests without a finished result."""
    return requests.join(done.select(key).distinct(), key, "left_anti")


def first_match(left: DataFrame, right: DataFrame, key: str, order: str | Sequence[str], columns: Sequence[str], default: str = "Unknown") -> DataFrame:
    """Left join with the first right row of each key; missing strings become the default. An order that repeats in a key
    needs further columns, or which of its rows comes first depends on partitions."""
    w = Window.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order))
    one = right.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(key, *columns)
    return left.join(one, key, "left").withColumns({c: F.coalesce(c, F.lit(default)) for c in columns})


def tag_features(rows: DataFrame, key: str, tags: str, mapping: DataFrame) -> DataFrame:
    """Distinct feature:value pairs of each key's gloss tags; one tag may map to several, unmapped tags go."""
    split = rows.select(key, F.explode(F.slice(F.transform(F.split(F.col(tags), r"[=.\-]"), lambda t: F.lower(strip(t))), 2, 1 << 20)).alias("tag"))
    return split.join(F.broadcast(mapping), "tag").select(key, "feature", "value").distinct()  # the caller's tag table
