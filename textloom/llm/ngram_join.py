"""Exact Jaccard join of word n-gram sets by a grouped prefix join, with components.

1. One scan makes every document's shingle set, keeps its digest and an extended prefix in hash order, about a quarter
   of the set. Documents with equal sets form a class; its smallest id is its node.
2. Two linked sets share at least l(n) tokens of their extended prefixes. A class with fewer shared tokens there links
   with nothing and drops out, which in common text is most of them. Only the others' whole sets are made again.
3. Among these, tokens are ordered by frequency and the usual prefix is taken; tokens of one class only are counted as
   positions and then left out. Classes with the same prefix, size and position are collapsed into one group, and
   groups meet on prefix tokens under length and positional filters.
4. First every group meets the leading group of each of its tokens, and every class its group's node; verified links
   give components. Then all pairs that passed the filters *and lie in different components* are expanded to classes
   and verified: where that would be many pairs for the classes at hand, first a sixteenth of them, then a quarter of
   those that still lie in different components, then the rest, so that a family linked in many ways soon is one. Pairs inside a component need no further look, so that large families of near copies cost about one
   comparison a member, and no link between components is lost.

Frequent tokens are found in a sample of fixed size and only decide how rows are dealt: their rows are spread over salts,
and what a token's rows need to know of each other (frequency, leader) reaches them from a partial aggregate. Every count
covers all rows. Verification compares whole sets of 64-bit shingle hashes. Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import discard, staged, text_or_empty, unique_and_other
from textloom.llm.components import components
from textloom.llm.shingles import WordHashes, shingle_set

#: Per cent of a set that the extended prefix holds beyond the plain prefix.
EXTRA = 10
#: Rounds of the last step: one pair in so many is verified. The first are left out where pairs are few.
ROUNDS = (16, 4, 1)
#: Tokens that are looked at to find frequent ones, and how often a frequent one occurs among them; SAMPLE / OFTEN bounds
#: the number of frequent tokens, which are broadcast.
SAMPLE, OFTEN = 1_000_000, 20
#: Tasks that gather the counts of such a sample.
FEW = 12


def _ceil(n: str, percent: int) -> str:
    return f"(({percent} * {n} + 99) div 100)"


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.empty(0, np.int64)])))


def _sets(docs: DataFrame, k: int, percent: int, whole: bool) -> DataFrame:
    """id, n, tokens (the whole set or its extended prefix) and, of prefixes, the digest of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = WordHashes()
        for batch in batches:
            sets = [shingle_set(t.as_buffer().to_pybytes(), k, memory) for t in batch.column(1)]
            n = [len(s) for s in sets]
            if whole:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), _lists(sets)], ["id", "n", "tokens"])
            else:
                digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                heads = [s[: m - (percent * m + 99) // 100 + max(1, m * EXTRA // 100)] for s, m in zip(sets, n, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), _lists(heads), digests], ["id", "n", "tokens", "digest"])

    return docs.mapInArrow(run, "id long, n int, tokens array<long>" + ("" if whole else ", digest binary"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b and what else they hold) of nodes whose whole sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    return (
        pairs.join(left, "a")
        .join(right, "b")
        .where((100 + percent) * F.size(F.array_intersect("ta", "tb")) >= percent * (F.col("na") + F.col("nb")))
        .select(*pairs.columns)
    )


def _frequent(sets: DataFrame) -> DataFrame:
    """(token, hot) of tokens that are frequent in a sample of the sets; at most SAMPLE / OFTEN rows for sets of common size.

    The sample's size is fixed, so FEW tasks gather its counts, and as many files hold them."""
    total = sets.agg(F.sum(F.size("tokens"))).first()[0] or 0
    every = max(1, -(-total // SAMPLE))
    sample = sets.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0) if every > 1 else sets
    return staged(sample.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= OFTEN).select("token", F.lit(True).alias("hot")).coalesce(FEW), "ngram-frequent")


def _dealt(rows: DataFrame, frequent: DataFrame, node: str) -> DataFrame:
    """rows with `hot` and a salt that spreads the rows of frequent tokens."""
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.join(F.broadcast(frequent), "token", "left")  # at most SAMPLE / OFTEN rows
        .withColumn("hot", F.coalesce("hot", F.lit(False)))
        .withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64(node), F.lit(salts))).otherwise(0))
    )


def near_nodes(rows: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """near_components of a table whose ids are distinct longs."""
    rows = rows.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).cast("binary").alias("t"))
    made = staged(_sets(rows, k, percent, whole=False), "ngram-prefixes")
    classes = staged(
        made.where("n > 0").groupBy("digest", "n").agg(F.min(F.struct("id", "tokens")).alias("m")).select("digest", "n", F.col("m.id").alias("node"), F.col("m.tokens").alias("tokens")),
        "ngram-classes",
    )
    by_token = Window.partitionBy("token", "salt")
    shared = (
        _dealt(classes.select("node", F.explode("tokens").alias("token")), _frequent(classes), "node")
        .withColumn("alone", F.min("node").over(by_token) == F.max("node").over(by_token))
        .where("hot or not alone")
        .groupBy("node")
        .agg(F.count(F.lit(1)).alias("shared"))
    )
    needed = F.expr(f"greatest(1, ({_ceil('n', percent)} * {EXTRA}) div 100)")
    likely = staged(classes.select("node", "n").join(shared, "node").where(F.col("shared") >= needed).select("node"), "ngram-likely")
    sets = staged(
        _sets(rows.join(likely, F.col("id") == F.col("node"), "left_semi"), k, percent, whole=True).withColumnRenamed("id", "node").where("n > 0"), "ngram-sets"
    )

    frequent = _frequent(sets)
    tokens = sets.select("node", "n", F.explode("tokens").alias("token"))
    # How many sets hold a frequent token, from a partial aggregate.
    counted = staged(tokens.join(F.broadcast(frequent), "token").groupBy("token").agg(F.count(F.lit(1)).alias("dfs"), F.lit(True).alias("hot")), "ngram-counted")
    by_node = Window.partitionBy("node", "n")
    plain = f"n - {_ceil('n', percent)}"  # a prefix has one token more
    prefix = (
        _dealt(tokens, counted, "node")
        .withColumn("df", F.coalesce("dfs", F.count(F.lit(1)).over(by_token)))
        .where("df > 1")
        .withColumn("alone", F.col("n") - F.count(F.lit(1)).over(by_node))
        .withColumn("p", (F.row_number().over(by_node.orderBy("df", "token")) - 1 + F.col("alone")).cast("int"))
        .where(F.expr(f"p <= {plain}"))
    )
    # A key is a part of one set; its rows are together already. Both sides of the join are staged, so that adaptive
    # execution can split the rows of a hot key.
    keyed = staged(prefix.groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("p", "token"))).alias("key")), "ngram-keys")
    grouped = staged(keyed.groupBy("key", "n").agg(F.min("node").alias("group")), "ngram-grouped")
    # Members of a group first meet at the group's first position; where that is too late none of them can be linked.
    inner = F.expr(f"(n - key[0].p) * {100 + percent} >= {2 * percent} * n")
    named_key = F.when(F.col("node") == F.col("group"), F.col("key")).alias("key")  # once a group
    members = staged(keyed.join(grouped, ["key", "n"]).select("node", "n", "group", inner.alias("inner"), named_key), "ngram-members")
    postings = members.where(F.col("node") == F.col("group")).select("group", "n", F.explode("key").alias("k")).select("group", "n", "k.token", "k.p")

    # The leader of a token has least of its set before it.
    lead = postings.groupBy("token").agg(F.min(F.struct(F.col("p") / F.col("n"), "group", "n", "p")).alias("lead"))
    leaders = staged(lead.select("token", F.col("lead.group").alias("lead"), F.col("lead.n").alias("ln"), F.col("lead.p").alias("lp")), "ngram-leaders")
    headed = staged(postings.join(leaders, "token").select("token", "group", "n", "p", "lead", "ln", "lp"), "ngram-blocks")

    def passes(n1: str, p1: str, n2: str, p2: str):
        return F.expr(f"least({n1} - {p1}, {n2} - {p2}) * {100 + percent} >= {percent} * ({n1} + {n2}) and least({n1}, {n2}) * 100 >= {percent} * greatest({n1}, {n2})")

    first = (
        headed.where("group <> lead")
        .where(passes("n", "p", "ln", "lp"))
        .select(F.col("group").alias("a"), F.col("lead").alias("b"))
        .unionByName(members.where("inner and node <> group").select(F.col("node").alias("a"), F.col("group").alias("b")))
        .distinct()
    )
    links = staged(_verified(first, sets, percent), "ngram-links")
    near = staged(components(links), "ngram-near")

    # One row a node here, as in members.
    placed = staged(members.join(near, "node", "left").select("node", "group", "inner", F.coalesce("component", "node").alias("c")), "ngram-placed")
    spans = placed.groupBy("group").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.bool_or("inner").alias("inner"), F.count(F.lit(1)).alias("size"))
    lead_c = placed.select(F.col("node").alias("lead"), F.col("c").alias("main")).distinct()
    spread = staged(headed.join(spans.drop("inner"), "group").join(lead_c, "lead").select("token", "group", "n", "p", "low", "high", "size", "main"), "ngram-spread")
    short = {"group": "g", "n": "n", "p": "p", "low": "l", "high": "h", "size": "s"}
    odd = spread.where("low <> main or high <> main").select("token", *(F.col(x).alias(f"{y}1") for x, y in short.items()))
    any_ = spread.select("token", *(F.col(x).alias(f"{y}2") for x, y in short.items()))
    # The smaller group of a pair comes first: its members are the ones that are listed for each pair.
    one, two = (F.struct(F.col(f"s{i}").alias("s"), F.col(f"g{i}").alias("g")) for i in (1, 2))
    met = (
        odd.join(any_, (odd.token == any_.token) & (F.col("g1") != F.col("g2")) & passes("n1", "p1", "n2", "p2") & ((F.col("l1") != F.col("l2")) | (F.col("h1") != F.col("h2")) | (F.col("l1") != F.col("h1"))))
        .select(F.least(one, two).alias("x"), F.greatest(one, two).alias("y"))
        .select(F.col("x.g").alias("g1"), F.col("y.g").alias("g2"), (F.col("x.s") * F.col("y.s")).alias("pairs"))
        .unionByName(spans.where("inner and low <> high").select(F.col("group").alias("g1"), F.col("group").alias("g2"), (F.col("size") * F.col("size")).alias("pairs")))
        .distinct()
    )
    meet = staged(met, "ngram-meet")
    many = meet.agg(F.sum("pairs")).first()[0] or 0
    at, apart = placed.select("node", "group", "c"), meet
    for one_in in ROUNDS if many > 4 * placed.count() else ROUNDS[-1:]:
        share = F.pmod(F.xxhash64("node"), F.lit(one_in)).alias("share")
        one = at.select(F.col("group").alias("g1"), F.col("node").alias("a"), F.col("c").alias("ca"), share)
        two = at.select(F.col("group").alias("g2"), F.col("node").alias("b"), F.col("c").alias("cb"), share)
        x, y = (F.struct(F.col(n).alias("n"), F.col(c).alias("c")) for n, c in (("a", "ca"), ("b", "cb")))
        last = (
            apart.join(one, "g1")
            .join(two, ["g2", "share"])
            .where("ca <> cb")
            .select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y"))
            .select(F.col("x.n").alias("a"), F.col("y.n").alias("b"), F.col("x.c").alias("ca"), F.col("y.c").alias("cb"))
            .distinct()
        )
        across = staged(_verified(last, sets, percent), "ngram-across")
        merged = staged(components(across.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "ngram-merged").withColumnRenamed("node", "c")
        at = staged(at.join(merged, "c", "left").select("node", "group", F.coalesce("component", "c").alias("c")), "ngram-at")
        if one_in > 1:  # groups that lie in one component together need no further look
            spans = at.groupBy("group").agg(F.min("c").alias("low"), F.max("c").alias("high"))
            apart = apart.join(spans.toDF("g1", "l1", "h1"), "g1").join(spans.toDF("g2", "l2", "h2"), "g2").where("l1 <> h1 or l2 <> h2 or l1 <> l2")
            apart = staged(apart.select("g1", "g2"), "ngram-apart")
    final = at.select("node", F.col("c").alias("component"))

    named = staged(classes.select("digest", "n", "node").join(final, "node", "left").select("digest", "n", F.coalesce("component", "node").alias("component")), "ngram-named")
    for table in (classes, likely, sets, frequent, counted, keyed, grouped, members, leaders, headed, links, near, placed, spread, meet):
        discard(table)
    return made.select("id", "n", "digest").join(named, ["digest", "n"], "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def numbered(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """docs with `_row`, a distinct long of every row, and (_other, _id) of the rows whose number is not their id: those of
    null and repeated ids, which are numbered behind the largest id. Where that leaves no room, all rows are numbered."""
    unique, others = unique_and_other(docs, id_col, "ngram-ids")
    last = unique.agg(F.max(id_col)).first()[0]
    if last is not None and last >= 2**61:
        unique, others = unique.limit(0), staged(docs.withColumn("_row", F.monotonically_increasing_id()), "ngram-numbered")
        last = None
    others = others.withColumn("_row", F.col("_row") + F.lit(0 if last is None else max(int(last) + 1, 0)))
    rows = unique.withColumn("_row", F.col(id_col).cast("long")).unionByName(others)
    return rows, others.select(F.col("_row").alias("_other"), F.col(id_col).cast("long").alias("_id"))


def _with_ids(found: DataFrame, others: DataFrame) -> DataFrame:
    """near_nodes of numbered rows with the id of each row (_id) and whether its number is another (_odd)."""
    named = found.join(others, F.col("_row") == F.col("_other"), "left")
    return named.select("_row", "n_shingles", "component_id", F.col("_other").isNotNull().alias("_odd"), F.when(F.col("_other").isNull(), F.col("_row")).otherwise(F.col("_id")).alias("_id"))


def near_components(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (smallest id reachable by links of Jaccard >= percent / 100).

    Words are what stands between ASCII white space, A-Z lower-cased; a text of fewer than k words is one shingle; null,
    empty and blank texts have none and link with nothing (their component is their own id). Every row is a node of its
    own: rows that repeat an id, or have none, link by their own text alone and keep their id; a component's id is null
    where all its rows have a null id. Ties can't arise. An empty table gives an empty result; other columns are ignored
    whatever their names. Every text is read whole.
    """
    rows, others = numbered(docs.select(F.col(id_col).cast("long").alias("doc"), text_or_empty(text_col).alias("text")), "doc")
    found = near_nodes(rows, k, percent, "_row", "text")
    if others.isEmpty():
        return found.withColumnRenamed("_row", id_col)
    named = staged(_with_ids(found, others), "ngram-rows")
    # A component's number is its smallest row; its smallest id may be another's where one of its rows is odd.
    odd = named.where("_odd").select("component_id").distinct()
    least = staged(named.join(odd, "component_id", "left_semi").groupBy("component_id").agg(F.min("_id").alias("least"), F.lit(True).alias("mixed")), "ngram-least")
    number = F.when(F.col("mixed"), F.col("least")).otherwise(F.col("component_id"))
    return named.join(least, "component_id", "left").select(F.col("_id").alias(id_col), "n_shingles", number.alias("component_id"))


def drop_near_copies(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each component the row of smallest id, null ids last.

    Every row is a node of its own, as in near_components; of rows that share the smallest id any one stays. Rows without
    words all stay. A column named `_row` is set aside and given back.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    of = {n.lower(): f"c{i}" for i, n in enumerate(names)}
    rows, others = numbered(plain, of[id_col.lower()])
    found = _with_ids(near_nodes(rows, k, percent, "_row", of[text_col.lower()]), others)
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).alias("m"))
    stays = staged(first.select(F.col("m._row").alias("_stays")), "ngram-stays")
    return rows.join(stays, F.col("_row") == F.col("_stays"), "left_semi").drop("_row").toDF(*names)
