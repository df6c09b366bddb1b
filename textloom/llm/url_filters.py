"""URL rules and link-graph propagation over hosts, native DataFrame operations only.

Every url is first judged by rules (host, path); the longest fitting rule decides. Where none fits, the host's place in
the link graph decides: personalised PageRank carries trust from trusted hosts along links, and distrust flows from
blocked hosts against them, so that a host that links to blocked ones is distrusted. A host is a seed when rules allow
(or block) more than half of its pages; it is blocked when its distrust exceeds `ratio` times its trust.

Edges are aggregated by pair of hosts before anything is joined. An iteration is two joins and one aggregation on hosts,
written to the shared folder; the driver reads one number of each.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import staged

#: Rules of the contract (fixed values): action, host and path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DAMPING = 0.85
#: Rounds that the SQL unrolls; the operator itself goes on until the ranks have converged.
ROUNDS = 10
#: Ranks count to so many places; the iteration ends when all that is still to come adds up to a tenth of the last.
PLACES = 6

#: An absolute or scheme-relative link; its host is the group.
LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s<>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    return _lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(rules, host: Column, path: Column, of: str) -> Column:
    """The rule (of="rule") or action (of="action") of the longest rule that fits, else null. Meant for short lists."""
    found = F.lit(None).cast("string")
    for action, rule in sorted(rules, key=lambda r: len(r[1])):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(slash + rest)
        found = F.when(fits, F.lit(rule if of == "rule" else action)).otherwise(found)
    return found


def judged(pages: DataFrame, rules=RULES, id_col: str = "page_id") -> DataFrame:
    """id, host, path, rule, action of every page."""
    host, path = host_and_path(F.col("url"))
    parts = pages.select(F.col(id_col).alias("id"), F.col("url").cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"))
    return parts.withColumns({"rule": rule_for(rules, F.col("host"), F.col("path"), "rule"), "action": rule_for(rules, F.col("host"), F.col("path"), "action")})


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, w): links between different hosts, with their number."""
    host, _ = host_and_path(F.col("url"))
    links = pages.select(F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).select(
        host.alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("dst")
    )
    return links.select("src", _lower(F.col("dst")).alias("dst")).where("src <> dst and src <> '' and dst <> ''").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def host_ranks(rows: DataFrame, pages: DataFrame, damping: float = DAMPING, tolerance: float = 0.1**PLACES / 10) -> DataFrame:
    """(host, trust, distrust) of every host that is a seed or was reached; all others have none of either.

    A round hands on at most `damping` of what the last one changed, summed over hosts; so what is still to come is at
    most damping / (1 - damping) of the last change. Rounds go on until that is below the tolerance, which bounds them by
    log(tolerance * (1 - damping) / seeds) / log(damping), 111 for one seed.
    """
    seeds = staged(
        rows.where("host <> ''")
        .groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "allow").alias("a"), F.count_if(F.col("action") == "block").alias("b"))
        .select("host", (2 * F.col("a") > F.col("n")).cast("double").alias("s_trust"), (2 * F.col("b") > F.col("n")).cast("double").alias("s_distrust"))
        .where("s_trust + s_distrust > 0"),
        "url-seeds",
    )
    edges = staged(host_edges(pages), "url-edges")
    given = edges.groupBy("src").agg(F.sum("w").alias("out"))
    taken = edges.groupBy("dst").agg(F.sum("w").alias("in"))
    shares = staged(edges.join(given, "src").join(taken, "dst").select("src", "dst", (F.col("w") / F.col("out")).alias("forth"), (F.col("w") / F.col("in")).alias("back")), "url-shares")
    ranks = seeds.select("host", F.col("s_trust").alias("trust"), F.col("s_distrust").alias("distrust"))
    mass = seeds.agg(F.sum(F.col("s_trust") + F.col("s_distrust"))).first()[0] or 0
    bound = math.ceil(math.log(tolerance * (1 - damping) / mass) / math.log(damping)) if mass else 0
    for _ in range(bound):
        forth = shares.join(ranks.where("trust > 0"), F.col("src") == F.col("host")).select(F.col("dst").alias("host"), (F.col("trust") * F.col("forth")).alias("t"), F.lit(0.0).alias("d"))
        back = shares.join(ranks.where("distrust > 0"), F.col("dst") == F.col("host")).select(F.col("src").alias("host"), F.lit(0.0).alias("t"), (F.col("distrust") * F.col("back")).alias("d"))
        begun = seeds.select("host", (F.col("s_trust") / damping).alias("t"), (F.col("s_distrust") / damping).alias("d"))
        moved = begun.unionByName(forth).unionByName(back).groupBy("host").agg(F.sum("t").alias("t"), F.sum("d").alias("d"))
        now = moved.select("host", (damping * F.col("t")).alias("trust"), (damping * F.col("d")).alias("distrust"))
        change = (F.abs(F.col("trust") - F.coalesce("t0", F.lit(0.0))) + F.abs(F.col("distrust") - F.coalesce("d0", F.lit(0.0)))).alias("change")
        both = now.join(ranks.select("host", F.col("trust").alias("t0"), F.col("distrust").alias("d0")), "host", "left")
        after = staged(both.select("host", "trust", "distrust", change), "url-ranks")
        moving = after.agg(F.sum("change")).first()[0] or 0
        ranks = after.drop("change")
        if moving * damping / (1 - damping) < tolerance:
            break
    return ranks.select("host", F.round("trust", PLACES).alias("trust"), F.round("distrust", PLACES).alias("distrust"))


def filter_urls(pages: DataFrame, rules=RULES, ratio: float = 1.0, id_col: str = "page_id") -> DataFrame:
    """Per row of pages: id, host, path, rule, verdict, trust, distrust.

    A host without rank has 0 of both and is allowed, as is one whose distrust ties with its trust. A null url, or one
    without ://, has empty host and path, fits no rule and is allowed. Null html has no links. Repeated rows are judged
    each and count each in their host's shares. An empty table gives an empty result; other columns are ignored.
    """
    rows = judged(pages, rules, id_col)
    ranks = host_ranks(rows, pages)
    return rows.join(ranks, "host", "left").select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("action", F.when(F.coalesce("distrust", F.lit(0.0)) > ratio * F.coalesce("trust", F.lit(0.0)), "block").otherwise("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
