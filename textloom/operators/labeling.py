"""Line roles: context windows, rewriting by neighbours, islands, and blocks of source, gloss and translation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

S, G, T, O = "SOURCE", "GLOSS", "TRANSLATION", "OTHER"  # noqa: E741
#: Stands for a neighbour outside the page, so that comparisons never meet null.
NONE = "∅"


def context_window(lines: DataFrame, keys=("book",), order: str = "line_no", reach: int = 3) -> DataFrame:
    """Adds prev_3 ... next_3, empty outside the key."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = {f"prev_{k}": F.lag("text", k, "").over(w) for k in range(reach, 0, -1)}
    after = {f"next_{k}": F.lead("text", k, "").over(w) for k in range(1, reach + 1)}
    return lines.withColumns(before | after)


def context_text() -> Column:
    """The context in the format that classifiers were trained on; the first mark lacks its bracket and the space after
    it, as there (fixed value)."""
    parts = (("PREV_3] ", "prev_3"), ("[PREV_2] ", "prev_2"), (" [PREV] ", "prev_1"), (" [CURR] ", "text"), (" [NEXT] ", "next_1"), (" [NEXT_2] ", "next_2"), (" [NEXT_3] ", "next_3"))
    return F.concat(*[x for mark, name in parts for x in (F.lit(mark), F.col(name))])


def confident(role: Column, confidence: Column, second: Column, least: float = 0.95) -> Column:
    """The second label where the first is an unsure OTHER."""
    return F.when((role == O) & (confidence < least) & (second != O), second).otherwise(role)


def _rules(r: Column, p: Column, p2: Column, n: Column, n2: Column) -> list[tuple[Column, Column | str]]:
    """(condition, new role) in order of application; r is the role so far, the others are original neighbours."""
    off = lambda c: c.isin(O, NONE)
    return [
        ((r == S) & n.isin(O, S) & (p == O) & off(n2), O),
        ((r != T) & (n == S) & (n2 == G), S),
        ((r != G) & (p == S) & (n == T) & off(p2), G),
        ((r == T) & off(p) & off(n) & off(p2) & off(n2), O),
        ((r == T) & (p == S) & (n == T), G),
        ((r == S) & (p == S) & (p2 == G) & n.isin(T, S), G),
        ((r == G) & (p == G) & (n == G), S),
        ((r == G) & off(p) & (n == G) & (n2 == S), S),
        ((r == S) & (p == S) & (n == S) & (n2 == G), G),
        (
            r == O,
            F.when((n == G) & n2.isin(T, S), S).when((p == S) & (n == T), G).when((p == G) & (p2 == S), T).when((p == S) & (n == S), G).when((p == T) & (n == T), T).otherwise(r),
        ),
    ]


def rewrite_roles(lines: DataFrame, keys=("book",), order: str = "line_no", role: str = "role") -> DataFrame:
    """Adds new_role: eleven rules in order, each seeing its own role as rewritten so far and its neighbours as given.
    The last makes lines of digits and punctuation OTHER. One window serves all neighbours."""
    w = Window.partitionBy(*keys).orderBy(order)
    near = {"_p": F.lag(role, 1, NONE), "_p2": F.lag(role, 2, NONE), "_n": F.lead(role, 1, NONE), "_n2": F.lead(role, 2, NONE)}
    out = lines.withColumns({k: v.over(w) for k, v in near.items()}).withColumn("new_role", F.col(role))
    for i in range(10):
        condition, to = _rules(F.col("new_role"), F.col("_p"), F.col("_p2"), F.col("_n"), F.col("_n2"))[i]
        out = out.withColumn("new_role", F.when(condition, to).otherwise(F.col("new_role")))
    bare = F.regexp_replace("text", r"^\s+|\s+$", "")
    return out.withColumn("new_role", F.when(bare.rlike(r"(?U)^[\d\W_]+$"), O).otherwise(F.col("new_role"))).drop(*near)


def parallel_blocks(lines: DataFrame, keys=("book",), order: str = "line_no", role: str = "role") -> DataFrame:
    """keys, block, source, gloss, translation of every complete block.

    Lines that are not OTHER form runs. A run with a source line and two or more separate stretches of translation is
    cut after each stretch; a block needs a source and a translation line. Texts of a role are joined by spaces in order.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    runs = lines.withColumn("_run", F.sum((F.col(role) == O).cast("int")).over(upto)).where(F.col(role) != O)
    inside = Window.partitionBy(*keys, "_run").orderBy(order)
    whole = Window.partitionBy(*keys, "_run")
    ends = runs.withColumn("_end", ((F.col(role) == T) & (F.lead(role, 1, NONE).over(inside) != T)).cast("int"))
    cut = (F.sum("_end").over(whole) >= 2) & (F.max((F.col(role) == S).cast("int")).over(whole) == 1)
    part = F.when(cut, F.coalesce(F.sum("_end").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).otherwise(0)

    def text(of: str) -> Column:
        pieces = F.array_sort(F.collect_list(F.when(F.col(role) == of, F.struct(order, "text"))))
        return F.array_join(F.transform(pieces, lambda x: x["text"]), " ")

    found = ends.withColumn("_part", part).groupBy(*keys, "_run", "_part").agg(
        F.min(order).alias("block"), text(S).alias("source"), text(G).alias("gloss"), text(T).alias("translation"), F.bool_or(F.col(role) == S).alias("_s"), F.bool_or(F.col(role) == T).alias("_t")
    )
    return found.where("_s and _t").select(*keys, F.col("block").cast("long").alias("block"), "source", "gloss", "translation")


#: Colours of the roles in annotated output (fixed values).
COLOURS = {S: "blue", G: "green", T: "red"}


def annotations(lines: DataFrame, role: str = "role", confidence: str = "pred_conf") -> DataFrame:
    """Colour (null for other lines) and border width of each line's box."""
    from textloom.functions.text import border_width

    colour = F.coalesce(*[F.when(F.col(role) == k, v) for k, v in COLOURS.items()])
    return lines.withColumns({"colour": colour, "width": border_width(F.col(confidence))})


def scored(lines: DataFrame, scorer: Callable[[Column], dict[str, Column]]) -> DataFrame:
    """role, pred_conf and second of every line by a scorer of label weights; ties go to the label that sorts first."""
    weights = scorer(F.col("text"))
    total = sum(weights.values(), F.lit(0.0))
    ranked = F.array_sort(F.array(*[F.struct((-w / total).alias("p"), F.lit(k).alias("label")) for k, w in sorted(weights.items())]))
    return lines.withColumn("_r", ranked).withColumns({"role": F.col("_r")[0]["label"], "pred_conf": -F.col("_r")[0]["p"], "second": F.col("_r")[1]["label"]}).drop("_r")
