"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

Both conversations are rows (pair, turn, role, text). They meet turn by turn on (pair, turn), so that a conversation with
a third of all turns is still spread over many tasks; the first turn that differs, a partial minimum, ends the prompt.
The result stays in rows, one a rendered turn: the shared prefix once as `prompt`, then what is left of either side as
`chosen` and `rejected`, with the mask that says which rows are trained on. `records` joins the rows of a pair to strings
for trainers that want one row a pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import staged

#: The rendering of a turn (fixed values).
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit(MIDDLE), F.coalesce(text, F.lit("")), F.lit(END))


def one_a_turn(turns: DataFrame, key: str) -> DataFrame:
    """key, turn, role, text with one row a turn: of repeated turns the smallest (role, text); rows without key or turn go."""
    rows = turns.select(F.col(key).cast("long").alias("key"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    least = rows.where("key is not null and turn is not null").groupBy("key", "turn").agg(F.min(F.struct("role", "text")).alias("m"))
    return least.select("key", "turn", F.col("m.role").alias("role"), F.col("m.text").alias("text"))


def format_preferences(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id", trained_role: str = "assistant") -> DataFrame:
    """Rows key, part (prompt, chosen, rejected), turn, role, rendered, trained.

    The longest common prefix of turns (equal number, role and text; null equals null) is the prompt; equal
    conversations are all prompt. A pair with one side only has an empty prompt. trained marks completion turns of
    `trained_role`. Null and empty texts are rendered as empty turns; of repeated turn numbers the smallest (role, text)
    counts; rows without key or turn number are left out. Empty tables give an empty result; other columns are ignored.
    """
    c = one_a_turn(chosen, key).select("key", "turn", F.struct("role", "text").alias("c"))
    r = one_a_turn(rejected, key).select("key", "turn", F.struct("role", "text").alias("r"))
    same = F.col("c").isNotNull() & F.col("r").isNotNull() & F.col("c").eqNullSafe(F.col("r"))
    met = staged(c.join(r, ["key", "turn"], "full").select("key", "turn", "c", F.when(same, None).otherwise(F.col("r")).alias("r"), same.alias("same")), "chat-turns")
    cut = met.where("not same").groupBy("key").agg(F.min("turn").alias("cut"))
    sides = F.when(F.col("cut").isNull() | (F.col("turn") < F.col("cut")), F.array(F.struct(F.lit("prompt").alias("part"), F.col("c").alias("t")))).otherwise(
        F.array(
            F.struct(F.lit("chosen").alias("part"), F.col("c").alias("t")),
            F.struct(F.lit("rejected").alias("part"), F.when(F.col("same"), F.col("c")).otherwise(F.col("r")).alias("t")),
        )
    )
    parts = met.join(cut, "key", "left").select("key", "turn", F.explode(sides).alias("s")).where("s.t is not null")
    role = F.col("s.t.role")
    return parts.select(
        F.col("key").alias(key),
        F.col("s.part").alias("part"),
        "turn",
        role.alias("role"),
        rendered(role, F.col("s.t.text")).alias("rendered"),
        ((F.col("s.part") != "prompt") & (F.coalesce(role, F.lit("")) == trained_role)).alias("trained"),
    )


def records(parts: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row a pair: prompt, chosen, rejected, and each completion's trained spans (start, end in code points).

    A pair's turns meet in one row and so in one task; use the rows of format_preferences where a conversation may not
    fit.
    """
    ordered = Window.partitionBy(key, "part").orderBy("turn")
    upto = parts.withColumn("end", F.sum(F.length("rendered")).over(ordered)).withColumn("start", F.col("end") - F.length("rendered"))

    def text(part: str) -> Column:
        mine = F.collect_list(F.when(F.col("part") == part, F.struct("turn", "rendered")))
        return F.array_join(F.transform(F.array_sort(mine), lambda x: x["rendered"]), "").alias(part)

    def spans(part: str) -> Column:
        return F.array_sort(F.collect_list(F.when((F.col("part") == part) & F.col("trained"), F.struct("start", "end")))).alias(f"{part}_trained")

    return upto.groupBy(key).agg(text("prompt"), text("chosen"), text("rejected"), spans("chosen"), spans("rejected"))


def swapped_answers(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected conversations from plain ones: each up to its last answer, and the same with the last answer
    of the neighbour (conv_id with its lowest bit flipped). Conversations without an answer give nothing, those whose
    neighbour has none give only the chosen side."""
    turns = staged(one_a_turn(conversations, "conv_id"), "chat-conversations")
    last = turns.where("role = 'assistant'").groupBy("key").agg(F.max("turn").alias("last_turn"))
    chosen = turns.join(last, "key").where("turn <= last_turn")
    answers = chosen.where("turn = last_turn").select(F.expr("key + 1 - 2 * pmod(key, 2)").alias("key"), F.col("text").alias("answer"))
    rejected = chosen.join(answers, "key").withColumn("text", F.when(F.col("turn") == F.col("last_turn"), F.col("answer")).otherwise(F.col("text")))
    return tuple(df.select(F.col("key").alias("conv_id"), "turn", "role", "text") for df in (chosen, rejected))
