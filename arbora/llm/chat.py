"""Preference formatting: the longest common turn prefix of two conversations is the prompt, and their rests are paired completions.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import only
from .spans import scan

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"
#: The role whose words are learnt; all else is masked.
LEARNT = "assistant"


def render(turns: Column) -> Column:
    """Turns (role, text) in the chat template, as one text."""
    return F.concat_ws("", F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(MIDDLE), t["text"], F.lit(CLOSE))))


def learnt_spans(turns: Column) -> Column:
    """array<struct<start, end>>: where the learnt role's texts, with their end marks, stand in render(turns); code points, end exclusive."""
    size = lambda t: (F.char_length(t["role"]) + F.char_length(t["text"]) + len(OPEN) + len(MIDDLE) + len(CLOSE)).cast("long")
    ends = scan(F.transform(turns, size), lambda a, b: a + b)
    learnt = F.filter(F.arrays_zip(ends.alias("end"), turns.alias("t")), lambda z: z["t"]["role"] == LEARNT)
    return F.transform(learnt, lambda z: F.struct((z["end"] - F.char_length(z["t"]["text"]) - len(CLOSE)).alias("start"), z["end"].alias("end")))


def common_turns(a: Column, b: Column) -> Column:
    """The number of leading turns that two conversations share in role and text."""
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: F.coalesce((z["a"]["role"] == z["b"]["role"]) & (z["a"]["text"] == z["b"]["text"]), F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same).cast("long"))


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """One row for each two conversations 2k (chosen) and 2k + 1 (rejected): pair_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans.

    Turns are ordered by turn, then role, then text; a repeated row counts
    once; a null role or text counts as empty; rows with a null conv_id are
    left out, and so are conversations without a partner. Equal conversations
    are all prompt and have empty completions. Texts, however long, are rendered
    whole; an empty table gives no rows; other columns are ignored. The spans are what a completion's loss is taken on.
    """
    rows = only(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    side = rows.select(
        F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id"),
        F.struct(F.col("conv_id").cast("long").bitwiseAND(F.lit(1).cast("long")).alias("side"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).alias("t"),
    )
    both = side.groupBy("pair_id").agg(F.array_sort(F.collect_set("t")).alias("t"))
    pairs = both.select("pair_id", F.filter("t", lambda t: t["side"] == 0).alias("a"), F.filter("t", lambda t: t["side"] == 1).alias("b")).where("size(a) > 0 AND size(b) > 0")
    pairs = pairs.withColumn("n", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, (F.col("n") + 1).cast("int"), F.greatest(F.size(c) - F.col("n"), F.lit(0)).cast("int"))
    head = pairs.select("pair_id", F.col("n").alias("prompt_turns"), F.slice("a", F.lit(1), F.col("n").cast("int")).alias("p"), rest(F.col("a")).alias("a"), rest(F.col("b")).alias("b"))
    return head.select("pair_id", "prompt_turns", render(F.col("p")).alias("prompt"), render(F.col("a")).alias("chosen"), render(F.col("b")).alias("rejected"), learnt_spans(F.col("a")).alias("chosen_spans"), learnt_spans(F.col("b")).alias("rejected_spans"))


def pair_report(conversations: DataFrame) -> DataFrame:
    """preference_pairs with the spans as start:end, comma-joined."""
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))))
    return preference_pairs(conversations).withColumns({c: joined(F.col(c)) for c in ("chosen_spans", "rejected_spans")})
