"""Preference formatting of chat, in DataFrame operations only.

A pair is two conversations, chosen and rejected, given as turn tables (pair_id, turn, role, text). Their longest
common prefix of turns is rendered once as the prompt; what follows is rendered as the two completions, each with the
spans of it that are trained on: the texts and end marks of assistant turns. All other characters are masked.

A row of the result is a pair of conversations, so each conversation is gathered; nothing else is.

Defined results: null roles and texts are the empty string; turns are ordered by turn, then role and text, nulls first, so repeated
turns are turns each; a pair with only one side has an empty prompt and an empty other completion; the prefix never takes a side's last
assistant turn away when the sides are equal (then the completions hold that turn on); null pair ids are dropped (they pair nothing);
"<|" inside texts is escaped by a backslash, which can be undone, so a text can't end its turn; very long texts are rendered whole; a conversation whose next one has no reply is paired with an
empty answer; extra columns are ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The marks of the rendering.
OPEN, CLOSE, END = "<|im_start|>", "<|im_end|>", "\n"


def _turns(side: DataFrame) -> DataFrame:
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return side.where(F.col("pair_id").isNotNull()).groupBy("pair_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))


def _safe(text: Column) -> Column:
    """A backslash more between "<" and "|"; taking one away from each such place gives the text back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), _safe(t["role"]), F.lit("\n"))


def body(t: Column) -> Column:
    return F.concat(_safe(t["text"]), F.lit(CLOSE))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), body(t), F.lit(END))), "")


def trained(turns: Column, role: str) -> Column:
    """"start:end" of the trained spans in render(turns), in code points, end exclusive, comma-joined."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc, t):
        a = acc["at"] + F.length(head(t))
        b = a + F.length(body(t))
        span = F.when(t["role"] == role, F.array(F.concat_ws(":", a.cast("string"), b.cast("string")))).otherwise(F.expr("cast(array() as array<string>)"))
        return F.struct((b + len(END)).alias("at"), F.concat(acc["out"], span).alias("out"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["out"], ","))


def preference_format(chosen: DataFrame, rejected: DataFrame, role: str = "assistant") -> DataFrame:
    """(pair_id, n_prefix, prompt, chosen, rejected, chosen_spans, rejected_spans) for every pair."""
    none = F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")
    sides = _turns(chosen).withColumnRenamed("turns", "a").join(_turns(rejected).withColumnRenamed("turns", "b"), "pair_id", "full")
    sides = sides.select("pair_id", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    first = F.array_position(same, False).cast("int")  # 1-based, 0 if none differs
    common = F.when(first > 0, first - 1).otherwise(F.size(same))
    # Equal sides: the last assistant turn stays with the completions.
    last = F.size("a") - F.array_position(F.transform(F.reverse("a"), lambda t: t["role"] == role), True).cast("int")
    prefix = F.when((common == F.size("a")) & (common == F.size("b")) & (last < F.size("a")), last).otherwise(common)
    at = sides.withColumn("n_prefix", prefix)
    rest = lambda c: F.slice(c, F.col("n_prefix") + 1, F.greatest(F.size(c) - F.col("n_prefix"), F.lit(0)))
    at = at.select("pair_id", F.col("n_prefix").cast("long"), F.slice("a", 1, F.col("n_prefix")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return at.select(
        "pair_id",
        "n_prefix",
        render(F.col("p")).alias("prompt"),
        render(F.col("a")).alias("chosen"),
        render(F.col("b")).alias("rejected"),
        trained(F.col("a"), role).alias("chosen_spans"),
        trained(F.col("b"), role).alias("rejected_spans"),
    )


def next_reply_pairs(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs from plain conversations: chosen is a conversation; rejected is the same up to its last assistant turn,
    answered as the conversation with the next id ends (the empty string if there is none)."""
    base = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    reply = base.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("r"))
    other = reply.select((F.col("conv_id") - 1).alias("conv_id"), F.col("r.text").alias("other"))
    marks = reply.select("conv_id", F.col("r.turn").alias("last")).join(other, "conv_id", "left")
    chosen = base.join(marks.select("conv_id"), "conv_id", "left_semi").withColumnRenamed("conv_id", "pair_id")
    kept = base.join(marks.select("conv_id", "last"), "conv_id").where("turn < last").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    end = marks.select(F.col("conv_id").alias("pair_id"), F.col("last").alias("turn"), F.lit("assistant").alias("role"), F.coalesce("other", F.lit("")).alias("text"))
    return chosen, kept.union(end)
