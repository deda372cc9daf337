"""Chat formatting: multi-party perspective rotation, in built-in expressions only.

For every participant of a conversation the dialogue is rendered once more with that speaker as the assistant,
all others as named users and system turns as they are. A rendering is kept as one row per turn, in order, with
its place in the rendered dialogue, so that no dialogue has to fit in one task; what is to be trained on is
given as a span of the same characters (the content and closing tag of the assistant's turns).

One turn renders as ``<|role|>name\\ncontent<|end|>\\n`` (``<|assistant|>`` and ``<|system|>`` carry no name).
A ``<|`` inside a content or name gets a backslash between its two characters (one more, if some stand there
already), so tags can't be forged and the content can be restored exactly.

Offsets are prefix sums in two steps: within blocks of 256 turn numbers, and over block totals; participants too meet
turns block by block. A conversation that holds a third of all rows is therefore spread over as many tasks as it has
blocks; turns without numbers are one block.

Defined results: null text is empty; a null or empty speaker is the participant ``unknown``; rows with a null
conversation id form one conversation; turns of equal number are ordered by speaker and text, null numbers come
first; repeated rows are repeated turns. A conversation with only system turns has no participant and no rows.
An empty table gives an empty result. Columns other than the four named are not carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 256


def guarded(text: Column) -> Column:
    """``text`` without any ``<|``; restored by taking one backslash out of each ``<\\...\\|``."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def restored(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: tuple[str, ...] = ("system",)) -> DataFrame:
    """(conv_id, perspective, turn, role, name, rendered, start, length, mask_start, mask_length), one row for each
    turn and participant. Lengths are in code points; mask_length is 0 where nothing is trained on."""
    who = F.coalesce(F.nullif(F.col(f"`{speaker}`"), F.lit("")), F.lit("unknown"))
    # Keys without nulls, so that one exchange serves the offsets and the join of block totals.
    t = turns.select(
        F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), who.alias("speaker"), guarded(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("content"),
        F.coalesce(F.col(f"`{conv}`").cast("string"), F.lit("")).alias("_key"), F.col(f"`{conv}`").isNull().alias("_none"), F.coalesce(F.floor(F.col(f"`{turn}`") / BLOCK), F.lit(-(2**62))).alias("_block"),
    )
    people = t.where(~F.col("speaker").isin(*system)).select("_key", "_none", F.col("speaker").alias("perspective")).distinct()
    people = t.select("_key", "_none", "_block").distinct().join(people, ["_key", "_none"])  # a few rows of each conversation
    pairs = t.join(people, ["_key", "_none", "_block"])
    role = F.when(F.col("speaker").isin(*system), "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    pairs = pairs.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", guarded(F.col("speaker"))).otherwise(F.lit("")))
    head = F.concat(F.lit("<|"), "role", F.lit("|>"), "name", F.lit("\n"))
    pairs = pairs.withColumn("_head", F.length(head).cast("long")).withColumn("length", F.col("_head") + F.length("content") + len("<|end|>\n"))
    keys = ["_key", "_none", "perspective"]
    inner = W.partitionBy(*keys, "_block").orderBy("turn", "speaker", "content").rowsBetween(W.unboundedPreceding, -1)
    placed = pairs.withColumn("_in", F.coalesce(F.sum("length").over(inner), F.lit(0)))
    totals = pairs.groupBy(*keys, "_block").agg(F.sum("length").alias("_n"))
    outer = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, "_block", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_base"))
    out = placed.join(totals, [*keys, "_block"]).withColumn("start", F.col("_base") + F.col("_in"))
    trained = F.col("role") == "assistant"
    return out.select(
        "conv_id", "perspective", "turn", "role", "name", F.concat(head, "content", F.lit("<|end|>\n")).alias("rendered"), "start", "length",
        (F.col("start") + F.when(trained, F.col("_head")).otherwise(F.lit(0))).alias("mask_start"),
        F.when(trained, F.col("length") - F.col("_head") - 1).otherwise(F.lit(0)).alias("mask_length"),
    )


def dialogues(rendered: DataFrame) -> DataFrame:
    """One row per (conv_id, perspective) with the whole text: for conversations that fit in a task's memory."""
    parts = F.array_sort(F.collect_list(F.struct("start", "rendered")))
    return rendered.groupBy("conv_id", "perspective").agg(F.array_join(F.transform(parts, lambda p: p["rendered"]), "").alias("text"))
