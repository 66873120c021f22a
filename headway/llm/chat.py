"""Chat formatting by rotating the perspective in dialogues of several parties.

For every participant of a conversation (every speaker but ``system``), the whole dialogue is rendered with that speaker as
the assistant and all others as named users; what the assistant says, and its end mark, is what a loss counts.

A rendered dialogue is a table of segments, one per turn, with their place in the dialogue's text, so a conversation of
any length is never one value, nor one task: offsets are summed within buckets of ``BUCKET`` turn numbers first, and
buckets are then shifted by the sums before them.  Everything is DataFrame expressions.  Joining the texts of a
dialogue's segments in order of ``position`` gives its text.

Edge cases: turns are ordered by number (null last), then speaker, then text; repeated rows are turns of their own; a
null role is the speaker ``unknown``; a null text is empty; a null conv_id is a conversation of its own; a conversation
with system turns only has no perspective and no rows; marks in a text or name are broken up (``<|`` becomes ``< |``, in
names ``|>`` becomes ``| >`` and a line feed a blank too), so they can't forge a turn; texts of any length stay whole; an empty table gives an empty result; more columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET, SYSTEM = 256, "system"


def _safe(text: Column, default: str) -> Column:
    return F.replace(F.coalesce(text, F.lit(default)), F.lit("<|"), F.lit("< |"))


def _name(role: Column) -> Column:
    return F.replace(F.replace(_safe(role, "unknown"), F.lit("|>"), F.lit("| >")), F.lit("\n"), F.lit(" "))


def render(conversations: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``conv_id, perspective, position, turn, speaker, segment, start, end, mask_start``.

    ``segment``: the turn's text with its marks; ``start`` and ``end``: its place in characters; the loss counts from
    ``mask_start`` to ``end`` (null: not at all).
    """
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("\0null"))
    turns = conversations.select("conv_id", "turn", _name(F.col("role")).alias("speaker"), _safe(F.col("text"), "").alias("body"), key.alias("k"), F.coalesce(F.floor(F.col("turn") / bucket), F.lit((1 << 62))).alias("b"))
    parties = turns.filter(F.col("speaker") != SYSTEM).select("k", F.col("speaker").alias("perspective")).distinct()
    seen = turns.join(parties, "k")
    own = F.col("speaker") == F.col("perspective")
    head = F.when(F.col("speaker") == SYSTEM, F.lit("<|system|>\n")).when(own, F.lit("<|assistant|>\n")).otherwise(F.concat(F.lit("<|user name="), "speaker", F.lit("|>\n")))
    cut = seen.select("k", "b", "conv_id", "perspective", "turn", "speaker", "body", head.alias("head"), own.alias("own")).withColumn("segment", F.concat("head", "body", F.lit("<|end|>\n")))
    size = F.length("segment").cast("long")
    group = ["k", "perspective", "b"]
    inside = Window.partitionBy(*group).orderBy(F.col("turn").asc_nulls_last(), "speaker", "body").rowsBetween(Window.unboundedPreceding, 0)
    placed = cut.withColumns({"n": F.count("*").over(inside), "upto": F.sum(size).over(inside)})
    totals = cut.groupBy(*group).agg(F.count("*").alias("rows"), F.sum(size).alias("chars"))
    before = Window.partitionBy("k", "perspective").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    shifts = totals.select(*group, F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars"))
    end = F.col("chars") + F.col("upto")
    start = end - size
    return placed.join(shifts, group).select("conv_id", "perspective", (F.col("rows") + F.col("n") - 1).alias("position"), "turn", "speaker", "segment", start.alias("start"), end.alias("end"), F.when(F.col("own"), start + F.length("head")).alias("mask_start"))
