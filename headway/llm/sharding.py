"""Shards by rendezvous hashing.

Every shard draws a number for every key, -ln(u) / weight with u a hash of the key and the shard's number, and the
smallest draw wins.  So a shard's share follows its weight, the place of a row depends on nothing but its key and
the shards, and a shard more takes rows only into itself (a shard less gives up only its own).

Within a shard, rows are numbered without a gap.  One window per shard would be one task per shard, so rows are
dealt to buckets of a shard by hash and numbered there, after the totals of the buckets before; the table of totals
has at most ``TOTALS`` rows, whatever the input and the number of shards, and is broadcast.

Edge cases: of equal draws the shard with the smaller number wins; texts of any length count whole; a null key is a key of its own; a null text has size 1 and the checksum of nothing; repeated rows share
a shard and get slots of their own; empty tables give empty results; more columns are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOTALS = 1 << 14


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The number of the shard that wins the key."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be above zero")
    key = F.coalesce(key.cast("string"), F.lit("\0null"))
    draw = lambda i, w: -F.log((F.shiftrightunsigned(F.xxhash64(key, F.lit(i)), 11) + 0.5) / float(1 << 53)) / float(w)
    return F.array_min(F.array(*[F.struct(draw(i, w).alias("draw"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]))["shard"]


def number_rows(rows: DataFrame, shard: str, order: Sequence[str], slot: str = "slot", shards: int = 16) -> DataFrame:
    """Add a number from 0 to each row of a shard."""
    small = shards <= TOTALS
    buckets = max(1, TOTALS // shards)
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    totals = rows.groupBy(shard, "__bucket").count()
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(shard, "__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(shard, "__bucket").orderBy(*order))
    return rows.withColumn("__at", inside).join(F.broadcast(totals) if small else totals, [shard, "__bucket"]).withColumn(slot, (F.col("__before") + F.col("__at") - 1).cast("long")).drop("__bucket", "__at", "__before")


def assign(docs: DataFrame, weights: Sequence[float] = (1.0,) * 16, grown_weight: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, size, text_crc32, law, shard, slot, grown_shard`` of every row; the last with one more shard of ``grown_weight``."""
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.lit("key").alias("law"), shard_of(F.col(key), weights).alias("shard"), shard_of(F.col(key), [*weights, grown_weight]).alias("grown_shard"))
    return number_rows(rows, "shard", [key, "text_crc32", "size"], shards=len(weights))
