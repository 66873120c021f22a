"""A global order without a single task, and what is drawn by it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def global_rank(keys: DataFrame, key: str, seed: int, digits: int = 3) -> DataFrame:
    """``key, rank`` from 1 by the seeded hash of a unique key.

    Keys are dealt to 16**digits buckets by the hash's first digits and ranked there; the bucket's start is the sum of
    the buckets before, from a table of that many rows.
    """
    rows = keys.select(key).withColumn("h", hash_key(key, seed)).withColumn("bucket", F.substring("h", 1, digits))
    counts = rows.groupBy("bucket").count()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("h", key))
    return rows.withColumn("at", inside).join(F.broadcast(starts), "bucket").select(key, (F.col("start") + F.col("at")).alias("rank"))


def split_by_key(df: DataFrame, key: str = "trip_id", seed: int = 42) -> DataFrame:
    """``key, split``: the rows' distinct keys, one fifth (rounded up) of them set aside, of which the larger half is ``test``, the rest ``val``."""
    ids = df.select(key).na.drop().distinct()
    n = ids.count()
    aside = -(-n // 5)
    test = -(-aside // 2)
    rank = F.col("rank")
    return global_rank(ids, key, seed).select(key, F.when(rank <= test, "test").when(rank <= aside, "val").otherwise("train").alias("split"))


def keys_at(ids: DataFrame, key: str, seed: int, ranks: list[int], digits: int = 4) -> list[tuple | None]:
    """``(hash, key)`` of the keys at some ranks (from 1) of the order of ``global_rank``; None for rank 0.  ids: unique keys.

    Keys are counted by the hash's first digits; only the buckets that hold a rank come to the driver, so one of 16**digits each.
    """
    h = hash_key(key, seed)
    bucket = F.substring(h, 1, digits)
    counts = sorted((r.bucket, r.n) for r in ids.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect())
    places, before = {}, 0
    for b, n in counts:
        places |= {r: (b, r - before - 1) for r in ranks if before < r <= before + n}
        before += n
    rows: dict[str, list] = {}
    for r in ids.filter(bucket.isin(sorted({b for b, _ in places.values()}))).select(h.alias("h"), key).collect():
        rows.setdefault(r.h[:digits], []).append((r.h, r[key]))
    rows = {b: sorted(x) for b, x in rows.items()}
    return [rows[places[r][0]][places[r][1]] if r else None for r in ranks]


def split_by_marks(ids: DataFrame, key: str = "trip_id", seed: int = 42) -> Column:
    """The ``split`` of ``split_by_key`` as an expression of the key alone, so that rows get it without a join.  ids: unique keys, none of them null."""
    n = ids.count()
    aside = -(-n // 5)
    h = hash_key(key, seed)
    test, val = [F.lit(False) if m is None else (h < m[0]) | ((h == m[0]) & (F.col(key) <= F.lit(m[1]))) for m in keys_at(ids, key, seed, [-(-aside // 2), aside])]
    return F.when(test, "test").when(val, "val").otherwise("train")


def split_fast(df: DataFrame, key: str = "trip_id", seed: int = 42) -> DataFrame:
    """Add ``split`` by the hash alone: no shuffle, sizes about 80, 10 and 10 per cent."""
    part = F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    return df.withColumn("split", F.when(part < 0.8, "train").when(part < 0.9, "val").otherwise("test"))


def smallest(df: DataFrame, n: int, bucket: Column, order: list[Column]) -> DataFrame:
    """The first n rows (or all) of a total order, unsorted.  bucket: a value of few kinds that never falls along the order.

    Rows are counted by bucket, which is at most a row for each; whole buckets below the one that holds the n-th row are taken as
    they lie, and only that one is sorted.
    """
    counts = sorted((r.bucket, r.n) for r in df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n")).collect())
    left = n
    for cut, size in counts:
        if size > left:
            edge = df.filter(bucket == F.lit(cut)).orderBy(*order).limit(left)
            return df.filter(bucket < F.lit(cut)).unionByName(edge)
        left -= size
    return df


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42, digits: int = 4) -> DataFrame:
    """Exactly n rows (or all) by the seeded hash of a unique key that isn't null; 16**digits buckets."""
    h = hash_key(key, seed)
    return smallest(df, n, F.substring(h, 1, digits), [h, F.col(key)])
