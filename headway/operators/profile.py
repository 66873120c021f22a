"""Profiles of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def info(df: DataFrame) -> DataFrame:
    """Each column's type and number of values that aren't null."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("non_null"), F.lit(t).alias("type")) for c, t in df.dtypes])))


def quartiles(df: DataFrame, names: list[str], buckets: int = 256) -> DataFrame:
    """``column, q25, q50, q75``, exact and interpolated.

    Different values are counted, dealt to about equal buckets of the order by a sketch, and ranked within these; a
    bucket's start is the sum of the buckets before.  So no task ranks all values of a column.
    """
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in names]))).filter("value is not null")
    counts = cells.groupBy("column", "value").agg(F.count("*").alias("n"))
    bounds = counts.groupBy("column").agg(F.percentile_approx("value", [i / buckets for i in range(1, buckets)], 10_000).alias("bounds"))
    dealt = counts.join(F.broadcast(bounds), "column").withColumn("bucket", F.size(F.filter("bounds", lambda b: b < F.col("value")))).drop("bounds")
    column = Window.partitionBy("column")
    sums = dealt.groupBy("column", "bucket").agg(F.sum("n").alias("n"))
    starts = sums.select("column", "bucket", (F.sum("n").over(column.orderBy("bucket")) - F.col("n")).alias("start"), F.sum("n").over(column).alias("total"))
    upto = F.sum("n").over(Window.partitionBy("column", "bucket").orderBy("value"))
    ranked = dealt.withColumn("upto", upto).join(F.broadcast(starts), ["column", "bucket"]).withColumn("end", F.col("start") + F.col("upto"))

    def quartile(q: float) -> Column:
        at = (F.col("total") - 1) * q
        value = lambda rank: F.max(F.when((rank < F.col("end")) & (rank >= F.col("end") - F.col("n")), F.col("value")))
        low, high, rest = value(F.floor(at)), value(F.ceil(at)), F.max(at - F.floor(at))
        return F.when(rest == 0, low).otherwise(low * (1 - rest) + high * rest).alias(f"q{q * 100:.0f}")

    return ranked.groupBy("column").agg(*map(quartile, (0.25, 0.5, 0.75)))


def describe_numeric(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Count, mean, deviation, least, quartiles and most of each numeric column; approximate: quartiles by a sketch, in the same pass."""
    names = [c for c, t in df.dtypes if t in NUMERIC]
    sketch = lambda c: [F.percentile_approx(c, q, 10_000).cast("double").alias(f"q{q * 100:.0f}") for q in (0.25, 0.5, 0.75)] if approximate else []
    one = df.agg(*[
        F.struct(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).cast("double").alias("min"), *sketch(c), F.max(c).cast("double").alias("max")).alias(c)
        for c in names
    ])
    out = one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in names]))).select("column", "s.*")
    if not approximate:
        out = out.join(F.broadcast(quartiles(df, names)), "column", "left")
    return out.select("column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def describe_text(df: DataFrame) -> DataFrame:
    """Count, number of values, most frequent value (the smallest among equals) and its count of each text column."""
    names = [c for c, t in df.dtypes if t == "string"]
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in names]))).filter("value is not null")
    counts = cells.groupBy("column", "value").count()
    # The smallest value among the most frequent: two rounds keep the state of a group at one row.
    top = counts.groupBy("column").agg(F.sum("count").alias("count"), F.count("*").alias("unique"), F.max("count").alias("freq"))
    first = counts.join(top.select("column", "freq"), "column").filter("count = freq").groupBy("column").agg(F.min("value").alias("top"))
    return top.join(first, "column").select("column", "count", "unique", "top", "freq")


def count_distinct(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    return df.agg((F.approx_count_distinct(column) if approximate else F.countDistinct(column)).alias("n_distinct"))


def top_values(df: DataFrame, column: str, n: int = 5) -> DataFrame:
    return df.groupBy(column).count().orderBy(F.desc("count"), column).limit(n)


def head(df: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    return df.orderBy(*order).limit(n)


def heavy_values(df: DataFrame, column: str, n: int = 5, width: int = 1 << 16) -> DataFrame:
    """The rows of ``top_values``, counting few values where some are far more frequent than most.

    Rows are counted by two hashes of the value first, ``2 * width`` counts whatever the number of values.  A value is at most as
    frequent as either of its buckets, and the exact counts of the values in the heaviest buckets give n values that are at least
    so frequent; so only values whose buckets both reach the least of these are counted and shuffled.  None can be missed: where
    buckets tell nothing (many values, all about as frequent) all reach it, and this is ``top_values`` with two more passes.
    """
    spark = df.sparkSession
    bucket = lambda k: F.pmod(F.xxhash64(F.col(column), F.lit(k)), F.lit(width)).cast("int")
    cells = df.select(F.inline(F.array(*[F.struct(F.lit(k).alias("k"), bucket(k).alias("bucket")) for k in (0, 1)])))
    totals = cells.groupBy("k", "bucket").agg(F.count("*").alias("n")).collect()  # at most 2 * width
    heaviest = sorted((r for r in totals if r.k == 0), key=lambda r: (-r.n, r.bucket))[: 4 * n]
    some = df.filter(bucket(0).isin([r.bucket for r in heaviest]))
    sure = [r["count"] for r in top_values(some, column, n).collect()]
    if len(sure) < n:
        return top_values(df, column, n)
    out = df
    for k in (0, 1):
        fine = [(r.bucket,) for r in totals if r.k == k and r.n >= sure[-1]]
        out = out.join(F.broadcast(spark.createDataFrame(fine, "__bucket int")), bucket(k) == F.col("__bucket"), "left_semi")  # at most width
    return top_values(out, column, n)


def sketches(df: DataFrame, by: list[str], numbers: list[str], keys: list[str]) -> DataFrame:
    """Per group of ``by``: a sketch of the quantiles of each number (``q_...``) and of the distinct values of each key (``d_...``).

    A table of these is kept up by days or loads: sketches are small, and those of any groups merge to that of all their rows.
    """
    quantiles = [F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(800)).alias(f"q_{c}") for c in numbers]
    distinct = [F.hll_sketch_agg(F.col(c), F.lit(14)).alias(f"d_{c}") for c in keys]
    return df.groupBy(*by).agg(*quantiles, *distinct)


def merged(rows: DataFrame, by: list[str] = ()) -> DataFrame:
    """The sketches of larger groups, or of everything, from those of smaller ones."""
    quantiles = [F.kll_merge_agg_double(F.col(c), F.lit(800)).alias(c) for c in rows.columns if c.startswith("q_")]
    distinct = [F.hll_union_agg(c).alias(c) for c in rows.columns if c.startswith("d_")]
    return rows.groupBy(*by).agg(*quantiles, *distinct)


def sketched(rows: DataFrame) -> DataFrame:
    """What sketches say: ``c_q25, c_q50, c_q75`` of a number c, ``c_distinct`` of a key."""
    quantile = lambda c: [F.kll_sketch_get_quantile_double(F.col(c), F.lit(q)).alias(f"{c[2:]}_q{q * 100:.0f}") for q in (0.25, 0.5, 0.75)]
    plain = [c for c in rows.columns if c[:2] not in ("q_", "d_")]
    return rows.select(*plain, *[x for c in rows.columns if c.startswith("q_") for x in quantile(c)], *[F.hll_sketch_estimate(c).alias(f"{c[2:]}_distinct") for c in rows.columns if c.startswith("d_")])
