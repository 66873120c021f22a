"""Cleaning visits and requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES = ["route_encoded", "stop_sequence", "day_of_week", "hour_of_day", "holiday_flag", "stop_lat", "stop_lon"]


def whole(value: Column) -> Column:
    """A whole number written in any way (``12``, ``12.0``); null for all else."""
    d = value.try_cast("double")
    return F.when(d == F.floor(d), d.try_cast("bigint"))


def number(value: Column) -> Column:
    """A double; NaN counts as null."""
    return F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))


NEEDED = {"stop_id": "no stop", "stop_sequence": "no sequence", "stop_lat": "no latitude", "stop_lon": "no longitude"}


def judged_visits(raw: DataFrame) -> DataFrame:
    """Typed visits with ``reason``: why one can't be used (what it lacks, the first of ``NEEDED``), or null.  Null route texts and times become ``nan``.

    One pass serves both sides: keep this table and filter it twice.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    rows = raw.select(
        F.col("trip_id").cast("string"), text("route_id").alias("route_id"), text("route_short_name").alias("route_short_name"),
        whole(F.col("stop_id")).alias("stop_id"), "stop_name", number(F.col("stop_lat")).alias("stop_lat"), number(F.col("stop_lon")).alias("stop_lon"),
        whole(F.col("stop_sequence")).alias("stop_sequence"), text("scheduled_arrival_time").alias("scheduled_arrival_time"),
        F.col("day_of_week").cast("int"), F.col("hour_of_day").cast("int"), F.col("holiday_flag").cast("int"), number(F.col("delay_minutes")).alias("delay_minutes"),
        *[c for c in ("service_day", "seen_at", "visit_id") if c in raw.columns],
    )
    return rows.withColumn("reason", F.coalesce(*[F.when(F.col(c).isNull(), why) for c, why in NEEDED.items()]))


def clean_stop_visits(raw: DataFrame) -> DataFrame:
    """Typed visits without those that lack a stop, a sequence or a place."""
    return judged_visits(raw).filter("reason is null").drop("reason")


def rejected_visits(raw: DataFrame) -> DataFrame:
    """The visits that ``clean_stop_visits`` leaves out, with the reason."""
    return judged_visits(raw).filter("reason is not null")


def index_input(raw: DataFrame) -> DataFrame:
    """Route, stop and sequence (a fraction is cut off) where all three are there."""
    rows = raw.select("route_id", "stop_id", F.col("stop_sequence").try_cast("double").try_cast("bigint").alias("stop_sequence"))
    return rows.select(F.col("route_id").cast("string"), F.col("stop_id").cast("string"), "stop_sequence").na.drop()


def route_keys(visits: DataFrame) -> DataFrame:
    """Each visit under its short name and under its route id (once if they are the same), as ``route_key``."""
    return visits.withColumn("route_key", F.explode(F.array_distinct(F.array("route_short_name", "route_id"))))


def filter_route(visits: DataFrame, key: str) -> DataFrame:
    """Visits whose short name or route id is the trimmed key."""
    key = key.strip()
    return visits.filter((F.col("route_short_name") == key) | (F.col("route_id") == key))


def filter_by_ids(df: DataFrame, ids: DataFrame, key: str = "trip_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def validate_requests(requests: DataFrame) -> DataFrame:
    """Add ``status``: ``invalid_request`` for a missing route, a flag other than 0 and 1, or half a coordinate; else ``ok``."""
    half = lambda a, b: F.col(a).isNull() != F.col(b).isNull()
    flag = F.coalesce(F.col("holiday_flag"), F.lit(0))
    bad = F.col("route_short_name").isNull() | ~flag.isin(0, 1) | half("from_lat", "from_lon") | half("to_lat", "to_lon")
    return requests.withColumn("status", F.when(bad, "invalid_request").otherwise("ok"))


INTEGER_BOUNDS = [("tinyint", 2**7), ("smallint", 2**15), ("int", 2**31)]
FLOAT_MAX = 3.4028234663852886e38


def narrowest(low: Column, high: Column, integer: bool) -> Column:
    """The narrowest type whose limits lie outside [low, high]; a column that reaches a limit isn't narrowed to it."""
    if not integer:
        return F.when((low > -FLOAT_MAX) & (high < FLOAT_MAX), "float").otherwise("double")
    out = F.lit("bigint")
    for name, limit in reversed(INTEGER_BOUNDS):
        out = F.when((low > -limit) & (high < limit - 1), name).otherwise(out)
    return out


def narrow_plan(df: DataFrame) -> DataFrame:
    """``column, low, high, type`` of each numeric column, from one pass."""
    kinds = {c: t not in ("float", "double") for c, t in df.dtypes if t in ("tinyint", "smallint", "int", "bigint", "float", "double")}
    one = df.agg(*[F.struct(F.min(c).cast("double").alias("low"), F.max(c).cast("double").alias("high")).alias(c) for c in kinds])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["low"].alias("low"), F.col(c)["high"].alias("high"), narrowest(F.col(c)["low"], F.col(c)["high"], i).alias("type")) for c, i in kinds.items()])
    return one.select(F.inline(rows))


def narrow_types(df: DataFrame) -> DataFrame:
    plan = {r.column: r.type for r in narrow_plan(df).collect() if r.low is not None}
    return df.select(*[F.col(c).cast(plan[c]).alias(c) if c in plan else F.col(c) for c in df.columns])
