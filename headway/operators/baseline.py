"""Mean delays at four grains, and what is looked up in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.text import band

SLOT = ["route_id", "route_short_name", "stop_id", "day_of_week", "hour_of_day"]
STOP, ROUTE = SLOT[:3], SLOT[:2]


def partial_sums(visits: DataFrame) -> DataFrame:
    """Sum and count of delays per slot: the one pass over the visits, from which every grain follows.  Also adds up over days."""
    return visits.groupBy(*SLOT).agg(F.sum("delay_minutes").alias("total"), F.count("delay_minutes").alias("n"), F.count("stop_id").alias("visits"))


def grain(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Mean delay by ``keys``, of groups with a delay; groups with a null key are left out."""
    rows = sums.na.drop(subset=keys) if keys else sums
    return rows.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0").select(*keys, (F.col("total") / F.col("n")).alias("mean_delay"))


#: Grains by what ``grouping_id`` says of the keys of ``SLOT``: a bit for each key that a grain lacks.
LEVELS = {0b00000: ("stop_slot", SLOT), 0b00011: ("stop", STOP), 0b00111: ("route", ROUTE), 0b11111: ("overall", [])}


def all_grains(sums: DataFrame) -> DataFrame:
    """All grains of ``partial_sums`` by grouping sets, so the sums are made and dealt once: ``level`` and the keys, null where a grain lacks them."""
    sets = [[F.col(c) for c in keys] for _, keys in LEVELS.values()]
    rows = sums.groupingSets(sets, *SLOT).agg(F.grouping_id().alias("id"), F.sum("total").alias("total"), F.sum("n").alias("n")).filter("n > 0")
    level, whole = F.lit(None).cast("string"), F.lit(False)
    for i, (name, keys) in LEVELS.items():
        level = F.when(F.col("id") == i, name).otherwise(level)
        fine = F.lit(True)
        for c in keys:  # a group whose own key is null is left out, as in ``grain``
            fine = fine & F.col(c).isNotNull()
        whole = whole | ((F.col("id") == i) & fine)
    return rows.filter(whole).select(level.alias("level"), *SLOT, (F.col("total") / F.col("n")).alias("mean_delay"))


def baseline_all(visits: DataFrame) -> DataFrame:
    """All grains in one table, from one pass over the visits."""
    return all_grains(partial_sums(visits))


def write_days(visits: DataFrame, path: str, day: str = "service_day") -> None:
    """Keep the table of delay sums up to date: each value of ``day`` in ``visits`` is a partition, written anew as a whole; all others stay.

    Sums add up over days, so a day that comes late or again costs a pass over that day's visits alone.
    """
    sums = visits.groupBy(day, *SLOT).agg(F.sum("delay_minutes").alias("total"), F.count("delay_minutes").alias("n"), F.count("stop_id").alias("visits"))
    # One file for a day, whose sums have at most as many rows as there are slots.
    sums.repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def sums_of_days(days: DataFrame) -> DataFrame:
    """``partial_sums`` of all visits from the table of ``write_days`` (or some of its days)."""
    return days.groupBy(*SLOT).agg(F.sum("total").alias("total"), F.sum("n").alias("n"), F.sum("visits").alias("visits"))


def representative_route(keyed: DataFrame) -> DataFrame:
    """The most frequent (route_id, route_short_name) of each route_key; the smallest pair among equals."""
    counts = keyed.groupBy("route_key", "route_id", "route_short_name").agg(F.count("stop_id").alias("n"))
    order = Window.partitionBy("route_key").orderBy(F.desc("n"), "route_id", "route_short_name")
    return counts.withColumn("rank", F.row_number().over(order)).filter("rank = 1").select("route_key", F.col("route_id").alias("repr_route_id"), F.col("route_short_name").alias("repr_route_short_name"))


def representative_from_sums(sums: DataFrame) -> DataFrame:
    """The same from ``partial_sums``: route keys are made of the few pairs of routes, not of the visits."""
    pairs = sums.groupBy(*ROUTE).agg(F.sum("visits").alias("n")).withColumn("route_key", F.explode(F.array_distinct(F.array("route_short_name", "route_id"))))
    order = Window.partitionBy("route_key").orderBy(F.desc("n"), "route_id", "route_short_name")
    return pairs.withColumn("rank", F.row_number().over(order)).filter("rank = 1").select("route_key", F.col("route_id").alias("repr_route_id"), F.col("route_short_name").alias("repr_route_short_name"))


def lookup_delay(stops: DataFrame, sums: DataFrame) -> DataFrame:
    """Add ``mean_delay`` and ``delay_level`` to rows with a representative route, a stop, a weekday and an hour.

    The stop's mean in that slot, else the stop's, else the route's, else that of all visits.
    """
    rename = {"route_id": "repr_route_id", "route_short_name": "repr_route_short_name"}
    level = lambda keys, name: grain(sums, keys).withColumnsRenamed({k: v for k, v in rename.items() if k in keys} | {"mean_delay": name})
    keys = lambda k: [rename.get(c, c) for c in k]
    out = stops.join(level(SLOT, "m1"), keys(SLOT), "left").join(level(STOP, "m2"), keys(STOP), "left").join(level(ROUTE, "m3"), keys(ROUTE), "left")
    overall = sums.agg((F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("m4")).scalar()
    name = F.when(F.col("m1").isNotNull(), "stop_slot").when(F.col("m2").isNotNull(), "stop").when(F.col("m3").isNotNull(), "route").otherwise("overall")
    return out.withColumns({"mean_delay": F.coalesce(F.col("m1"), F.col("m2"), F.col("m3"), overall), "delay_level": name}).drop("m1", "m2", "m3")


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """``n, mae, mse, r2`` over rows that have both."""
    rows = df.filter(F.col(label).isNotNull() & F.col(prediction).isNotNull())
    e: Column = F.col(label) - F.col(prediction)
    return rows.agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), (1 - F.sum(e * e) / F.nullif(F.count("*") * F.var_pop(label), F.lit(0.0))).alias("r2"))


def punctuality_bands(timeline: DataFrame, delay: str = "predicted_delay_minutes") -> DataFrame:
    return timeline.groupBy("route_key", band(F.col(delay)).alias("band")).agg(F.count("*").alias("n_stops"))
