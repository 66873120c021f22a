"""Stops of routes: catalogue, order, lists and indexes, nearest stops, segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.functions.geo import first_nonzero, haversine_km


def first_by(value: str | Column, *order: str) -> Column:
    """The first value that isn't null in an order (the smallest among equals): an aggregate."""
    v = F.col(value) if isinstance(value, str) else value
    return F.min_by(v, F.when(v.isNotNull(), F.struct(*order, v)))


def order_stops(visits: DataFrame, key: str = "route_key") -> DataFrame:
    """``visit_no`` from 1 within a key, by sequence, time text, stop and trip.

    Visits are numbered within each (key, sequence, time, stop) and shifted by the number of visits before it, which comes
    from a table of these, so no task gets all visits of a route.
    """
    place = ["stop_sequence", "scheduled_arrival_time", "stop_id"]
    counts = visits.groupBy(key, *place).agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy(*place).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"__{c}") for c in (key, *place)], F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(key, *place).orderBy("trip_id"))
    same = F.lit(True)
    for c in (key, *place):
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = visits.withColumn("__at", inside).join(starts, same)
    return out.withColumn("visit_no", (F.col("__start") + F.col("__at")).cast("int")).drop("__at", "__start", *[f"__{c}" for c in (key, *place)])


def stop_catalogue(keyed: DataFrame) -> DataFrame:
    """One row per (route_key, stop, sequence): the first value of each column by time text.

    This is small and all that route requests need of the visits, so they never meet the visits themselves.
    """
    first = lambda c: first_by(c, "scheduled_arrival_time").alias(c)
    return keyed.groupBy("route_key", "stop_id", "stop_sequence").agg(first("stop_name"), first("stop_lat"), first("stop_lon"), F.min("scheduled_arrival_time").alias("scheduled_arrival_time"), F.count("*").alias("n_visits"))


def collapse_stops(rows: DataFrame, keys: list[str], keep: list[str] = ()) -> DataFrame:
    """One row per stop, each column its first value by sequence; ``pos`` from 1 by sequence and stop.

    rows: of ``stop_catalogue``; keep: columns that are the same throughout a key.
    """
    first = lambda c: first_by(c, "stop_sequence", "scheduled_arrival_time").alias(c)
    one = rows.groupBy(*keys, "stop_id").agg(first("stop_name"), first("stop_lat"), first("stop_lon"), first("scheduled_arrival_time"), F.min("stop_sequence").alias("seq"), *[F.first(c).alias(c) for c in keep])
    return one.withColumnRenamed("seq", "stop_sequence").withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("stop_sequence", "stop_id")))


def first_sequence(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy("route_key", "stop_id").agg(F.min("stop_sequence").alias("first_sequence"))


def route_stop_lists(rows: DataFrame, every_visit: bool = False) -> DataFrame:
    """``route_id, stops``: ids as texts in order of sequence.

    rows: of ``index_input``.  Each (stop, sequence) is listed once; every_visit: once per visit, with as many entries
    as there are visits in one array per route.
    """
    rows = rows if every_visit else rows.distinct()
    return rows.groupBy("route_id").agg(F.sort_array(F.collect_list(F.struct("stop_sequence", "stop_id"))).alias("s")).select("route_id", F.transform("s", lambda x: x["stop_id"]).alias("stops"))


def route_stop_index(catalogue_by_name: DataFrame) -> DataFrame:
    """The flat index by short name: ``route_short_name, pos`` (from 0) and the stop's columns, one row per stop."""
    rows = collapse_stops(catalogue_by_name, ["route_key"])
    return rows.select(F.col("route_key").alias("route_short_name"), (F.col("pos") - 1).alias("pos"), "stop_id", "stop_name", "stop_sequence", F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"), "scheduled_arrival_time")


def nested_index(index: DataFrame) -> DataFrame:
    """``route_short_name, stops``: the index as one array of structs per route."""
    columns = [c for c in index.columns if c != "route_short_name"]
    return index.groupBy("route_short_name").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("stops"))


def nearest_stop(points: DataFrame, index: DataFrame, key: str, lat: str, lon: str) -> DataFrame:
    """``key, stop_id, distance_km``: the nearest stop on the point's route; the earlier one among equals.

    points: ``key, route_short_name, lat, lon``.  Candidates are the stops of one route, so no spatial index is needed.
    """
    stops = index.select("route_short_name", "pos", "stop_id", first_nonzero(F.col("lat")).alias("s_lat"), first_nonzero(F.col("lon")).alias("s_lon"))
    d = F.round(haversine_km(F.col(lat), F.col(lon), F.col("s_lat"), F.col("s_lon")), 9)
    pairs = points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).join(stops, "route_short_name").withColumn("d", d)
    return pairs.groupBy(key).agg(F.min_by("stop_id", F.struct("d", "pos")).alias("stop_id"), F.min("d").alias("distance_km"))


#: Places of a route in one bin of a range join.
BIN = 8


def rows_between(asked: DataFrame, rows: DataFrame, key: str, at: str, low: Column, high: Column, width: int = BIN) -> DataFrame:
    """The range join of ``asked`` with the ``rows`` of the same key whose place ``at`` lies between low and high.

    Both sides are dealt to bins of places, an asked row to all that it covers, so it meets the rows of its range and of the bins
    at its ends, however many its key has; and a key that many ask for is dealt by its bins.  Places are whole numbers without
    large gaps.
    """
    binned = asked.withColumn("__bin", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))))
    return binned.join(rows.withColumn("__bin", F.floor(F.col(at) / width)), [key, "__bin"]).filter(F.col(at).between(low, high)).drop("__bin")


def slice_by_stop_ids(requests: DataFrame, catalogue: DataFrame, width: int = BIN) -> DataFrame:
    """Catalogue rows of each request's segment.

    Bounds are the endpoints' first sequences, swapped if reversed; one bound leaves the other side open; an endpoint
    that isn't on the route, or none, gives the whole route.  requests: ``request_id, route_key, from_stop_id, to_stop_id``.
    """
    # Sequences are numbered without gaps within a route, which has as many rows here as it has stops and sequences.
    placed = catalogue.withColumn("__place", F.dense_rank().over(Window.partitionBy("route_key").orderBy("stop_sequence")))
    first = placed.groupBy("route_key", "stop_id").agg(F.min("__place").alias("place"))
    last = placed.groupBy("route_key").agg(F.max("__place").alias("__last"))
    end = lambda side: first.select("route_key", F.col("stop_id").alias(f"{side}_stop_id"), F.col("place").alias(f"__{side}"))
    out = requests.join(last, "route_key").join(end("from"), ["route_key", "from_stop_id"], "left").join(end("to"), ["route_key", "to_stop_id"], "left")
    a, b = F.col("__from"), F.col("__to")
    lost = (F.col("from_stop_id").isNotNull() & a.isNull()) | (F.col("to_stop_id").isNotNull() & b.isNull())
    both = a.isNotNull() & b.isNotNull()
    low = F.when(lost, None).when(both, F.least(a, b)).otherwise(a)
    high = F.when(lost, None).when(both, F.greatest(a, b)).otherwise(b)
    bounded = out.withColumns({"__low": F.coalesce(low, F.lit(1)), "__high": F.coalesce(high, "__last")}).drop("__from", "__to", "__last")
    return rows_between(bounded, placed, "route_key", "__place", F.col("__low"), F.col("__high"), width).drop("__low", "__high", "__place")


def resolve_endpoints(requests: DataFrame, index: DataFrame, keep: list[str] = (), hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``request_id, route_short_name, from_id, to_id, status``: the ids if both are given (0 counts as absent), else the nearest stops to both coordinates.

    Nearest stops are found once for each different point of a route.  keep: further columns of the requests.  hold: what becomes of
    tables that follow the routes or points and not the requests, such as writing them.
    """
    known = hold(index.select("route_short_name").distinct().withColumn("known", F.lit(True)))
    given = F.nullif(F.col("from_stop_id"), F.lit(0)).isNotNull() & F.nullif(F.col("to_stop_id"), F.lit(0)).isNotNull()
    rows = requests.join(known, "route_short_name", "left")
    for side in ("from", "to"):
        point = ["route_short_name", f"{side}_lat", f"{side}_lon"]
        points = requests.select(*point).distinct().withColumn("__point", F.struct(*point))
        near = nearest_stop(points, index, "__point", *point[1:]).select("__point.*", F.col("stop_id").alias(f"near_{side}"))
        rows = rows.join(hold(near), point, "left")
    ids = {f"{s}_id": F.when(given, F.col(f"{s}_stop_id")).otherwise(F.col(f"near_{s}")) for s in ("from", "to")}
    status = F.when(F.col("known").isNull(), "route_not_found").when(F.col("from_id").isNull() | F.col("to_id").isNull(), "endpoints_missing").otherwise("ok")
    return rows.withColumns(ids).withColumn("status", status).select("request_id", "route_short_name", "from_id", "to_id", "status", *keep)


def slice_by_position(resolved: DataFrame, index: DataFrame, width: int = BIN) -> tuple[DataFrame, DataFrame]:
    """(segment rows, statuses).  Positions run from each end's first place; reversed travel reverses the order (``seg`` from 0)."""
    place = index.groupBy("route_short_name", "stop_id").agg(F.min("pos").alias("at"))
    end = lambda side: place.select("route_short_name", F.col("stop_id").alias(f"{side}_id"), F.col("at").alias(f"{side}_at"))
    out = resolved.join(end("from"), ["route_short_name", "from_id"], "left").join(end("to"), ["route_short_name", "to_id"], "left")
    i, j = F.col("from_at"), F.col("to_at")
    status = F.when(F.col("status") != "ok", F.col("status")).when(i.isNull() | j.isNull(), "stop_not_on_route").otherwise("ok")
    out = out.withColumn("status", status)
    rows = rows_between(out.filter("status = 'ok'"), index, "route_short_name", "pos", F.least(i, j), F.greatest(i, j), width)
    seg = F.when(i <= j, F.col("pos") - i).otherwise(i - F.col("pos"))
    return rows.withColumn("seg", seg).drop("from_at", "to_at", "status"), out.select("request_id", "status")
