"""Arrival estimates for a table of route requests."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.functions.geo import first_nonzero
from headway.functions.text import clamp_delay
from headway.functions.times import at_time, clock, day_of_week, iso, iso_parts, plus_minutes, seconds_of
from headway.operators import baseline, clean, stops
from headway.sources.shared import written


def keyed_requests(requests: DataFrame) -> DataFrame:
    """Valid requests with the trimmed ``route_key`` and the weekday and hour of their time."""
    rows = clean.validate_requests(requests).filter("status = 'ok'")
    return rows.withColumns({"route_key": F.trim("route_short_name"), "day_of_week": day_of_week(F.col("request_ts")), "hour_of_day": F.hour("request_ts")})


def request_status(requests: DataFrame, visits: DataFrame) -> DataFrame:
    """``request_id, status``: ``ok``, ``invalid_request`` or ``route_not_found``."""
    keys = clean.route_keys(visits).select("route_key").distinct().withColumn("known", F.lit(True))
    rows = clean.validate_requests(requests).withColumn("route_key", F.trim("route_short_name")).join(keys, "route_key", "left")
    return rows.select("request_id", F.when((F.col("status") == "ok") & F.col("known").isNull(), "route_not_found").otherwise(F.col("status")).alias("status"))


@dataclass(frozen=True)
class Base:
    """What answers need of the visits: delay sums per slot, the catalogue of stops, and each key's representative route."""

    sums: DataFrame
    catalogue: DataFrame
    representative: DataFrame


def base_of(visits: DataFrame | Base) -> Base:
    if isinstance(visits, Base):
        return visits
    sums = baseline.partial_sums(visits)
    return Base(sums, stops.stop_catalogue(clean.route_keys(visits)), baseline.representative_from_sums(sums))


def save_base(base: Base, path: str) -> None:
    for name, rows in vars(base).items():
        rows.write.mode("overwrite").parquet(f"{path}/{name}")


def load_base(spark: SparkSession, path: str) -> Base:
    return Base(*[spark.read.parquet(f"{path}/{name}") for name in ("sums", "catalogue", "representative")])


SLICE = ["route_key", "from_stop_id", "to_stop_id"]
SLOT = ["day_of_week", "hour_of_day"]


def _same(keys: list[str], side: str) -> Column:
    """Equality of keys that may be null with the columns of the other side, which have ``side`` in front."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).eqNullSafe(F.col(side + k))
    return out


def slices(requests: DataFrame, base: Base) -> DataFrame:
    """The collapsed stops of each different (route key, endpoints); ``pos`` from 1.  Work follows routes and stops, not requests."""
    asked = requests.select(*SLICE).distinct().withColumn("request_id", F.xxhash64(*SLICE))
    return stops.collapse_stops(stops.slice_by_stop_ids(asked, base.catalogue), SLICE)


def stop_delays(requests: DataFrame, base: Base) -> DataFrame:
    """``mean_delay`` and ``delay_level`` of each route's stops in each weekday and hour that a request of that route has."""
    when = requests.select("route_key", *SLOT).distinct()
    rows = base.catalogue.select("route_key", "stop_id").distinct().join(when, "route_key").join(base.representative, "route_key")
    return baseline.lookup_delay(rows, base.sums)


def cells(requests: DataFrame, base: Base) -> DataFrame:
    """One row per different (slice, weekday, hour) and stop, with the stop's delay.  requests: of ``keyed_requests``."""
    when = requests.select(*SLICE, *SLOT).distinct()
    there = slices(requests, base).withColumnsRenamed({k: f"s_{k}" for k in SLICE})
    return when.join(there, _same(SLICE, "s_")).drop(*[f"s_{k}" for k in SLICE]).join(stop_delays(requests, base), ["route_key", "stop_id", *SLOT])


def _of_requests(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """Rows of slices and slots, for every request that has them."""
    keys = SLICE + SLOT
    other = rows.withColumnsRenamed({k: f"c_{k}" for k in keys})
    return keyed.join(other, _same(keys, "c_")).drop(*[f"c_{k}" for k in keys])


def with_delays(requests: DataFrame, visits: DataFrame | Base) -> DataFrame:
    """One row per request and stop of its segment, with the request's context, representative route, ``mean_delay`` and ``delay_level``."""
    keyed = keyed_requests(requests).select("request_id", "request_ts", *SLICE, *SLOT)
    return _of_requests(cells(keyed, base_of(visits)), keyed)


def timeline(requests: DataFrame, visits: DataFrame | Base) -> DataFrame:
    """A row per request and stop: scheduled time, delay (at least 0, two places) and arrival as ISO text."""
    seconds = F.coalesce(seconds_of(clock(F.col("scheduled_arrival_time"))), F.lit(0))
    rows = with_delays(requests, visits).withColumn("predicted_delay_minutes", clamp_delay(F.col("mean_delay")))
    eta = plus_minutes(at_time(F.col("request_ts"), seconds), F.col("predicted_delay_minutes"))
    return rows.withColumn("predicted_eta_iso", iso(eta)).withColumnsRenamed({"stop_lat": "lat", "stop_lon": "lon"})


TIMELINE = ["request_id", "pos", "stop_id", "stop_name", "stop_sequence", "lat", "lon", "scheduled_arrival_time", "predicted_delay_minutes", "predicted_eta_iso"]


def summary(requests: DataFrame, visits: DataFrame | Base) -> DataFrame:
    """One row per request: summed up once for each different slice, weekday and hour, then joined to the requests."""
    keyed = keyed_requests(requests).select("request_id", *SLICE, *SLOT)
    rows = cells(keyed, base_of(visits)).withColumn("delay", clamp_delay(F.col("mean_delay")))
    short = rows.groupBy(*SLICE, *SLOT).agg(
        F.count("*").alias("n_stops"), F.min_by("stop_id", "pos").alias("start_stop_id"), F.max_by("stop_id", "pos").alias("end_stop_id"),
        F.bround(F.sum("delay"), 2).alias("total_predicted_delay_minutes"), F.first("repr_route_id").alias("repr_route_id"), F.first("repr_route_short_name").alias("repr_route_short_name"),
    )
    out = _of_requests(short, keyed)
    names = {"route_key": "route_key_used", "day_of_week": "context_day_of_week", "hour_of_day": "context_hour_of_day"}
    return out.drop("from_stop_id", "to_stop_id").withColumnsRenamed(names)


def responses(requests: DataFrame, visits: DataFrame | Base) -> DataFrame:
    """``request_id, waypoints, stops, summary``: the nested answer.  Arrays hold one route's stops at most.

    The stops of a slice, weekday and hour are nested once; a request only adds its arrival times.
    """
    base = base_of(visits)
    keyed = keyed_requests(requests).select("request_id", "request_ts", *SLICE, *SLOT)
    rows = cells(keyed, base).withColumn("predicted_delay_minutes", clamp_delay(F.col("mean_delay"))).withColumnsRenamed({"stop_lat": "lat", "stop_lon": "lon"})
    fields = [c for c in TIMELINE if c not in ("request_id", "predicted_eta_iso")]
    seconds = F.coalesce(seconds_of(clock(F.col("scheduled_arrival_time"))), F.lit(0)).alias("seconds")
    nested = rows.groupBy(*SLICE, *SLOT).agg(F.sort_array(F.collect_list(F.struct(*fields, seconds))).alias("stops"))
    eta = lambda s: iso(plus_minutes(at_time(F.col("request_ts"), s["seconds"]), s["predicted_delay_minutes"])).alias("predicted_eta_iso")
    out = _of_requests(nested, keyed).withColumn("stops", F.transform("stops", lambda s: F.struct(*[s[c].alias(c) for c in fields], eta(s))))
    short = summary(requests, base)
    lines = F.transform("stops", lambda s: F.struct(s["lat"].alias("lat"), s["lon"].alias("lon"))).alias("waypoints")
    return out.select("request_id", lines, "stops").join(short.select("request_id", F.struct(*[c for c in short.columns if c != "request_id"]).alias("summary")), "request_id")


def waypoints(rows: DataFrame) -> DataFrame:
    """``request_id, line``: the segment's (lat, lon) in order."""
    line = F.sort_array(F.collect_list(F.struct("pos", "lat", "lon")))
    return rows.groupBy("request_id").agg(line.alias("line")).select("request_id", F.transform("line", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("line"))


def iso_requests(requests: DataFrame, as_of: Column, ts: str = "request_ts", refuse: bool = False) -> DataFrame:
    """Requests whose time is ISO text: ``request_ts`` is the clock as written, ``utc_offset`` what the text says of the zone.

    A request without a time is of ``as_of``; so is one whose time can't be read, the rule of the averages.  refuse: its time is
    null then, the rule of the model path, where it gets the status ``invalid_request``.
    """
    text = F.col(ts).cast("string")
    rows = requests.withColumn("__iso", iso_parts(text))
    missing = (F.coalesce(text, F.lit("")) == "") if refuse else F.col("__iso").isNull()
    at = F.when(missing, as_of.cast("timestamp_ntz")).otherwise(F.col("__iso.at"))
    return rows.withColumns({"request_ts": at, "utc_offset": F.coalesce("__iso.zone", F.lit(""))}).drop("__iso")


def model_features(requests: DataFrame) -> DataFrame:
    """Requests with what the model path needs of them: weekday, hour, holiday flag (0 where it is absent) and zone (if it has one)."""
    zone = F.col("utc_offset") if "utc_offset" in requests.columns else F.lit("")
    return requests.withColumns({"utc_offset": zone, "holiday_flag": F.coalesce("holiday_flag", F.lit(0)), "day_of_week": day_of_week(F.col("request_ts")), "hour_of_day": F.hour("request_ts")})


#: Rows that a table may have to be sent to all tasks.
FEW = 200_000


def held(table: DataFrame) -> DataFrame:
    """A table that follows routes and stops, written; sent to all tasks if it is as small as such tables are, so that requests stay where they lie."""
    table = written(table)
    return F.broadcast(table) if table.count() <= FEW else table


def model_due(request_ts: Column, scheduled: Column) -> Column:
    """When a stop is due on the model path: the loose clock rule, and the request's own time where a stop has none."""
    return F.coalesce(at_time(request_ts, seconds_of(clock(scheduled, strict=False))), request_ts)


def eta_from_model(requests: DataFrame, index: DataFrame, delays: PipelineModel) -> tuple[DataFrame, DataFrame]:
    """(timeline, statuses) by the model (``model.artefact``, or one loaded): raw delays, the order of travel, the request's own time where a stop has none.

    Arrival times keep the zone of the request's text (``utc_offset`` of ``iso_requests``).  Requests that aren't valid get a
    status and no rows; so do those whose time is null (``iso_requests`` with ``refuse``).
    """
    valid = clean.validate_requests(requests)
    checked = model_features(valid.withColumn("valid", F.when(F.col("request_ts").isNull(), "invalid_request").otherwise(F.col("status"))).drop("status"))
    index = held(index)
    context = ["request_ts", "utc_offset", "holiday_flag", *SLOT, "valid"]
    resolved = stops.resolve_endpoints(checked, index, context, held).withColumn("status", F.when(F.col("valid") != "ok", F.col("valid")).otherwise(F.col("status")))
    # Segments are cut out once for each different (route, endpoints), whose number takes the place of the request's here.
    ends = ["route_short_name", "from_id", "to_id"]
    asked = held(resolved.filter("status = 'ok'").select(*ends, "status").distinct().withColumn("request_id", F.monotonically_increasing_id()))
    segment, found = stops.slice_by_position(asked, index)
    segment = held(segment.drop(*ends).withColumnRenamed("request_id", "__segment"))
    found = held(asked.drop("status").join(found.withColumnRenamed("status", "found"), "request_id").withColumnRenamed("request_id", "__segment"))
    placed = resolved.join(found, ends, "left")
    features = placed.filter("found = 'ok' and status = 'ok' and request_id is not null").drop("status").join(segment, "__segment")
    scored = delays.transform(features.withColumns({"stop_lat": first_nonzero(F.col("lat")), "stop_lon": first_nonzero(F.col("lon"))}))
    at = plus_minutes(model_due(F.col("request_ts"), F.col("scheduled_arrival_time")), F.col("prediction"))
    rows = scored.select("request_id", "seg", "stop_id", "stop_name", "stop_sequence", F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"), "scheduled_arrival_time", F.col("prediction").alias("predicted_delay_minutes"), F.concat(iso(at), "utc_offset").alias("predicted_eta_iso"), "utc_offset")
    # A request without an id is known, but no row came of it.
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("request_id").isNull(), "empty_segment").otherwise(F.col("found"))
    return rows, placed.select("request_id", status.alias("status"))


def segment_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("request_id").agg(F.count("*").alias("segment_stop_count"), F.sum("predicted_delay_minutes").alias("total_predicted_delay_minutes"))


def model_responses(rows: DataFrame) -> DataFrame:
    """``request_id, waypoints, stops, summary``: the nested answer of the model path, stops in the order of travel."""
    fields = ["seg", "stop_id", "stop_name", "stop_sequence", "lat", "lon", "scheduled_arrival_time", "predicted_delay_minutes", "predicted_eta_iso"]
    nested = rows.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("stops"), F.count("*").alias("segment_stop_count"), F.sum("predicted_delay_minutes").alias("total_predicted_delay_minutes"))
    lines = F.transform("stops", lambda s: F.struct(s["lat"].alias("lat"), s["lon"].alias("lon"))).alias("waypoints")
    return nested.select("request_id", lines, "stops", F.struct("segment_stop_count", "total_predicted_delay_minutes").alias("summary"))
