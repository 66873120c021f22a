"""The registered queries on visits and requests; ``headway.oracles`` has their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headway.fixtures import raw_visits, requests, visits_by_day
from headway.functions import geo, text, times
from headway.operators import baseline, clean, model, profile, ranking, stops
from headway.plans import eta, training
from headway.sources import visits as files
from headway.sources.shared import CLEANUP, delete, move, scratch, settings, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_stop_visits(raw_visits(spark, sf_dir))


def by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat index of stops by short name."""
    return stops.route_stop_index(stops.stop_catalogue(visits(spark, sf_dir).withColumn("route_key", F.col("route_short_name"))))


def named_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests(spark, sf_dir).withColumn("route_short_name", text.route_text(F.col("route_short_name")))


def prepared(spark: SparkSession, sf_dir: str) -> eta.Base:
    """What answers need of the visits, written once, so that a plan with several uses doesn't read the visits again."""
    path = scratch(spark)
    base = eta.base_of(visits(spark, sf_dir))
    base.sums.write.parquet(f"{path}/sums")
    sums = spark.read.parquet(f"{path}/sums")
    base.catalogue.write.parquet(f"{path}/catalogue")
    baseline.representative_from_sums(sums).write.parquet(f"{path}/representative")
    return eta.load_base(spark, path)


@query
def clean_visits(spark, d):
    return visits(spark, d)


@query
def read_visits_csv(spark, d):
    path = scratch(spark)
    raw_visits(spark, d).write.option("header", True).csv(path)
    return clean.clean_stop_visits(files.read_stop_visits(spark, path))


@query
def visit_rejects(spark, d):
    """How many raw visits are kept, and how many are not for which reason, in one pass."""
    rows = clean.judged_visits(raw_visits(spark, d))
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n_visits"), F.countDistinct("route_id").alias("n_routes"))


@query
def rejected_visits(spark, d):
    return clean.rejected_visits(raw_visits(spark, d)).select("trip_id", "route_id", "stop_id", "stop_sequence", "stop_lat", "stop_lon", "reason")


@query
def index_input(spark, d):
    return clean.index_input(raw_visits(spark, d))


@query
def filter_route(spark, d):
    return clean.filter_route(visits(spark, d), " BUILDING ")


@query
def validate_requests(spark, d):
    return clean.validate_requests(requests(spark, d)).select("request_id", "status")


@query
def request_status(spark, d):
    return eta.request_status(requests(spark, d), visits(spark, d))


@query
def narrow_types(spark, d):
    return clean.narrow_plan(visits(spark, d))


@query
def profile_shape(spark, d):
    return profile.shape(visits(spark, d))


@query
def profile_info(spark, d):
    return profile.info(visits(spark, d)).select("column", "non_null")


@query
def profile_describe(spark, d):
    out = profile.describe_numeric(visits(spark, d))
    return out.select("column", "count", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query
def profile_text(spark, d):
    return profile.describe_text(visits(spark, d))


@query
def count_trips(spark, d):
    return profile.count_distinct(visits(spark, d), "trip_id")


@query
def top_trips(spark, d):
    return profile.top_values(visits(spark, d), "trip_id")


@query
def heavy_trips(spark, d):
    """The most frequent trips, found by counting buckets first."""
    return profile.heavy_values(visits(spark, d), "trip_id")


@query
def heavy_stops(spark, d):
    return profile.heavy_values(visits(spark, d), "scheduled_arrival_time", 20)


@query
def sketch_errors(spark, d):
    """Sketches by months, stored, and merged to one: are their quartiles within a hundredth of the exact ranks, and their counts of trips within three hundredths?"""
    path, rows = scratch(spark), clean.clean_stop_visits(visits_by_day(spark, d))
    numbers = ["stop_lat", "stop_lon", "delay_minutes", "stop_sequence"]
    for half in (0, 1):
        profile.sketches(rows.filter(F.pmod(F.month("service_day"), F.lit(2)) == half), ["service_day"], numbers, ["trip_id"]).write.mode("append").parquet(path)
    said = profile.sketched(profile.merged(spark.read.parquet(path)))
    n = lambda c: F.greatest(F.count(c), F.lit(1))
    near = []
    for c in numbers:
        for q in (25, 50, 75):
            upto, below = F.count_if(F.col(c) <= F.col(f"{c}_q{q}")), F.count_if(F.col(c) < F.col(f"{c}_q{q}"))
            near.append(((upto / n(c) >= q / 100 - 0.01) & (below / n(c) <= q / 100 + 0.01)).alias(f"{c}_q{q}"))
    trips = F.first("trip_id_distinct") / F.greatest(F.count_distinct("trip_id"), F.lit(1))
    one = rows.crossJoin(F.broadcast(said)).agg(*near, trips.between(0.97, 1.03).alias("trip_id"))  # one row of numbers
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("near")) for c in one.columns])))


@query
def head_visits(spark, d):
    return profile.head(visits(spark, d), ["trip_id", "stop_sequence", "stop_id", "scheduled_arrival_time", "delay_minutes"]).select("trip_id", "stop_sequence", "stop_id")


@query
def baseline_stop_slot(spark, d):
    return baseline.grain(baseline.partial_sums(visits(spark, d)), baseline.SLOT)


@query
def baseline_stop(spark, d):
    return baseline.grain(baseline.partial_sums(visits(spark, d)), baseline.STOP)


@query
def baseline_route(spark, d):
    return baseline.grain(baseline.partial_sums(visits(spark, d)), baseline.ROUTE)


@query
def baseline_overall(spark, d):
    return baseline.grain(baseline.partial_sums(visits(spark, d)), [])


@query
def baseline_all(spark, d):
    return baseline.baseline_all(visits(spark, d))


@query
def baseline_by_day(spark, d):
    """The baseline from a table kept up by days: two loads, the second of which writes some days of the first anew, and a third of days that were wrong at first."""
    path, rows = scratch(spark), clean.clean_stop_visits(visits_by_day(spark, d))
    kind = F.pmod(F.month("service_day"), F.lit(4))
    wrong = rows.filter(kind == 1).withColumn("delay_minutes", F.col("delay_minutes") + 100)
    for load in (rows.filter(kind < 1).unionByName(wrong), rows.filter(kind >= 2), rows.filter(kind.isin(1, 2))):
        baseline.write_days(load, path)
    return baseline.all_grains(baseline.sums_of_days(spark.read.parquet(path)))


@query
def representative_route(spark, d):
    return baseline.representative_route(clean.route_keys(visits(spark, d)))


@query
def regression_metrics(spark, d):
    v = visits(spark, d)
    out = baseline.regression_metrics(v.join(baseline.grain(baseline.partial_sums(v), baseline.STOP), baseline.STOP, "left"), "delay_minutes", "mean_delay")
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mae", "mse", "r2")])


@query
def order_stops(spark, d):
    rows = stops.order_stops(clean.route_keys(visits(spark, d)))
    return rows.select("route_key", "visit_no", "stop_sequence", "scheduled_arrival_time")


@query
def stop_catalogue(spark, d):
    return stops.stop_catalogue(clean.route_keys(visits(spark, d)))


@query
def first_sequence(spark, d):
    return stops.first_sequence(stops.stop_catalogue(clean.route_keys(visits(spark, d))))


@query
def collapse_stops(spark, d):
    return stops.collapse_stops(stops.stop_catalogue(clean.route_keys(visits(spark, d))), ["route_key"])


@query
def route_stop_lists(spark, d):
    out = stops.route_stop_lists(clean.index_input(raw_visits(spark, d)))
    return out.select("route_id", F.array_join("stops", ",").alias("stops"))


@query
def route_index_json(spark, d):
    path = scratch(spark)
    files.write_route_index(stops.route_stop_lists(clean.index_input(raw_visits(spark, d))), path)
    return files.read_route_index(spark, path).select("route_id", F.size("stops").alias("n_stops"), F.md5(F.array_join("stops", ",")).alias("digest"))


@query
def route_stop_index(spark, d):
    return by_name(spark, d)


@query
def nested_route_index(spark, d):
    out = stops.nested_index(by_name(spark, d))
    return out.select("route_short_name", F.array_join(F.transform("stops", lambda s: s["stop_id"].cast("string")), ",").alias("stop_ids"))


@query
def nearest_stop(spark, d):
    out = stops.nearest_stop(named_requests(spark, d), by_name(spark, d), "request_id", "from_lat", "from_lon")
    return out.select("request_id", "stop_id", F.round("distance_km", 6).alias("distance_km"))


@query
def slice_by_ids(spark, d):
    keyed = clean.route_keys(visits(spark, d))
    return stops.slice_by_stop_ids(eta.keyed_requests(requests(spark, d)), stops.stop_catalogue(keyed)).select("request_id", "route_key", "stop_id", "stop_sequence")


@query
def resolve_endpoints(spark, d):
    return stops.resolve_endpoints(named_requests(spark, d), by_name(spark, d))


@query
def slice_by_position(spark, d):
    index = by_name(spark, d)
    rows, _ = stops.slice_by_position(stops.resolve_endpoints(named_requests(spark, d), index), index)
    return rows.select("request_id", "seg", "stop_id")


@query
def segment_status(spark, d):
    index = by_name(spark, d)
    return stops.slice_by_position(stops.resolve_endpoints(named_requests(spark, d), index), index)[1]


@query
def lookup_delay(spark, d):
    return eta.with_delays(requests(spark, d), prepared(spark, d)).select("request_id", "stop_id", F.round("mean_delay", 6).alias("mean_delay"))


@query
def delay_source_level(spark, d):
    return eta.with_delays(requests(spark, d), prepared(spark, d)).groupBy("delay_level").agg(F.count("*").alias("n_stops"))


@query
def eta_timeline(spark, d):
    return eta.timeline(requests(spark, d), prepared(spark, d)).select(*eta.TIMELINE)


@query
def eta_summary(spark, d):
    return eta.summary(requests(spark, d), prepared(spark, d))


@query
def eta_responses(spark, d):
    out = eta.responses(requests(spark, d), prepared(spark, d))
    return out.select("request_id", F.size("waypoints").alias("n_waypoints"), F.col("summary.start_stop_id"), F.array_join(F.transform("stops", lambda s: s["predicted_eta_iso"]), ",").alias("etas"))


@query
def punctuality_bands(spark, d):
    return baseline.punctuality_bands(eta.timeline(requests(spark, d), prepared(spark, d)))


@query
def waypoints(spark, d):
    out = eta.waypoints(eta.timeline(requests(spark, d), prepared(spark, d)))
    return out.select("request_id", F.posexplode("line").alias("pos", "p")).select("request_id", "pos", "p.lat", "p.lon")


@query
def routing_string(spark, d):
    lines = eta.waypoints(eta.timeline(requests(spark, d), prepared(spark, d)))
    return lines.select("request_id", geo.routing_string(F.col("line")).alias("route"))


@query
def swapped_lines(spark, d):
    lines = eta.waypoints(eta.timeline(requests(spark, d), prepared(spark, d))).select("request_id", geo.swap(F.col("line")).alias("line"))
    return lines.select("request_id", F.element_at("line", 1)["lon"].alias("first_lon"), F.element_at("line", -1)["lat"].alias("last_lat"))


@query
def haversine(spark, d):
    km = geo.haversine_km(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))
    return requests(spark, d).filter("from_lat is not null").select("request_id", F.round(km, 6).alias("km"))


@query
def parse_hms(spark, d):
    times_of = visits(spark, d).groupBy("scheduled_arrival_time").agg(F.count("*").alias("n"))
    seconds = F.coalesce(times.seconds_of(times.clock(F.col("scheduled_arrival_time"))), F.lit(0))
    return times_of.select("scheduled_arrival_time", "n", seconds.alias("seconds"))


@query
def time_context(spark, d):
    ts = F.col("request_ts")
    return requests(spark, d).select("request_id", times.day_of_week(ts).alias("day_of_week"), F.hour(ts).alias("hour_of_day"), F.date_format(ts, "yyyy-MM-dd").alias("day"), times.clock_text(ts).alias("clock"), times.is_peak_hour(F.hour(ts)).alias("peak"))


@query
def peak_hour(spark, d):
    return visits(spark, d).groupBy(times.is_peak_hour(F.col("hour_of_day")).alias("peak")).agg(F.count("*").alias("n_visits"), F.avg("delay_minutes").alias("mean_delay"))


@query
def stop_labels(spark, d):
    rows = visits(spark, d).select("stop_id", text.stop_label(F.col("stop_name"), F.col("stop_id")).alias("label"))
    return rows.groupBy("stop_id", "label").agg(F.count("*").alias("n"))


@query
def delay_texts(spark, d):
    return visits(spark, d).filter("delay_minutes is not null").select(text.delay_text(F.col("delay_minutes")).alias("delay"), text.route_text(F.col("route_short_name"), upper=True).alias("route")).groupBy("delay", "route").agg(F.count("*").alias("n"))


@query
def split_by_trip(spark, d):
    return ranking.split_by_key(visits(spark, d))


@query
def split_files(spark, d):
    path = scratch(spark)
    v = visits(spark, d)
    files.write_splits(v.join(ranking.split_by_key(v), "trip_id"), path)
    return spark.read.option("header", True).csv(path).groupBy("split").agg(F.count("*").alias("n_visits"), F.countDistinct("trip_id").alias("n_trips"))


@query
def filter_by_ids(spark, d):
    v = visits(spark, d)
    return clean.filter_by_ids(v, ranking.split_by_key(v).filter("split = 'test'")).groupBy("route_id").agg(F.count("*").alias("n_visits"), F.sum("delay_minutes").alias("total_delay"))


@query
def filter_bucketed(spark, d):
    """The same from visits in buckets of the trip, which aren't moved."""
    path = scratch(spark)
    v = files.save_bucketed(visits(spark, d), f"visits_{path.rsplit('/', 1)[-1]}", path, buckets=8)
    return clean.filter_by_ids(v, ranking.split_by_key(v).filter("split = 'test'")).groupBy("route_id").agg(F.count("*").alias("n_visits"), F.sum("delay_minutes").alias("total_delay"))


@query
def sample_n(spark, d):
    return ranking.sample_n(requests(spark, d), "request_id", 500).select("request_id", "route_short_name")


@query
def sample_many(spark, d):
    """A sample of a size that no single task should sort."""
    rows = visits(spark, d).select("trip_id").distinct()
    return ranking.sample_n(rows, "trip_id", 50_000 if rows.count() > 50_000 else 1_000)


@query
def split_fast(spark, d):
    """The split by the hash alone, of the visits as they lie."""
    rows = ranking.split_fast(visits(spark, d).select("trip_id"))
    return rows.groupBy("trip_id", "split").agg(F.count("*").alias("n_visits"))


@query
def encode_route(spark, d):
    v = visits(spark, d)
    return model.encode_route(v, model.encoder(v)).groupBy("route_short_name", "route_encoded").agg(F.count("*").alias("n_visits"))


@query
def encode_route_fallback(spark, d):
    return requests(spark, d).select("request_id", model.encode_route_fallback(F.col("route_short_name")).alias("route_encoded"))


@query
def assemble_features(spark, d):
    v = visits(spark, d)
    rows = model.assemble_features(model.encode_route(v, model.encoder(v)))
    return rows.groupBy(*[c for c in clean.FEATURES if not c.startswith("stop_l")]).agg(F.count("*").alias("n"), F.min("stop_lat").alias("least_lat"), F.max("stop_lon").alias("most_lon"))


_TRAINED: dict[tuple, training.Trained] = {}


def _trained(spark, d) -> training.Trained:
    """Trained once for an application and a folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _TRAINED:
        _TRAINED[key] = training.train_delay_model(visits(spark, d))
    return _TRAINED[key]


@query
def model_metrics(spark, d):
    fitted = _trained(spark, d)
    path = scratch(spark)
    files.write_model_metadata(spark, path, fitted.kind, clean.FEATURES, fitted.codes, fitted.metrics)
    return spark.read.json(path)


@query
def feature_importance(spark, d):
    return model.feature_importance(spark, _trained(spark, d).best)


@query
def score_batch(spark, d):
    fitted, path = _trained(spark, d), scratch(spark)
    model.save_model(fitted.best, fitted.codes, path)
    return model.load_model(path).transform(visits(spark, d)).select("trip_id", "stop_id", "stop_sequence", "prediction", "status")


@query
def score_status(spark, d):
    """What of a scored batch isn't the model's number."""
    return score_batch(spark, d).groupBy("stop_id", "stop_sequence", "status").agg(F.count("*").alias("n_visits"), F.count("prediction").alias("n_predictions"))


def _from_model(spark, d, rows=None) -> tuple[DataFrame, DataFrame]:
    fitted = _trained(spark, d)
    return eta.eta_from_model(named_requests(spark, d) if rows is None else rows, by_name(spark, d), model.artefact(fitted.best, fitted.codes))


@query
def eta_from_model(spark, d):
    return _from_model(spark, d)[0]


@query
def eta_from_model_stops(spark, d):
    """The model path's stops in the order of travel, without the model's numbers."""
    return _from_model(spark, d)[0].select("request_id", "seg", "stop_id", "stop_name", "stop_sequence", "lat", "lon", "scheduled_arrival_time")


@query
def eta_from_model_status(spark, d):
    return _from_model(spark, d)[1]


@query
def segment_summary(spark, d):
    return eta.segment_summary(_from_model(spark, d)[0])


@query
def segment_counts(spark, d):
    return segment_summary(spark, d).select("request_id", "segment_stop_count")


@query
def model_responses(spark, d):
    """The nested answer of the model path; without the model's numbers."""
    out = eta.model_responses(_from_model(spark, d)[0])
    ids = F.array_join(F.transform("stops", lambda s: s["stop_id"].cast("string")), ",")
    return out.select("request_id", F.size("waypoints").cast("long").alias("n_waypoints"), ids.alias("stop_ids"), F.col("summary.segment_stop_count"))


def text_requests(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose time is ISO text: with zones of several kinds, without hyphens, by week, a date alone, with a fraction, and some that can't be read."""
    i, ts = F.col("request_id") % 12, F.col("request_ts")
    clock = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    week = F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.concat(F.lit("W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0")), (F.weekday(ts) + 1).cast("string"))
    forms = [F.concat(clock, F.lit("Z")), F.concat(clock, F.lit("+05:30")), F.lit("soon"), F.lit(None), F.concat(clock, F.lit("-0800")), clock, F.date_format(ts, "yyyyMMdd'T'HHmmss"), F.lit("2024-3-5"), week, F.date_format(ts, "yyyy-MM-dd"), F.concat(clock, F.lit(",5")), F.lit("")]
    text = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        text = F.when(i == k, form).otherwise(text)
    return requests(spark, d).withColumn("request_ts", text)


AS_OF = "2024-01-01 09:30:00"


@query
def parse_iso(spark, d):
    """Request times as text: the written clock, its weekday and hour, and the zone."""
    rows = eta.iso_requests(text_requests(spark, d), F.lit(AS_OF).cast("timestamp_ntz"))
    return rows.select("request_id", F.date_format("request_ts", "yyyy-MM-dd HH:mm:ss").alias("clock"), times.day_of_week(F.col("request_ts")).alias("day_of_week"), F.hour("request_ts").alias("hour_of_day"), "utc_offset")


@query
def eta_of_text_times(spark, d):
    """Estimates from averages for requests whose time is text."""
    rows = eta.iso_requests(text_requests(spark, d), F.lit(AS_OF).cast("timestamp_ntz"))
    return eta.timeline(rows, prepared(spark, d)).select("request_id", "pos", "stop_id", "predicted_eta_iso")


def _from_model_at_text_times(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = text_requests(spark, d).withColumn("route_short_name", text.route_text(F.col("route_short_name")))
    return _from_model(spark, d, eta.iso_requests(rows, F.lit(AS_OF).cast("timestamp_ntz"), refuse=True))


@query
def model_offsets(spark, d):
    """The zone that the model path's arrival times keep."""
    out = _from_model_at_text_times(spark, d)[0]
    return out.groupBy("request_id", "utc_offset").agg(F.count("*").alias("n_stops"), F.count_if(F.endswith("predicted_eta_iso", F.col("utc_offset"))).alias("n_with_zone"))


@query
def model_status_of_text_times(spark, d):
    """The model path refuses a time that it can't read."""
    return _from_model_at_text_times(spark, d)[1]


@query
def loose_clock(spark, d):
    """The model path's rule for clock times, on times with a fourth part too."""
    t = F.col("scheduled_arrival_time")
    four = F.when(F.col("stop_id") % 3 == 0, F.concat(t, F.lit(":7"))).when(F.col("stop_id") % 3 == 1, F.concat(t, F.lit(":x"))).otherwise(t)
    rows = visits(spark, d).select(four.alias("clock_text"))
    return rows.groupBy("clock_text").agg(F.count("*").alias("n")).select("clock_text", "n", times.seconds_of(times.clock(F.col("clock_text"), strict=False)).alias("seconds"))


@query
def coordinate_texts(spark, d):
    rows = by_name(spark, d)
    return rows.select("route_short_name", "stop_id", text.coordinates_text(F.col("lat"), F.col("lon")).alias("coordinates"))


@query
def eta_request_stream(spark, d):
    """The requests as a stream of files, answered batch by batch."""
    from headway.streaming.requests import answer, read_requests

    rows, out = requests(spark, d), scratch(spark)
    rows.repartition(2).write.parquet(f"{out}/in")
    answer(read_requests(spark, f"{out}/in", rows.schema), prepared(spark, d), f"{out}/out", f"{out}/state").awaitTermination()
    return spark.read.parquet(f"{out}/out").select(*eta.TIMELINE)


#: Visits in a file of the stream, about, and days in one at most; files are written for so many days at once.
FILE_VISITS, FILE_DAYS = 4_000_000, 730


def _streamed(spark: SparkSession, d: str, out: str) -> None:
    """Visits arrive in files of two years each, or less where there are many, and the stream goes on where it stopped when one has come.

    The last two days of a file come with the next one for a third of the visits, and a fifth of all come twice, half of these
    with the next file.  Files are written for two years at a time and go when the stream has read them, so neither the state nor what
    lies on disk grows with the number of years.
    """
    from headway.streaming.visits import keep_sums, read_visits

    rows, day = visits_by_day(spark, d), F.datediff("seen_at", F.lit("1992-01-01").cast("date"))
    ship = spark.read.parquet(f"{d}/lineitem.parquet").agg(F.count("*"), *[F.datediff(f("l_shipdate"), F.lit("1992-01-01").cast("date")) for f in (F.min, F.max)]).first()
    n, first_day, last_day = ship[0], ship[1] or 0, ship[2] or 0
    days = max(7, min(FILE_DAYS, FILE_VISITS * (last_day - first_day + 1) // max(1, n)))
    key = F.pmod(F.xxhash64("visit_id"), F.lit(30))
    own, late = F.floor(day / days), F.floor((day + 2) / days) > F.floor(day / days)
    first = own + F.when(late & (key % 3 == 0), 1).otherwise(0)
    again = own + F.when(late & (key % 2 == 0), 1).otherwise(F.when(late & (key % 3 == 0), 1).otherwise(0))
    arrivals = F.when(key % 5 == 0, F.array(first, again)).otherwise(F.array(first))
    at_once = max(1, FILE_DAYS // days)
    for start in range(first_day // days, (last_day + 2) // days + 1, at_once):
        ends = start * days - 2, (start + at_once) * days
        some = rows.filter((day >= ends[0]) & (day < ends[1])).withColumn("file", F.explode(arrivals)).filter(F.col("file").between(start, start + at_once - 1))
        with settings(spark, {CLEANUP: "true"}):
            some.write.partitionBy("file").parquet(f"{out}/all/{start}")
        for k in range(start, start + at_once):
            if move(spark, f"{out}/all/{start}/file={k}", f"{out}/in/{k}"):
                # All of a file in one batch: visits behind the watermark of a batch before would be too late.
                keep_sums(read_visits(spark, f"{out}/in/*", rows.schema, 1_000_000), f"{out}/sums", f"{out}/state", LATENESS, STATE_TASKS).awaitTermination()
                delete(spark, f"{out}/in/{k}")
        delete(spark, f"{out}/all/{start}")
    delete(spark, f"{out}/state")


STATE_TASKS = 12
LATENESS = "4 days"


@query
def streamed_sums(spark, d):
    """Delay sums per slot from a stream of visits that come late, twice and out of order."""
    from headway.streaming.visits import sums_at

    out = scratch(spark)
    _streamed(spark, d, out)
    return sums_at(spark, f"{out}/sums")


@query
def eta_from_streamed_visits(spark, d):
    """The request stream on the sums that the visit stream has kept up to date."""
    from headway.streaming.requests import answer, read_requests
    from headway.streaming.visits import sums_at

    out, rows = scratch(spark), requests(spark, d)
    _streamed(spark, d, out)
    rows.repartition(2).write.parquet(f"{out}/requests")
    stops.stop_catalogue(clean.route_keys(visits(spark, d))).write.parquet(f"{out}/catalogue")

    def base() -> eta.Base:
        sums = written(sums_at(spark, f"{out}/sums"))
        return eta.Base(sums, spark.read.parquet(f"{out}/catalogue"), baseline.representative_from_sums(sums))

    answer(read_requests(spark, f"{out}/requests", rows.schema), base, f"{out}/answers", f"{out}/answer_state").awaitTermination()
    return spark.read.parquet(f"{out}/answers").select(*eta.TIMELINE)
