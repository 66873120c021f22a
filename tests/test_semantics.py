"""The rules of the data model, each on rows made by hand."""

import datetime as dt
import random
import re
from types import SimpleNamespace

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from headway.functions import geo, text, times
from headway.operators import baseline, boosting, clean, model, profile, ranking, stops
from headway.plans import eta, training
from headway.sources import visits as files

NOW = dt.datetime(2024, 1, 1, 9, 30)


def visit(**over):
    row = {"trip_id": "t", "route_id": "1", "route_short_name": "A", "stop_id": "10", "stop_name": "x", "stop_lat": "1.0", "stop_lon": "2.0", "stop_sequence": "1",
           "scheduled_arrival_time": "08:00:00", "day_of_week": 0, "hour_of_day": 9, "holiday_flag": 0, "delay_minutes": 1.0}
    return row | over


@pytest.fixture
def visits(spark):
    return lambda *rows: clean.clean_stop_visits(spark.createDataFrame([visit(**r) for r in rows], files.STOP_VISITS))


@pytest.fixture
def requests(spark):
    def make(*rows):
        base = {"request_id": 1, "route_short_name": "A", "from_stop_id": None, "to_stop_id": None, "from_lat": None, "from_lon": None, "to_lat": None, "to_lon": None, "request_ts": NOW, "holiday_flag": 0}
        schema = "request_id long, route_short_name string, from_stop_id long, to_stop_id long, from_lat double, from_lon double, to_lat double, to_lon double, request_ts timestamp_ntz, holiday_flag int"
        return spark.createDataFrame([base | r for r in rows], schema)

    return make


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_null_route_is_the_text_nan_and_a_key(visits, requests):
    v = visits({"route_short_name": None})
    assert v.first().route_short_name == "nan"
    assert eta.timeline(requests({"route_short_name": "nan"}), v).count() == 1


@pytest.mark.parametrize(("raw", "want"), [("12.0", 12), ("12", 12), ("12.7", None), ("x", None), (None, None)])
def test_whole_numbers(spark, raw, want):
    assert value(spark, clean.whole(F.lit(raw).cast("string"))) == want


def test_index_cuts_fractions(spark):
    rows = spark.createDataFrame([visit(stop_sequence="2.7")], files.STOP_VISITS)
    assert clean.index_input(rows).first().stop_sequence == 2
    assert clean.clean_stop_visits(rows).count() == 0


def test_nan_delays_and_null_slots(visits):
    v = visits({"delay_minutes": float("nan")}, {"delay_minutes": 3.0}, {"delay_minutes": 5.0, "day_of_week": None})
    sums = baseline.partial_sums(v)
    assert [r.mean_delay for r in baseline.grain(sums, baseline.SLOT).collect()] == [3.0]
    assert baseline.grain(sums, baseline.STOP).first().mean_delay == 4.0


def test_representative_is_the_most_frequent_and_ties_go_to_the_smallest(visits):
    v = visits({"route_id": "2"}, {"route_id": "1"}, {"route_id": "3"}, {"route_id": "3"}, {"route_id": "9", "route_short_name": "B"}, {"route_id": "8", "route_short_name": "B"})
    got = {r.route_key: r.repr_route_id for r in baseline.representative_route(clean.route_keys(v)).collect()}
    assert got["A"] == "3"
    assert got["B"] == "8"


def test_key_equal_to_both_counts_once(visits):
    assert clean.route_keys(visits({"route_id": "A"})).count() == 1


LINE = [{"stop_id": str(10 * i), "stop_sequence": str(i)} for i in range(1, 6)]


@pytest.mark.parametrize(("a", "b", "want"), [(20, 40, [20, 30, 40]), (40, 20, [20, 30, 40]), (30, None, [30, 40, 50]), (None, 20, [10, 20]), (999, 20, [10, 20, 30, 40, 50]), (20, 999, [10, 20, 30, 40, 50]), (None, None, [10, 20, 30, 40, 50])])
def test_slice_by_ids(visits, requests, a, b, want):
    rows = eta.timeline(requests({"from_stop_id": a, "to_stop_id": b}), visits(*LINE)).orderBy("pos").collect()
    assert [r.stop_id for r in rows] == want


def test_first_value_of_each_column(visits, requests):
    v = visits({"stop_name": None, "scheduled_arrival_time": "07:00:00"}, {"stop_name": "late", "scheduled_arrival_time": "09:00:00"}, {"stop_name": "other", "stop_sequence": "2"})
    row = eta.timeline(requests({}), v).first()
    assert (row.stop_name, row.scheduled_arrival_time, row.stop_sequence) == ("late", "07:00:00", 1)


@pytest.mark.parametrize(("raw", "strict", "loose"), [("08:30:15", 30615, 30615), ("08:30", 30600, 30600), ("24:00:00", None, None), ("08:60", None, None), ("08:00:60", None, None), ("8", None, None), ("nan", None, None), ("01:02:03:04", None, 3723), ("01:02:03:x", None, None), (None, None, None)])
def test_clock(spark, raw, strict, loose):
    t = F.lit(raw).cast("string")
    assert value(spark, times.seconds_of(times.clock(t))) == strict
    assert value(spark, times.seconds_of(times.clock(t, strict=False))) == loose


@pytest.mark.parametrize(("raw", "want"), [("2024-05-06T07:08:09Z", dt.datetime(2024, 5, 6, 7, 8, 9)), ("2024-05-06T07:08:09+05:30", dt.datetime(2024, 5, 6, 7, 8, 9)), ("junk", NOW), (None, NOW)])
def test_iso_keeps_the_written_clock(spark, raw, want):
    assert value(spark, times.parse_iso(F.lit(raw).cast("string"), F.lit(NOW))) == want


ISO_FORMS = """2024-03-05 20240305 2024-3-5 24-03-05 2024-13-05 2024-02-30 0000-01-01 2024-W10 2024W10 2024-W10-3 2024W103 2024-W103 2024-W54 2024-W53-1 2020-W53-7 2024-W00 2024-W10-8 2024-W10-0
2024-03-05T08:09:10 2024-03-05_08:09 2024-03-05T08 20240305T080910 20240305T0809 2024-03-05T080910 20240305T08:09:10 2024-03-05T8:09 2024-03-05T08:9 2024-03-05T24:00:01 2024-03-05T08:60 2024-03-05T08:09:60
2024-03-05T08:09:10.5 2024-03-05T08:09:10,123456789 2024-03-05T08:09.5 2024-03-05T08,25 2024-03-05T0809.5 2024-03-05T08:09:10.x 2024-03-05T08:09:10. 2024-03-05T080910.25 2024-03-05T08:0910 2024-03-05T0809:10
2024-03-05T08:09:10Z 2024-03-05T08:09:10z 2024-03-05T08:09:10+05:30 2024-03-05T08:09:10-0530 2024-03-05T08+01 2024-03-05T08:09:10+05:30:15 2024-03-05T08:09:10-00:00 2024-03-05T08:09:10+24:00 2024-03-05T08:09:10+5:30
2024-03-05T08:09:10+05:30:15.5 2024-03-05T08:09:10ZZ 2024-03-05T08:09:10Z+01:00 2024-W10-3T08:09 2024W103T0809 2024-W10T08 2024W10T08 2024-W10-10:30 2024-03-05x08:09 soon 2024 2024-03 202403 2024-03-05T 1 +2024-03-05""".split()


def test_iso_forms_are_those_of_python(spark):
    def python(text):
        try:
            t = dt.datetime.fromisoformat(text)
        except ValueError:
            return None
        return t.replace(tzinfo=None), t.isoformat()[len(t.replace(tzinfo=None).isoformat()) :]

    forms = [*ISO_FORMS, "", "2024-03-05 08:09", "2024-03-05  08:09", "2024-03-05\n08:09", " 2024-03-05", "2024-03-05 ", "2024-03-05é08:09"]
    rows = spark.createDataFrame([(f,) for f in forms], "t string").select("t", times.iso_parts(F.col("t")).alias("x")).collect()
    assert {r.t: r.x and (r.x["at"], r.x.zone) for r in rows} == {f: python(f) for f in forms}


def test_clamp_and_round_to_even(spark):
    assert [value(spark, text.clamp_delay(F.lit(x))) for x in (-3.0, 0.125, 0.375, 2.37)] == [0.0, 0.12, 0.38, 2.37]


def test_total_adds_rounded_delays(visits, requests):
    v = visits({"delay_minutes": 0.125}, {"stop_id": "20", "stop_sequence": "2", "delay_minutes": 0.125})
    assert eta.summary(requests({}), v).first().total_predicted_delay_minutes == 0.24


def test_eta_text(visits, requests):
    row = eta.timeline(requests({}), visits({"delay_minutes": 2.37})).first()
    assert row.predicted_eta_iso == "2024-01-01T08:02:22.200000"
    assert eta.timeline(requests({}), visits({"delay_minutes": 2.0})).first().predicted_eta_iso == "2024-01-01T08:02:00"


def test_fallback_levels(visits, requests):
    v = visits({"hour_of_day": 9}, {"stop_id": "20", "stop_sequence": "2", "hour_of_day": 3, "delay_minutes": 4.0}, {"stop_id": "30", "stop_sequence": "3", "delay_minutes": None})
    got = {r.stop_id: (r.delay_level, r.mean_delay) for r in eta.with_delays(requests({}), v).collect()}
    assert got == {10: ("stop_slot", 1.0), 20: ("stop", 4.0), 30: ("route", 2.5)}


def test_statuses(visits, requests):
    rows = requests({"request_id": 1}, {"request_id": 2, "route_short_name": "Z"}, {"request_id": 3, "holiday_flag": 2}, {"request_id": 4, "from_lat": 1.0})
    got = {r.request_id: r.status for r in eta.request_status(rows, visits(*LINE)).collect()}
    assert got == {1: "ok", 2: "route_not_found", 3: "invalid_request", 4: "invalid_request"}


@pytest.fixture
def index(visits):
    v = visits(*[r | {"stop_lat": str(i), "stop_lon": "0.5"} for i, r in enumerate(LINE)])
    return stops.route_stop_index(stops.stop_catalogue(v.withColumn("route_key", F.col("route_short_name"))))


@pytest.mark.parametrize(("a", "b", "want"), [(20, 40, [20, 30, 40]), (40, 20, [40, 30, 20])])
def test_slice_by_position_keeps_the_direction(requests, index, a, b, want):
    rows, _ = stops.slice_by_position(stops.resolve_endpoints(requests({"from_stop_id": a, "to_stop_id": b}), index), index)
    assert [r.stop_id for r in rows.orderBy("seg").collect()] == want


def test_endpoint_statuses(requests, index):
    rows = requests({"request_id": 1, "from_stop_id": 20, "to_stop_id": 999}, {"request_id": 2, "from_stop_id": 0, "to_stop_id": 20}, {"request_id": 3, "route_short_name": "Z"},
                    {"request_id": 4, "from_stop_id": 0, "to_stop_id": 20, "from_lat": 1.2, "from_lon": 0.5, "to_lat": 3.9, "to_lon": 0.5})
    segment, status = stops.slice_by_position(stops.resolve_endpoints(rows, index), index)
    assert {r.request_id: r.status for r in status.collect()} == {1: "stop_not_on_route", 2: "endpoints_missing", 3: "route_not_found", 4: "ok"}
    assert [r.stop_id for r in segment.orderBy("seg").collect()] == [20, 30, 40, 50]


def test_zero_coordinates_count_as_absent(spark):
    assert value(spark, geo.first_nonzero(F.lit(0.0), F.lit(None).cast("double"), F.lit(3.0))) == 3.0
    assert value(spark, geo.first_nonzero(F.lit(0.0))) == 0.0


def test_one_point_has_no_routing_string(spark):
    one, two = ([(1.0, 2.0)], [(1.0, 2.0), (3.0, 4.5)])
    df = spark.createDataFrame([(1, one), (2, two)], "id int, line array<struct<lat:double,lon:double>>")
    assert [r.r for r in df.orderBy("id").select(geo.routing_string(F.col("line")).alias("r")).collect()] == [None, "2.0,1.0;4.5,3.0"]


def test_narrowing_stops_at_the_bound(spark):
    df = spark.createDataFrame([(1, 127, 1e39), (126, 1, 0.0)], "a bigint, b bigint, c double")
    assert dict(clean.narrow_types(df).dtypes) == {"a": "tinyint", "b": "smallint", "c": "double"}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="delay_minutes"):
        files.require_columns(spark.range(1), ["id", "delay_minutes"])


def test_unseen_label_raises_or_gets_a_status(spark):
    codes = model.encoder(spark.createDataFrame([("b",), ("a",), ("nan",)], "route_short_name string"))
    assert {r.route_short_name: r.route_encoded for r in codes.collect()} == {"a": 0.0, "b": 1.0, "nan": 2.0}
    new = spark.createDataFrame([("zz",)], "route_short_name string")
    with pytest.raises(Exception, match="unknown route"):
        model.encode_route(new, codes).collect()
    assert model.encode_route(new, codes, strict=False).first().route_encoded is None


def test_splits_are_disjoint_complete_and_of_exact_size(spark):
    ids = spark.range(1003).select(F.col("id").cast("string").alias("trip_id"))
    got = [(r.split, r["count"]) for r in ranking.split_by_key(ids).groupBy("split").count().orderBy("split").collect()]
    assert got == [("test", 101), ("train", 802), ("val", 100)]
    ranks = ranking.global_rank(ids, "trip_id", 7)
    assert ranks.agg(F.min("rank"), F.max("rank"), F.countDistinct("rank")).first()[:] == (1, 1003, 1003)
    assert ranking.split_fast(ids).groupBy("split").count().count() == 3


def test_no_visits_no_crash(spark, visits, requests):
    v = visits({}).filter("false")
    assert eta.timeline(requests({}), v).count() == 0
    assert profile.shape(v).first().n_rows == 0


def test_training_beats_the_mean_and_survives_saving(spark, tmp_path):
    from headway.queries import named_requests, by_name, visits as fixture

    v = fixture(spark, "/root/testdata/sf0.001")
    fitted = training.train_delay_model(v, trees=5, rounds=3)
    assert fitted.metrics["mae"] > 0
    model.save_model(fitted.best, fitted.codes, str(tmp_path / "m"))
    loaded = model.load_model(str(tmp_path / "m"))
    rows, status = eta.eta_from_model(named_requests(spark, "/root/testdata/sf0.001"), by_name(spark, "/root/testdata/sf0.001"), loaded)
    assert rows.filter("predicted_delay_minutes is null").count() == 0
    assert status.filter("status = 'ok'").count() == rows.select("request_id").distinct().count()
    assert model.feature_importance(spark, loaded).count() == 7


def test_boosted_trees_keep_to_their_columns(spark, tmp_path):
    rng = random.Random(4)
    names = ["a", "b", "c", "d", "e", "f", "g"]
    rows = [tuple(rng.random() for _ in names) for _ in range(1500)]
    rows = [(*r, 10 * r[0] + 5 * (r[1] > 0.5) + 3 * r[2] * r[3] + rng.random()) for r in rows]
    table = spark.createDataFrame(rows, [*names, "y"])
    fitted = boosting.fit(table.filter("g < 0.8"), names, "y", rounds=12, depth=3)
    assert len({tuple(c) for c in fitted.columns}) > 1
    for columns, tree in zip(fitted.columns, fitted.trees, strict=True):
        assert len(columns) == 5 and set(map(int, re.findall(r"feature (\d+)", tree.toDebugString))) <= set(columns)
    again = boosting.fit(table.filter("g < 0.8").repartition(7), names, "y", rounds=12, depth=3)
    assert again.columns == fitted.columns
    assert boosting.fit(table, names, "y", rounds=2, depth=3, seed=1).columns != fitted.columns[:2]
    features = VectorAssembler(inputCols=names, outputCol="features").transform(table.filter("g >= 0.8"))
    out = fitted.transform(features).select("y", "prediction", F.lit(fitted.start).alias("mean")).collect()
    error = lambda c: sum((r.y - r[c]) ** 2 for r in out)
    assert error("prediction") < 0.5 * error("mean")
    assert fitted.featureImportances.toArray().sum() == pytest.approx(1) and fitted.featureImportances.toArray().argmax() == 0
    fitted.write().overwrite().save(str(tmp_path / "trees"))
    loaded = boosting.BoostedTrees.load(str(tmp_path / "trees"))
    assert loaded.columns == fitted.columns
    assert [r.prediction for r in loaded.transform(features).collect()] == [r.prediction for r in out]
    assert boosting.fit(table.filter("false"), names, "y", rounds=0, depth=3).transform(features).first().prediction == 0.0


def test_registered_models_train_with_all_trees_and_rounds(monkeypatch):
    from headway import queries

    monkeypatch.setattr(queries, "visits", lambda spark, d: "visits")
    monkeypatch.setattr(training, "train_delay_model", lambda *a, **k: (a, k))
    session = SimpleNamespace(sparkContext=SimpleNamespace(applicationId="none"))
    assert queries._trained(session, "") == (("visits",), {})
    assert training.__dict__["model"].train_random_forest.__defaults__[0] == 30
    assert training.__dict__["model"].train_boosted_trees.__defaults__[0] == 50


def test_split_by_marks_is_the_split_by_key(spark):
    for n in (0, 1, 2, 1003):
        ids = spark.range(n).select(F.col("id").cast("string").alias("trip_id"))
        want = {r.trip_id: r.split for r in ranking.split_by_key(ids).collect()}
        assert {r.trip_id: r.split for r in ids.withColumn("split", ranking.split_by_marks(ids)).collect()} == want


def test_training_draws_the_same_rows_without_joining_visits_to_trips(spark, monkeypatch):
    from headway.queries import visits as fixture

    v = fixture(spark, "/root/testdata/sf0.001").filter("trip_id is not null").withColumn("mark", F.monotonically_increasing_id()).persist()
    split = ranking.split_by_marks(v.select("trip_id").distinct())
    sizes = {r.split: r["count"] for r in v.groupBy(split.alias("split")).count().collect()}
    visit, h = training.VISIT, F.xxhash64(*training.VISIT, F.lit(42))
    for most in ({"train": 300, "val": 40, "test": 50}, {"train": 10**6, "val": 10**6, "test": 1}):
        rows = training.drawn(v, split, most, sizes, 42)
        for name, n in most.items():
            want = v.withColumn("split", split).filter(F.col("split") == name).orderBy(h, *visit).limit(n).select(*visit).collect()
            assert sorted(map(str, want)) == sorted(map(str, rows.filter(F.col("split") == name).orderBy(h, *visit).limit(n).select(*visit).collect()))
    plans = []
    keep = training.written
    monkeypatch.setattr(training, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    training.train_delay_model(fixture(spark, "/root/testdata/sf0.001"), trees=1, rounds=1)
    over_visits = [p for p in plans if "l_shipdate" in p or "l_orderkey" in p]
    assert len(over_visits) == 2 and all(p.count("Join") == 2 for p in over_visits)  # those of the visits' own tables


def test_boosted_trees_are_applied_in_one_call(spark, tmp_path):
    table = spark.range(200).selectExpr("cast(id % 7 as double) a", "cast(id % 3 as double) b", "cast(id % 7 + id % 3 as double) y")
    fitted = boosting.fit(table, ["a", "b"], "y", rounds=4, depth=2)
    out = fitted.transform(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(table))
    assert out._jdf.queryExecution().executedPlan().toString().count("UDF(features") == 1
    for r in out.select("features", "prediction").distinct().collect():
        assert r.prediction == pytest.approx(fitted.start + sum(fitted.step * t.predict(r.features) for t in fitted.trees))


def test_model_path_leaves_requests_where_they_lie(spark, requests, index, monkeypatch):
    """Segments are cut out once for each pair of ends; no exchange or sort of the requests on the way to the stops and statuses."""
    rows = requests({"request_id": 1, "from_stop_id": 20, "to_stop_id": 40}, {"request_id": 2, "from_stop_id": 40, "to_stop_id": 20}, {"request_id": 3, "from_stop_id": 20, "to_stop_id": 40},
                    {"request_id": 4, "route_short_name": "Z"}, {"request_id": 5, "from_stop_id": 20, "to_stop_id": 999}, {"request_id": 6, "from_lat": 1.2})
    delays = SimpleNamespace(transform=lambda df: df.withColumn("prediction", F.lit(1.5)))
    segments, slice_by_position = [], stops.slice_by_position
    monkeypatch.setattr(stops, "slice_by_position", lambda asked, *a: segments.append(asked.count()) or slice_by_position(asked, *a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out, status = eta.eta_from_model(rows, index, delays)
        assert segments == [3]
        for table in (out, status):
            plan = table._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
        assert [(r.request_id, r.stop_id) for r in out.orderBy("request_id", "seg").collect()] == [(1, 20), (1, 30), (1, 40), (2, 40), (2, 30), (2, 20), (3, 20), (3, 30), (3, 40)]
        assert {r.request_id: r.status for r in status.collect()} == {1: "ok", 2: "ok", 3: "ok", 4: "route_not_found", 5: "stop_not_on_route", 6: "invalid_request"}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
