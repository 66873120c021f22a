"""The visit stream and the tables that are kept up to date."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from headway.operators import baseline, clean, ranking
from headway.streaming import visits as stream

RAW = (
    "trip_id string, route_id string, route_short_name string, stop_id string, stop_name string, stop_lat double, stop_lon double, stop_sequence string, "
    "scheduled_arrival_time string, day_of_week int, hour_of_day int, holiday_flag int, delay_minutes double, service_day date, seen_at timestamp, visit_id string"
)


def visit(name, day, delay=1.0, stop="10"):
    return ("t", "R", "A", stop, "s", 1.0, 2.0, "1", "08:00", 0, 8, 0, delay, dt.date(2024, 1, day), dt.datetime(2024, 1, day, 12), name)


@pytest.fixture
def arrive(spark, tmp_path):
    def one(*rows):
        spark.createDataFrame(list(rows), RAW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream.keep_sums(stream.read_visits(spark, str(tmp_path / "in"), RAW, 100), str(tmp_path / "sums"), str(tmp_path / "state"), "3 days").awaitTermination()
        return stream.latest_version(spark, str(tmp_path / "sums"))

    return one


def totals(df):
    return sorted((r.stop_id, r.total, r.n, r.visits) for r in df.collect())


def test_stream_counts_each_visit_once_and_keeps_versions(spark, arrive, tmp_path):
    path = str(tmp_path / "sums")
    first = arrive(visit("a", 10, 2.0), visit("a", 10, 2.0), visit("b", 9, None), visit("x", 10, 5.0, "bad"))
    assert totals(stream.sums_at(spark, path)) == [(10, 2.0, 1, 2)]  # one of two equal ones, one without a delay, one without a stop
    second = arrive(visit("a", 10, 2.0), visit("c", 8, 4.0), visit("d", 11, 1.0, "20"))  # again, out of order, new
    assert totals(stream.sums_at(spark, path)) == [(10, 6.0, 2, 3), (20, 1.0, 1, 1)]
    assert totals(stream.sums_at(spark, path, first)) == [(10, 2.0, 1, 2)]  # the old version is still there
    third = arrive(visit("e", 20, 7.0), visit("f", 9, 1.0))
    assert totals(stream.sums_at(spark, path)) == [(10, 14.0, 4, 5), (20, 1.0, 1, 1)]
    arrive(visit("g", 12, 100.0), visit("h", 19, 1.0))  # g is over three days behind the latest: too late
    assert totals(stream.sums_at(spark, path)) == [(10, 15.0, 5, 6), (20, 1.0, 1, 1)]
    assert first < second < third
    stream.compact(spark, path, str(tmp_path / "table"), third)
    assert totals(spark.read.parquet(str(tmp_path / "table"))) == [(10, 14.0, 4, 5), (20, 1.0, 1, 1)]


def test_days_are_written_anew_alone(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = lambda *v: clean.clean_stop_visits(spark.createDataFrame(list(v), RAW))
    baseline.write_days(rows(visit("a", 1, 1.0), visit("b", 2, 2.0), visit("c", 3, 30.0)), path)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "days").glob("service_day=2024-01-0[12]/*.parquet")}
    baseline.write_days(rows(visit("c", 3, 3.0)), path)
    days = spark.read.parquet(path)
    assert totals(baseline.sums_of_days(days)) == [(10, 6.0, 3, 3)]
    assert {f.name: f.stat().st_mtime_ns for f in (tmp_path / "days").glob("service_day=2024-01-0[12]/*.parquet")} == before
    assert totals(baseline.sums_of_days(days.filter("service_day < '2024-01-03'"))) == [(10, 3.0, 2, 2)]


def test_grains_read_the_visits_once(spark):
    v = clean.clean_stop_visits(spark.createDataFrame([visit("a", 1), (*visit("b", 2)[:9], None, *visit("b", 2)[10:])], RAW))
    out = baseline.baseline_all(v)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1
    got = sorted((r.level, r.day_of_week, r.mean_delay) for r in out.collect())
    assert got == [("overall", None, 1.0), ("route", None, 1.0), ("stop", None, 1.0), ("stop_slot", 0, 1.0)]  # a null weekday has no slot


def test_smallest_sorts_one_bucket(spark):
    df = spark.range(20_000).withColumn("key", F.col("id").cast("string"))
    h = ranking.hash_key("key", 42)
    for n in (0, 1, 777, 19_999, 20_000, 30_000):
        want = {r.key for r in df.orderBy(h, "key").limit(n).collect()}
        assert {r.key for r in ranking.sample_n(df, "key", n, digits=2).collect()} == want
    plan = ranking.sample_n(df, "key", 10_000, digits=2)._jdf.queryExecution().executedPlan().toString()
    # What is ordered is one bucket of 256, and fewer rows than that.
    assert "TakeOrderedAndProject(limit=" in plan and int(plan.split("TakeOrderedAndProject(limit=")[1].split(",")[0]) < 200
    ties = spark.createDataFrame([("a", i) for i in range(50)], "key string, i int")
    assert ranking.sample_n(ties, "key", 20).count() == 20
    signed = F.xxhash64("id")
    assert {r.id for r in ranking.smallest(df, 500, F.shiftright(signed, 48), [signed, F.col("id")]).collect()} == {r.id for r in df.orderBy(signed, "id").limit(500).collect()}


def test_rejects_and_kept_are_all(spark):
    rows = [visit("a", 1), visit("b", 1, stop=None), visit("c", 1, stop="x"), (*visit("d", 1)[:5], None, *visit("d", 1)[6:]), (*visit("e", 1)[:5], float("nan"), None, "y", *visit("e", 1)[8:])]
    raw = spark.createDataFrame(rows, RAW)
    got = {r.visit_id: r.reason for r in clean.judged_visits(raw).collect()}
    assert got == {"a": None, "b": "no stop", "c": "no stop", "d": "no latitude", "e": "no sequence"}
    assert clean.clean_stop_visits(raw).count() + clean.rejected_visits(raw).count() == raw.count()


def test_heavy_values_count_few(spark):
    from headway.operators import profile

    df = spark.range(40_000).select(F.when(F.col("id") % 10 < 3, F.concat(F.lit("hot"), (F.col("id") % 3).cast("string"))).otherwise(F.col("id").cast("string")).alias("x"))
    assert profile.heavy_values(df, "x", 3, 1024).collect() == profile.top_values(df, "x", 3).collect()
    assert profile.heavy_values(df, "x", 9, 1024).collect() == profile.top_values(df, "x", 9).collect()  # the rest are equally rare
    assert profile.heavy_values(df.filter("x = 'hot1'"), "x", 3).collect() == profile.top_values(df.filter("x = 'hot1'"), "x", 3).collect()
    assert profile.heavy_values(df.filter("false"), "x", 3).count() == 0
    nulls = spark.createDataFrame([(None,)] * 5 + [("a",)] * 3 + [("b",)] * 3, "x string")
    assert profile.heavy_values(nulls, "x", 2).collect() == profile.top_values(nulls, "x", 2).collect()


def test_sketches_merge(spark):
    from headway.operators import profile

    df = spark.range(50_000).selectExpr("id % 7 as day", "cast(id as double) as x", "id % 1000 as k")
    said = profile.sketched(profile.merged(profile.sketches(df, ["day"], ["x"], ["k"]))).first()
    assert [abs(said[f"x_q{q}"] / 50_000 - q / 100) < 0.01 for q in (25, 50, 75)] == [True] * 3 and abs(said.k_distinct / 1000 - 1) < 0.03
    some = profile.sketched(profile.merged(profile.sketches(df, ["day"], ["x"], ["k"]), ["day"]))
    assert some.count() == 7


def test_bucketed_visits_are_not_moved(spark, tmp_path):
    from headway.sources import visits as files

    rows = clean.clean_stop_visits(spark.createDataFrame([visit(str(i), 1 + i % 28) for i in range(200)], RAW)).withColumn("trip_id", F.col("visit_id"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        v = files.save_bucketed(rows, "visits_in_buckets", str(tmp_path / "b"), buckets=4)
        out = clean.filter_by_ids(v, ranking.split_by_key(v).filter("split = 'test'"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        left = plan[: plan.index("Scan parquet")]  # from the join down to the scan of the visits, which come first
        assert "SortMergeJoin" in left and "Exchange" not in left
        assert out.count() == 20
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_range_join_meets_about_its_result(spark):
    from headway.operators import stops

    route = spark.range(4000).select(F.lit("hot").alias("route_short_name"), F.col("id").alias("pos"), F.col("id").alias("stop_id"))
    asked = spark.range(200).select(F.lit("hot").alias("route_short_name"), (F.col("id") * 17).alias("a"), (F.col("id") * 17 + F.col("id") % 9).alias("b"))
    low, high = F.col("a"), F.col("b")
    got = stops.rows_between(asked, route, "route_short_name", "pos", low, high)
    assert got.count() == sum(min(i * 17 + i % 9, 3999) - i * 17 + 1 for i in range(200))
    assert {(r.a, r.pos) for r in got.collect()} == {(i * 17, p) for i in range(200) for p in range(i * 17, i * 17 + i % 9 + 1) if p < 4000}
    met = asked.withColumn("bin", F.explode(F.sequence(F.floor(low / stops.BIN), F.floor(high / stops.BIN)))).count() * stops.BIN
    assert met < 200 * 3 * stops.BIN  # and not 200 * 4000


def test_many_visits_come_in_short_files_that_go_when_read(spark, duck, tmp_path, monkeypatch):
    from conftest import plain

    from headway import oracles, queries
    from headway.streaming import visits as streamed

    seen, keep = [], stream.keep_sums

    def watched(raw, path, checkpoint, *more):
        seen.append((len(list(tmp_path.glob("in/*"))), raw.sparkSession.read.parquet(str(tmp_path / "in/*")).count()))
        return keep(raw, path, checkpoint, *more)

    monkeypatch.setattr(queries, "FILE_VISITS", 1000)
    monkeypatch.setattr(streamed, "keep_sums", watched)
    queries._streamed(spark, "/root/testdata/sf0.001", str(tmp_path))
    assert len(seen) > 5 and all(dirs == 1 and n < 2000 for dirs, n in seen)
    assert not list(tmp_path.glob("in/*")) and not list(tmp_path.glob("all/*")) and not (tmp_path / "state").exists()
    got = stream.sums_at(spark, str(tmp_path / "sums"))
    cursor = duck.execute(oracles.oracle_sql()["streamed_sums"])
    names = [c[0] for c in cursor.description]
    assert sorted(tuple(map(plain, r)) for r in got.select(*names).collect()) == sorted(tuple(map(plain, r)) for r in cursor.fetchall())


def test_settings_of_the_stream_are_its_own(spark, arrive, tmp_path):
    spark.createDataFrame([visit("a", 1)], RAW).write.parquet(str(tmp_path / "some"))
    stream.keep_sums(stream.read_visits(spark, str(tmp_path / "some"), RAW, 1), str(tmp_path / "s"), str(tmp_path / "c"), "3 days", 2).awaitTermination()
    assert "\"spark.sql.shuffle.partitions\":\"2\"" in (tmp_path / "c/offsets/0").read_text()
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4" and spark.conf.get("spark.sql.streaming.minBatchesToRetain") == "100"
    arrive(visit("a", 1))
    assert "\"spark.sql.shuffle.partitions\":\"4\"" in (tmp_path / "state/offsets/0").read_text()
