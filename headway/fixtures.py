"""Views that give the test tables the shape of stop visits and route requests.

The same SQL runs on Spark and DuckDB; ``{dow}`` is the weekday of ``l_shipdate``, 0 = Monday.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VISITS = """
select cast(l_orderkey as string) as trip_id,
       cast(o_custkey % 6 as string) as route_id,
       case when o_custkey % 17 = 0 then null else c_mktsegment end as route_short_name,
       case when l_partkey % 101 = 0 then 'bad' else cast(l_suppkey % 25 as string) end as stop_id,
       case when l_suppkey % 25 = 3 then null else concat('Stop-', cast(l_suppkey % 25 as string)) end as stop_name,
       case when l_partkey % 97 = 0 then null else cast(28.375 + (l_suppkey % 25) * 0.0125 as double) end as stop_lat,
       cast(76.90 + ((l_suppkey % 25) % 7) * 0.03125 as double) as stop_lon,
       case when l_partkey % 103 = 0 then 'n/a' else cast(((l_suppkey % 25) * 7) % 25 + l_linenumber % 3 as string) end as stop_sequence,
       case when l_partkey % 61 = 0 then null
            when l_partkey % 59 = 0 then 'bogus'
            when l_partkey % 53 = 0 then concat(lpad(cast(4 * (l_partkey % 7) as string), 2, '0'), ':30')
            else concat(lpad(cast(4 * (l_partkey % 7) as string), 2, '0'), ':', lpad(cast(cast(l_quantity as int) as string), 2, '0'), ':00') end as scheduled_arrival_time,
       cast({dow} as int) as day_of_week,
       cast(4 * (l_partkey % 7) % 24 as int) as hour_of_day,
       case when l_returnflag = 'R' then 1 else 0 end as holiday_flag,
       case when l_partkey % 89 = 0 or l_suppkey % 25 = 4 or o_custkey % 6 = 5 then null else cast((l_quantity - 12.0) / 2 as double) end as delay_minutes
from {lineitem} join {orders} on l_orderkey = o_orderkey join {customer} on o_custkey = c_custkey
"""

REQUESTS = """
select event_id as request_id,
       case when event_id % 50 = 0 then 'NO_SUCH' when user_id % 2 = 0 then cast(user_id % 6 as string)
            when user_id % 5 = 0 then 'BUILDING' when user_id % 5 = 1 then 'MACHINERY' when user_id % 5 = 2 then ' FURNITURE '
            when user_id % 5 = 3 then 'HOUSEHOLD' else 'AUTOMOBILE' end as route_short_name,
       case when event_id % 4 in (0,1) then event_id % 25 when event_id % 41 = 2 then 999 end as from_stop_id,
       case when event_id % 4 in (0,2) then (event_id * 7) % 25 end as to_stop_id,
       case when event_id % 3 = 0 then cast(28.40 + (event_id % 31) * 0.01 as double) end as from_lat,
       case when event_id % 3 = 0 then cast(76.90 + (event_id % 23) * 0.01 as double) end as from_lon,
       case when event_id % 3 = 0 then cast(28.40 + (event_id % 29) * 0.01 as double) end as to_lat,
       case when event_id % 3 = 0 then cast(76.90 + (event_id % 19) * 0.01 as double) end as to_lon,
       cast(ts as {timestamp}) as request_ts, case when event_type = 'error' then 1 else 0 end as holiday_flag
from {events}
"""


def raw_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer")}
    return spark.sql(VISITS.replace("{dow}", "weekday(l_shipdate)"), **tables)


#: The same visits with what tells when and which: the month stands for the day of service, to keep the number of partitions of the small tables low.
DAYS = VISITS.replace("select cast(l_orderkey", "select cast(date_trunc('month', l_shipdate) as date) as service_day, cast(l_shipdate as timestamp) as seen_at,\n       concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as visit_id, cast(l_orderkey", 1)


def visits_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw visits with ``service_day, seen_at, visit_id``."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "customer")}
    return spark.sql(DAYS.replace("{dow}", "weekday(l_shipdate)"), **tables)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REQUESTS.replace("{timestamp}", "timestamp_ntz"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def duckdb_views() -> tuple[str, str]:
    names = {t: t for t in ("lineitem", "orders", "customer", "events")}
    return VISITS.format(dow="isodow(l_shipdate) - 1", **names), REQUESTS.format(timestamp="timestamp", **names)
