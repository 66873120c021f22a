"""DuckDB SQL with the results of ``headway.queries``."""

from __future__ import annotations

from headway.fixtures import duckdb_views

RAW, REQUESTS = duckdb_views()


def _whole(c: str) -> str:
    return f"case when try_cast({c} as double) = floor(try_cast({c} as double)) then cast(try_cast({c} as double) as bigint) end"


BASE = f"""
raw as ({RAW}),
v as (select * from (
  select trip_id, route_id, coalesce(route_short_name, 'nan') as route_short_name, {_whole("stop_id")} as stop_id, stop_name, stop_lat, stop_lon, {_whole("stop_sequence")} as stop_sequence,
         coalesce(scheduled_arrival_time, 'nan') as scheduled_arrival_time, day_of_week, hour_of_day, holiday_flag, delay_minutes from raw)
  where stop_id is not null and stop_sequence is not null and stop_lat is not null and stop_lon is not null),
req as ({REQUESTS})"""
KEYED = """,
k as (select route_short_name as route_key, * from v union all select route_id, * from v where route_id <> route_short_name)"""
CATALOGUE = """,
cat as (
  select route_key, stop_id, stop_sequence, arg_min(stop_name, {s: scheduled_arrival_time, v: stop_name}) filter (where stop_name is not null) as stop_name,
         arg_min(stop_lat, {s: scheduled_arrival_time, v: stop_lat}) as stop_lat, arg_min(stop_lon, {s: scheduled_arrival_time, v: stop_lon}) as stop_lon,
         min(scheduled_arrival_time) as scheduled_arrival_time, count(*) as n_visits
  from k group by 1, 2, 3)"""
BY_NAME = ",\nk as (select route_short_name as route_key, * from v)" + CATALOGUE


def _collapse(source: str, keys: str) -> str:
    first = lambda c: f"arg_min({c}, {{q: stop_sequence, t: scheduled_arrival_time, v: {c}}}) filter (where {c} is not null)"
    return f"""select *, cast(row_number() over (partition by {keys} order by stop_sequence, stop_id) as int) as pos from (
  select {keys}, stop_id, {first("stop_name")} as stop_name, {first("stop_lat")} as stop_lat, {first("stop_lon")} as stop_lon,
         {first("scheduled_arrival_time")} as scheduled_arrival_time, min(stop_sequence) as stop_sequence from {source} group by {keys}, stop_id)"""


INDEX = BY_NAME + f""",
idx as (select route_key as route_short_name, pos - 1 as pos, stop_id, stop_name, stop_sequence, stop_lat as lat, stop_lon as lon, scheduled_arrival_time
        from ({_collapse("cat", "route_key")}))"""
REPR = """,
repr as (select route_key, route_id as repr_route_id, route_short_name as repr_route_short_name from (
  select route_key, route_id, route_short_name, row_number() over (partition by route_key order by count(stop_id) desc, route_id, route_short_name) as rn
  from k group by 1, 2, 3) where rn = 1)"""
SLICE = """,
fs as (select route_key, stop_id, min(stop_sequence) as seq from cat group by 1, 2),
ask as (select *, trim(route_short_name) as route_key, cast(isodow(request_ts) - 1 as int) as day_of_week, cast(hour(request_ts) as int) as hour_of_day from req),
bounds as (select ask.*, a.seq as fs, b.seq as ts, (from_stop_id is not null and a.seq is null) or (to_stop_id is not null and b.seq is null) as lost
  from ask left join fs a on a.route_key = ask.route_key and a.stop_id = from_stop_id left join fs b on b.route_key = ask.route_key and b.stop_id = to_stop_id),
sl as (select request_id, bounds.route_key, request_ts, day_of_week, hour_of_day, stop_id, stop_sequence, stop_name, stop_lat, stop_lon, scheduled_arrival_time
  from bounds join cat on cat.route_key = bounds.route_key and (lost or (
    (fs is null or ts is null or stop_sequence between least(fs, ts) and greatest(fs, ts)) and (fs is null or ts is not null or stop_sequence >= fs) and (ts is null or fs is not null or stop_sequence <= ts))))"""
MEANS = """,
m1 as (select route_id, route_short_name, stop_id, day_of_week, hour_of_day, avg(delay_minutes) as m from v group by all having m is not null),
m2 as (select route_id, route_short_name, stop_id, avg(delay_minutes) as m from v group by all having m is not null),
m3 as (select route_id, route_short_name, avg(delay_minutes) as m from v group by all having m is not null),
m4 as (select avg(delay_minutes) as m from v)"""
DELAYS = KEYED + CATALOGUE + REPR + SLICE + MEANS + f""",
seg as ({_collapse("sl", "request_id, route_key, request_ts, day_of_week, hour_of_day")}),
del as (select seg.*, repr_route_id, repr_route_short_name, coalesce(m1.m, m2.m, m3.m, m4.m) as mean_delay,
          case when m1.m is not null then 'stop_slot' when m2.m is not null then 'stop' when m3.m is not null then 'route' else 'overall' end as delay_level
  from seg join repr using (route_key)
  left join m1 on m1.route_id = repr_route_id and m1.route_short_name = repr_route_short_name and m1.stop_id = seg.stop_id and m1.day_of_week = seg.day_of_week and m1.hour_of_day = seg.hour_of_day
  left join m2 on m2.route_id = repr_route_id and m2.route_short_name = repr_route_short_name and m2.stop_id = seg.stop_id
  left join m3 on m3.route_id = repr_route_id and m3.route_short_name = repr_route_short_name cross join m4)"""
SECONDS = r"""case when regexp_full_match(scheduled_arrival_time, '\d{1,2}:\d{1,2}(:\d{1,2})?') then
  case when cast(string_split(scheduled_arrival_time, ':')[1] as int) < 24 and cast(string_split(scheduled_arrival_time, ':')[2] as int) < 60 and coalesce(cast(string_split(scheduled_arrival_time, ':')[3] as int), 0) < 60
       then cast(string_split(scheduled_arrival_time, ':')[1] as int) * 3600 + cast(string_split(scheduled_arrival_time, ':')[2] as int) * 60 + coalesce(cast(string_split(scheduled_arrival_time, ':')[3] as int), 0) else 0 end else 0 end"""
TIMELINE = DELAYS + f""",
tl0 as (select *, round_even(greatest(mean_delay, 0), 2) as predicted_delay_minutes, {SECONDS} as secs from del),
tl1 as (select *, date_trunc('day', request_ts) + to_microseconds(cast(secs as bigint) * 1000000 + cast(round(predicted_delay_minutes * 60000000) as bigint)) as e from tl0),
tl as (select *, stop_lat as lat, stop_lon as lon, strftime(e, '%Y-%m-%dT%H:%M:%S') || case when microsecond(e) % 1000000 <> 0 then '.' || lpad(cast(microsecond(e) % 1000000 as varchar), 6, '0') else '' end as predicted_eta_iso from tl1)"""
KM = "2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))))"


def _near(side: str) -> str:
    km = KM.format(a=f"{side}_lat", b=f"{side}_lon", c="lat", d="lon")
    return f"select request_id, arg_min(stop_id, {{d: round({km}, 9), p: pos}}) as stop_id, min(round({km}, 9)) as km from nreq join idx using (route_short_name) where {side}_lat is not null and {side}_lon is not null group by 1"


ENDS = INDEX + f""",
nreq as (select * replace (trim(route_short_name) as route_short_name) from req),
nf as ({_near("from")}), nt as ({_near("to")}),
res0 as (select request_id, route_short_name, case when nullif(from_stop_id, 0) is not null and nullif(to_stop_id, 0) is not null then from_stop_id else nf.stop_id end as from_id,
    case when nullif(from_stop_id, 0) is not null and nullif(to_stop_id, 0) is not null then to_stop_id else nt.stop_id end as to_id,
    route_short_name in (select route_short_name from idx) as known from nreq left join nf using (request_id) left join nt using (request_id)),
res as (select request_id, route_short_name, from_id, to_id, case when not known then 'route_not_found' when from_id is null or to_id is null then 'endpoints_missing' else 'ok' end as status from res0),
ij as (select res.*, a.pos as i, b.pos as j from res left join idx a on a.route_short_name = res.route_short_name and a.stop_id = from_id left join idx b on b.route_short_name = res.route_short_name and b.stop_id = to_id)"""
SPLIT = """,
ids as (select distinct trip_id from v),
ranked as (select trip_id, row_number() over (order by md5(trip_id || '|42'), trip_id) as rk, count(*) over () as n from ids),
split as (select trip_id, case when rk <= ceil(ceil(n / 5) / 2) then 'test' when rk <= ceil(n / 5) then 'val' else 'train' end as split from ranked)"""
CODES = """,
codes as (select route_short_name, cast(row_number() over (order by route_short_name) - 1 as double) as route_encoded from (select distinct route_short_name from v))"""
COLUMNS = ["trip_id", "route_id", "route_short_name", "stop_id", "stop_name", "stop_lat", "stop_lon", "stop_sequence", "scheduled_arrival_time", "day_of_week", "hour_of_day", "holiday_flag", "delay_minutes"]
NUMBERS = ["stop_id", "stop_lat", "stop_lon", "stop_sequence", "day_of_week", "hour_of_day", "holiday_flag", "delay_minutes"]
TEXTS = ["trip_id", "route_id", "route_short_name", "stop_name", "scheduled_arrival_time"]


def _narrow(c: str) -> str:
    if c in ("stop_lat", "stop_lon", "delay_minutes"):
        kind = "case when low > -3.4028234663852886e38 and high < 3.4028234663852886e38 then 'float' else 'double' end"
    else:
        kind = "case when low > -128 and high < 127 then 'tinyint' when low > -32768 and high < 32767 then 'smallint' when low > -2147483648 and high < 2147483647 then 'int' else 'bigint' end"
    return f"""select '{c}' as "column", low, high, {kind} as type from (select cast(min({c}) as double) as low, cast(max({c}) as double) as high from v)"""


def _describe(c: str) -> str:
    quartiles = ", ".join(f"round(quantile_cont(cast({c} as double), {q}), 6) as q{q * 100:.0f}" for q in (0.25, 0.5, 0.75))
    return f"""select '{c}' as "column", count({c}) as count, round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std, round(cast(min({c}) as double), 6) as min, {quartiles}, round(cast(max({c}) as double), 6) as max from v"""


def _text(c: str) -> str:
    return f"""select '{c}' as "column", cast(sum(n) as bigint) as count, count(*) as "unique", arg_max(x, {{n: n, o: -o}}) as top, max(n) as freq from (select {c} as x, count(*) as n, row_number() over (order by {c}) as o from v where {c} is not null group by 1)"""


STATUS = "case when route_short_name is null or holiday_flag not in (0, 1) or (from_lat is null) <> (from_lon is null) or (to_lat is null) <> (to_lon is null) then 'invalid_request' else 'ok' end"
TL = "request_id, pos, stop_id, stop_name, stop_sequence, lat, lon, scheduled_arrival_time, predicted_delay_minutes, predicted_eta_iso"
LISTS = "select route_id, string_agg(stop_id, ',' order by stop_sequence, stop_id) as stops from ({}) group by 1"
INPUT = "select route_id, stop_id, cast(trunc(try_cast(stop_sequence as double)) as bigint) as stop_sequence from raw where route_id is not null and stop_id is not null and try_cast(stop_sequence as double) is not null"

#: name: (what follows the base views, the query)
PARTS: dict[str, tuple[str, str]] = {
    "clean_visits": ("", "select * from v"),
    "read_visits_csv": ("", "select * from v"),
    "index_input": ("", INPUT),
    "filter_route": ("", "select * from v where 'BUILDING' in (route_short_name, route_id)"),
    "validate_requests": ("", f"select request_id, {STATUS} as status from req"),
    "request_status": (KEYED, f"select request_id, case when {STATUS} = 'ok' and trim(route_short_name) not in (select route_key from k) then 'route_not_found' else {STATUS} end as status from req"),
    "narrow_types": ("", " union all ".join(map(_narrow, NUMBERS))),
    "profile_shape": ("", "select count(*) as n_rows, 13 as n_columns from v"),
    "profile_info": ("", " union all ".join(f"""select '{c}' as "column", count({c}) as non_null from v""" for c in COLUMNS)),
    "profile_describe": ("", " union all ".join(map(_describe, NUMBERS))),
    "profile_text": ("", " union all ".join(map(_text, TEXTS))),
    "count_trips": ("", "select count(distinct trip_id) as n_distinct from v"),
    "top_trips": ("", "select trip_id, count(*) as count from v group by 1 order by 2 desc, 1 limit 5"),
    "head_visits": ("", "select trip_id, stop_sequence, stop_id from v order by trip_id, stop_sequence, stop_id, scheduled_arrival_time, delay_minutes nulls first limit 5"),
    "baseline_stop_slot": (MEANS, "select * exclude m, m as mean_delay from m1"),
    "baseline_stop": (MEANS, "select * exclude m, m as mean_delay from m2"),
    "baseline_route": (MEANS, "select * exclude m, m as mean_delay from m3"),
    "baseline_overall": (MEANS, "select m as mean_delay from m4"),
    "baseline_all": (MEANS, """select 'stop_slot' as level, * exclude m, m as mean_delay from m1 union all by name select 'stop' as level, * exclude m, m as mean_delay from m2
        union all by name select 'route' as level, * exclude m, m as mean_delay from m3 union all by name select 'overall' as level, m as mean_delay from m4"""),
    "representative_route": (KEYED + REPR, "select * from repr"),
    "regression_metrics": (MEANS, """select count(*) as n, round(avg(abs(e)), 6) as mae, round(avg(e * e), 6) as mse, round(1 - sum(e * e) / (count(*) * var_pop(delay_minutes)), 6) as r2
        from (select delay_minutes, delay_minutes - m as e from v join m2 using (route_id, route_short_name, stop_id) where delay_minutes is not null)"""),
    "order_stops": (KEYED, "select route_key, cast(row_number() over (partition by route_key order by stop_sequence, scheduled_arrival_time, stop_id, trip_id) as int) as visit_no, stop_sequence, scheduled_arrival_time from k"),
    "stop_catalogue": (KEYED + CATALOGUE, "select * from cat"),
    "first_sequence": (KEYED, "select route_key, stop_id, min(stop_sequence) as first_sequence from k group by 1, 2"),
    "collapse_stops": (KEYED + CATALOGUE, _collapse("cat", "route_key")),
    "route_stop_lists": ("", LISTS.format(f"select distinct * from ({INPUT})")),
    "route_index_json": ("", f"select route_id, cast(len(string_split(stops, ',')) as int) as n_stops, md5(stops) as digest from ({LISTS.format(f'select distinct * from ({INPUT})')})"),
    "route_stop_index": (INDEX, "select * from idx"),
    "nested_route_index": (INDEX, "select route_short_name, string_agg(cast(stop_id as varchar), ',' order by pos) as stop_ids from idx group by 1"),
    "nearest_stop": (ENDS, "select request_id, stop_id, round(km, 6) as distance_km from nf"),
    "slice_by_ids": (KEYED + CATALOGUE + SLICE, "select request_id, route_key, stop_id, stop_sequence from sl"),
    "resolve_endpoints": (ENDS, "select * from res"),
    "slice_by_position": (ENDS, "select request_id, case when i <= j then idx.pos - i else i - idx.pos end as seg, idx.stop_id from ij join idx on idx.route_short_name = ij.route_short_name and idx.pos between least(i, j) and greatest(i, j) where status = 'ok' and i is not null and j is not null"),
    "segment_status": (ENDS, "select request_id, case when status <> 'ok' then status when i is null or j is null then 'stop_not_on_route' else 'ok' end as status from ij"),
    "lookup_delay": (DELAYS, "select request_id, stop_id, round(mean_delay, 6) as mean_delay from del"),
    "delay_source_level": (DELAYS, "select delay_level, count(*) as n_stops from del group by 1"),
    "eta_timeline": (TIMELINE, f"select {TL} from tl"),
    "eta_request_stream": (TIMELINE, f"select {TL} from tl"),
    "eta_summary": (TIMELINE, """select request_id, count(*) as n_stops, arg_min(stop_id, pos) as start_stop_id, arg_max(stop_id, pos) as end_stop_id, round_even(sum(predicted_delay_minutes), 2) as total_predicted_delay_minutes,
        any_value(route_key) as route_key_used, any_value(repr_route_id) as repr_route_id, any_value(repr_route_short_name) as repr_route_short_name,
        any_value(day_of_week) as context_day_of_week, any_value(hour_of_day) as context_hour_of_day from tl group by 1"""),
    "eta_responses": (TIMELINE, "select request_id, cast(count(*) as int) as n_waypoints, arg_min(stop_id, pos) as start_stop_id, string_agg(predicted_eta_iso, ',' order by pos) as etas from tl group by 1"),
    "punctuality_bands": (TIMELINE, "select route_key, case when predicted_delay_minutes <= 0 then 'on_time' when predicted_delay_minutes <= 5 then 'minor' else 'major' end as band, count(*) as n_stops from tl group by 1, 2"),
    "waypoints": (TIMELINE, "select request_id, cast(pos - 1 as int) as pos, lat, lon from tl"),
    "routing_string": (TIMELINE, "select request_id, case when count(*) >= 2 then string_agg(cast(lon as varchar) || ',' || cast(lat as varchar), ';' order by pos) end as route from tl group by 1"),
    "swapped_lines": (TIMELINE, "select request_id, arg_min(lon, pos) as first_lon, arg_max(lat, pos) as last_lat from tl group by 1"),
    "haversine": ("", f"select request_id, round({KM.format(a='from_lat', b='from_lon', c='to_lat', d='to_lon')}, 6) as km from req where from_lat is not null"),
    "parse_hms": ("", f"select scheduled_arrival_time, count(*) as n, cast({SECONDS} as int) as seconds from v group by 1, 3"),
    "time_context": ("", """select request_id, cast(isodow(request_ts) - 1 as int) as day_of_week, cast(hour(request_ts) as int) as hour_of_day, strftime(request_ts, '%Y-%m-%d') as day, strftime(request_ts, '%H:%M') as clock,
        cast(hour(request_ts) between 7 and 10 or hour(request_ts) between 17 and 20 as int) as peak from req"""),
    "peak_hour": ("", "select cast(hour_of_day between 7 and 10 or hour_of_day between 17 and 20 as int) as peak, count(*) as n_visits, avg(delay_minutes) as mean_delay from v group by 1"),
    "stop_labels": ("", "select stop_id, coalesce(nullif(stop_name, ''), 'Stop ' || stop_id) as label, count(*) as n from v group by 1, 2"),
    "delay_texts": ("", "select case when delay_minutes > 0 then '+' else '' end || printf('%.1f', delay_minutes) as delay, upper(trim(route_short_name)) as route, count(*) as n from v where delay_minutes is not null group by 1, 2"),
    "split_by_trip": (SPLIT, "select * from split"),
    "split_files": (SPLIT, "select split, count(*) as n_visits, count(distinct trip_id) as n_trips from v join split using (trip_id) group by 1"),
    "filter_by_ids": (SPLIT, "select route_id, count(*) as n_visits, sum(delay_minutes) as total_delay from v where trip_id in (select trip_id from split where split = 'test') group by 1"),
    "sample_n": ("", "select request_id, route_short_name from req order by md5(cast(request_id as varchar) || '|42'), request_id limit 500"),
    "encode_route": (CODES, "select route_short_name, route_encoded, count(*) as n_visits from v join codes using (route_short_name) group by 1, 2"),
    "encode_route_fallback": ("", "select request_id, cast(coalesce(try_cast(trim(route_short_name) as bigint), 0) as double) as route_encoded from req"),
    "assemble_features": (CODES, """select route_encoded, cast(stop_sequence as double) as stop_sequence, cast(day_of_week as double) as day_of_week, cast(hour_of_day as double) as hour_of_day, cast(holiday_flag as double) as holiday_flag,
        count(*) as n, min(stop_lat) as least_lat, max(stop_lon) as most_lon from v join codes using (route_short_name) group by 1, 2, 3, 4, 5"""),
}


AT = "timestamp '2024-01-01 09:30:00'"
#: Request times as text: the clock as written, and the zone.
TEXT_TIMES = f""",
txt as (select *, case when request_id % 12 in (2, 3, 7, 11) then {AT} when request_id % 12 in (8, 9) then date_trunc('day', request_ts) else date_trunc('second', request_ts) end as written,
               case request_id % 12 when 0 then '+00:00' when 1 then '+05:30' when 4 then '-08:00' else '' end as utc_offset from req)"""
WALK = """,
walk as (select request_id, case when i <= j then idx.pos - i else i - idx.pos end as seg, idx.stop_id, stop_name, stop_sequence, lat, lon, scheduled_arrival_time
  from ij join idx on idx.route_short_name = ij.route_short_name and idx.pos between least(i, j) and greatest(i, j) where status = 'ok' and i is not null and j is not null)"""
LOOSE = r"""case when regexp_full_match(clock_text, '\d{1,2}:\d{1,2}(:\d{1,2}(:[+-]?\d+)*)?') then
  case when cast(string_split(clock_text, ':')[1] as int) < 24 and cast(string_split(clock_text, ':')[2] as int) < 60 and coalesce(cast(string_split(clock_text, ':')[3] as int), 0) < 60
       then cast(string_split(clock_text, ':')[1] as int) * 3600 + cast(string_split(clock_text, ':')[2] as int) * 60 + coalesce(cast(string_split(clock_text, ':')[3] as int), 0) end end"""
PARTS |= {
    "parse_iso": (TEXT_TIMES, "select request_id, strftime(written, '%Y-%m-%d %H:%M:%S') as clock, cast(isodow(written) - 1 as int) as day_of_week, cast(hour(written) as int) as hour_of_day, utc_offset from txt"),
    "eta_of_text_times": (TIMELINE.replace("from req)", "from (select * exclude (written, utc_offset) replace (written as request_ts) from txt))"), "select request_id, pos, stop_id, predicted_eta_iso from tl"),
    "model_offsets": (TEXT_TIMES + ENDS + WALK, "select request_id, utc_offset, count(*) as n_stops, count(*) as n_with_zone from walk join txt using (request_id) where request_id % 12 not in (2, 7) group by 1, 2"),
    "loose_clock": ("", f"""select clock_text, count(*) as n, cast({LOOSE} as int) as seconds from (
        select scheduled_arrival_time || case stop_id % 3 when 0 then ':7' when 1 then ':x' else '' end as clock_text from v) group by 1, 3"""),
    "coordinate_texts": (INDEX, "select route_short_name, stop_id, printf('%.5f', lat) || ', ' || printf('%.5f', lon) as coordinates from idx"),
    "score_status": ("", "select stop_id, stop_sequence, 'ok' as status, count(*) as n_visits, count(*) as n_predictions from v group by 1, 2"),
    "eta_from_model_stops": (ENDS + WALK, "select * from walk"),
    "eta_from_model_status": (ENDS, f"select ij.request_id, case when {STATUS.replace('route_short_name', 'req.route_short_name')} <> 'ok' then 'invalid_request' when ij.status <> 'ok' then ij.status when i is null or j is null then 'stop_not_on_route' else 'ok' end as status from ij join req using (request_id)"),
    "segment_counts": (ENDS + WALK, "select request_id, count(*) as segment_stop_count from walk group by 1"),
    "model_responses": (ENDS + WALK, "select request_id, count(*) as n_waypoints, string_agg(cast(stop_id as varchar), ',' order by seg) as stop_ids, count(*) as segment_stop_count from walk group by 1"),
}
PARTS["model_status_of_text_times"] = (ENDS, PARTS["eta_from_model_status"][1].replace("case when", "case when ij.request_id % 12 in (2, 7) then 'invalid_request' when", 1))
PARTS["eta_of_text_times"] = (TEXT_TIMES + PARTS["eta_of_text_times"][0], PARTS["eta_of_text_times"][1])


REASON = "case when stop_id is null then 'no stop' when stop_sequence is null then 'no sequence' when stop_lat is null then 'no latitude' when stop_lon is null then 'no longitude' end"
JUDGED = f""",
j as (select *, {REASON} as reason from (select trip_id, coalesce(route_id, 'nan') as route_id, {_whole("stop_id")} as stop_id, {_whole("stop_sequence")} as stop_sequence, stop_lat, stop_lon from raw))"""
HEX = "cast('0x' || substring(md5(trip_id || '|42'), 1, 8) as bigint)"
PARTS |= {
    "baseline_by_day": PARTS["baseline_all"],
    "streamed_sums": ("", "select route_id, route_short_name, stop_id, day_of_week, hour_of_day, sum(delay_minutes) as total, count(delay_minutes) as n, count(stop_id) as visits from v group by 1, 2, 3, 4, 5"),
    "eta_from_streamed_visits": PARTS["eta_timeline"],
    "heavy_trips": PARTS["top_trips"],
    "heavy_stops": ("", "select scheduled_arrival_time, count(*) as count from v group by 1 order by 2 desc, 1 limit 20"),
    "sketch_errors": ("", "select unnest(['stop_lat_q25', 'stop_lat_q50', 'stop_lat_q75', 'stop_lon_q25', 'stop_lon_q50', 'stop_lon_q75', 'delay_minutes_q25', 'delay_minutes_q50', 'delay_minutes_q75', 'stop_sequence_q25', 'stop_sequence_q50', 'stop_sequence_q75', 'trip_id']) as what, true as near"),
    "filter_bucketed": PARTS["filter_by_ids"],
    "visit_rejects": (JUDGED, "select coalesce(reason, 'kept') as reason, count(*) as n_visits, count(distinct route_id) as n_routes from j group by 1"),
    "rejected_visits": (JUDGED, "select trip_id, route_id, stop_id, stop_sequence, stop_lat, stop_lon, reason from j where reason is not null"),
    "sample_many": (SPLIT, "select trip_id from ranked where rk <= case when n > 50000 then 50000 else 1000 end"),
    "split_fast": ("", f"select trip_id, case when {HEX} < 0.8 * 4294967296 then 'train' when {HEX} < 0.9 * 4294967296 then 'val' else 'test' end as split, count(*) as n_visits from v group by 1, 2"),
}


def oracle_sql() -> dict[str, str]:
    return {name: f"with {BASE}{more}\n{query}" for name, (more, query) in PARTS.items()}
