"""Clock times, dates and arrival times.  Times have no zone: the written wall clock counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clock(text: Column, strict: bool = True) -> Column:
    """The time of day in ``text`` as a struct (h, m, s); null where it isn't one.

    strict: two or three parts (``HH:MM[:SS]``), the rule of the baseline; else a fourth part is ignored, as on the model path.
    """
    parts = F.split(text, ":")
    n = F.size(parts)
    number = lambda i: F.when(F.regexp_like(F.trim(F.get(parts, F.lit(i))), F.lit(r"^\+?\d{1,9}$")), F.trim(F.get(parts, F.lit(i))).try_cast("int"))
    h, m, s = number(0), number(1), F.when(n == 2, F.lit(0)).otherwise(number(2))
    shape = n.isin(2, 3) if strict else n >= 2
    fourth = F.lit(True) if strict else F.forall(F.slice(parts, 4, 1_000), lambda x: F.regexp_like(F.trim(x), F.lit(r"^[+-]?\d+$")))
    return F.when(shape & fourth & h.between(0, 23) & m.between(0, 59) & s.between(0, 59), F.struct(h.alias("h"), m.alias("m"), s.alias("s")))


def seconds_of(time: Column) -> Column:
    return time["h"] * 3600 + time["m"] * 60 + time["s"]


#: ISO 8601 as the ``fromisoformat`` of Python 3.11 reads it.  Groups: year, month, day; week's year, week, weekday; hour, minute, second, fraction; sign and
#: hour, minute, second, fraction of the zone.  A date is written with hyphens or without, so is a time with colons; any one character lies between them.
_CLOCK = r"(?:(\d\d)(?::(\d\d)(?::(\d\d))?)?(?:[.,](\d+))?|(\d\d)(?:(\d\d)(\d\d)?)?(?:[.,](\d+))?)"
_DATE = r"(?:(\d{4})-(\d\d)-(\d\d)|(\d{4})(\d\d)(\d\d)|(\d{4})-W(\d\d)(?:-(\d)(?!\d))?|(\d{4})W(\d\d)(?:(\d)(?=(?:\d(?:\d\d)*)?(?:\D|$)))?)"
ISO = rf"(?s)^{_DATE}(?:.{_CLOCK}(?:(Z)|([+-]){_CLOCK})?)?$"


def iso_parts(text: Column) -> Column:
    """A struct (at, zone) of an ISO text: the wall clock as written and what it says of the zone (``+hh:mm``, or empty); null where it isn't one."""
    fields = F.when(F.regexp_like(text.cast("string"), F.lit(ISO)), F.split(F.regexp_replace(text.cast("string"), ISO, "|".join(f"${i}" for i in range(1, 31))), r"\|"))
    # As the variable of a function the fields are made once, not anew for each use.
    return F.get(F.transform(F.array(fields), _iso_of), F.lit(0))


def _iso_of(found: Column) -> Column:
    group = lambda *at: F.coalesce(*[F.nullif(F.get(found, F.lit(i - 1)), F.lit("")) for i in at])
    number = lambda *at: F.coalesce(group(*at).try_cast("int"), F.lit(0))
    micros = lambda *at: F.coalesce(F.rpad(F.substring(group(*at), 1, 6), 6, "0").try_cast("int"), F.lit(0))
    # The week of January 4th is a year's first.
    year, week, day = group(7, 10).try_cast("int"), group(8, 11).try_cast("int"), F.coalesce(group(9, 12).try_cast("int"), F.lit(1))
    first = F.date_trunc("week", F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-01-04")).try_cast("timestamp_ntz")).cast("date")
    by_week = F.date_add(first, (week - 1) * 7 + day - 1)
    by_week = F.when((year > 0) & week.between(1, 53) & day.between(1, 7) & (F.weekofyear(by_week) == week), by_week)
    by_month = F.concat_ws("-", group(1, 4), group(2, 5), group(3, 6)).try_cast("date")
    date = F.coalesce(F.when(group(1, 4) != "0000", by_month), by_week)
    h, m, s, us = number(13, 17), number(14, 18), number(15, 19), micros(16, 20)
    zh, zm, zs, zus = number(23, 27), number(24, 28), number(25, 29), micros(26, 30)
    fine = found.isNotNull() & (h < 24) & (m < 60) & (s < 60) & (zh < 24) & (zm < 60) & (zs < 60) & date.isNotNull()
    interval = F.make_dt_interval(F.lit(0), h, m, (s + us / F.lit(1e6)).cast("decimal(18,6)"))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    tail = F.when((zs > 0) | (zus > 0), F.concat(F.lit(":"), two(zs), F.when(zus > 0, F.concat(F.lit("."), F.lpad(zus.cast("string"), 6, "0"))).otherwise(""))).otherwise("")
    sign = F.when((zh == 0) & (zm == 0) & (zs == 0) & (zus == 0), F.lit("+")).otherwise(group(22))
    zone = F.when(group(21).isNotNull(), F.lit("+00:00")).when(group(22).isNotNull(), F.concat(sign, two(zh), F.lit(":"), two(zm), tail)).otherwise("")
    return F.when(fine, F.struct((date.cast("timestamp_ntz") + interval).alias("at"), zone.alias("zone")))


def parse_iso(text: Column, as_of: Column) -> Column:
    """A wall-clock timestamp; ``as_of`` where the text is absent or isn't one.  An offset or Z is ignored."""
    return F.coalesce(iso_parts(text)["at"], as_of.cast("timestamp_ntz"))


def offset_text(text: Column) -> Column:
    """The zone at the end of an ISO text as ``+hh:mm``; empty where there is none."""
    return F.coalesce(iso_parts(text)["zone"], F.lit(""))


def day_of_week(ts: Column) -> Column:
    """0 = Monday."""
    return F.weekday(ts)


def at_time(ts: Column, seconds: Column) -> Column:
    """The date of ``ts`` at a second of the day."""
    return F.to_date(ts).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))


def plus_minutes(ts: Column, minutes: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (minutes * 60).cast("decimal(18,6)"))


def iso(ts: Column) -> Column:
    """ISO text; the fraction only where it isn't zero."""
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(""))


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def is_peak_hour(hour: Column) -> Column:
    """1 from 7 to 10 and from 17 to 20, ends included."""
    return (hour.between(7, 10) | hour.between(17, 20)).cast("int")
