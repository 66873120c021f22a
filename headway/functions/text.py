"""Labels and display texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def route_text(value: Column, upper: bool = False) -> Column:
    return F.upper(F.trim(value)) if upper else F.trim(value)


def stop_label(name: Column, stop_id: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Stop "), stop_id.cast("string")))


def delay_text(minutes: Column, digits: int = 1) -> Column:
    """With a sign where it is positive."""
    return F.concat(F.when(minutes > 0, "+").otherwise(""), F.format_string(f"%.{digits}f", minutes))


def clamp_delay(minutes: Column) -> Column:
    """At least 0, to two places, ties to even."""
    return F.bround(F.greatest(minutes, F.lit(0.0)), 2)


def band(minutes: Column) -> Column:
    return F.when(minutes <= 0, "on_time").when(minutes <= 5, "minor").otherwise("major")


def coordinates_text(lat: Column, lon: Column) -> Column:
    """Both to five decimals; null if one is absent."""
    return F.concat(F.format_string("%.5f", lat), F.lit(", "), F.format_string("%.5f", lon))
