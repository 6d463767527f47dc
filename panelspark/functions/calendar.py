"""Calendar, day-length and clock expressions on local dates."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def year_cycle(day: Column) -> tuple[Column, Column]:
    """Sine and cosine of the day of year; a year divisible by four counts 366 days."""
    length = F.when(F.year(day) % 4 == 0, 366.0).otherwise(365.0)
    phase = F.dayofyear(day) * (2 * math.pi) / length
    return F.sin(phase), F.cos(phase)


def is_weekend(day: Column) -> Column:
    return F.dayofweek(day).isin(1, 7).cast("int")


def day_length_hours(day: Column, latitude: Column) -> Column:
    """Astronomical day length from the solar declination; clipped to polar day and night."""
    declination = F.cos((F.dayofyear(day) + 10) * (2 * math.pi) / 365.2422) * math.radians(-23.44)
    hour_angle = -F.tan(F.radians(latitude)) * F.tan(declination)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), hour_angle))) * (24 / math.pi)


def issue_instant(day: Column, zone: str = "America/Toronto") -> Column:
    """UTC clock of local midnight, honouring daylight saving and independent of the session time zone."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), day.cast("timestamp_ntz"))


def standard_offset_hours(longitude: Column, west_of: float = -90.0, west: int = -6, east: int = -5) -> Column:
    """Fixed clock offset by longitude, without daylight saving."""
    return F.when(longitude < west_of, west).otherwise(east)


def local_seconds(seconds: Column, longitude: Column) -> Column:
    return seconds + standard_offset_hours(longitude) * 3600
