"""Projection, distance, bearing, wind-vector and lattice expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0088  # fixed value: mean Earth radius


@dataclass(frozen=True)
class ConformalConic:
    """Ellipsoidal Lambert conformal conic with two standard parallels.

    Only constants are worked out in Python; `project` and `unproject` return
    column expressions. The defaults are fixed values: NAD83 / Canada Atlas Lambert.
    """

    semi_major: float = 6378137.0
    inverse_flattening: float = 298.257222101
    meridian: float = -95.0
    origin: float = 49.0
    parallels: tuple[float, float] = (49.0, 77.0)

    @cached_property
    def eccentricity(self) -> float:
        f = 1 / self.inverse_flattening
        return math.sqrt(f * (2 - f))

    def _parallel_radius(self, degrees: float) -> float:
        s = math.sin(math.radians(degrees))
        return math.cos(math.radians(degrees)) / math.sqrt(1 - (self.eccentricity * s) ** 2)

    def _isometric(self, degrees: float) -> float:
        s, e = math.sin(math.radians(degrees)), self.eccentricity
        return math.tan(math.radians(45 - degrees / 2)) * ((1 + e * s) / (1 - e * s)) ** (e / 2)

    @cached_property
    def cone(self) -> float:
        a, b = self.parallels
        return math.log(self._parallel_radius(a) / self._parallel_radius(b)) / math.log(self._isometric(a) / self._isometric(b))

    @cached_property
    def scale(self) -> float:
        a = self.parallels[0]
        return self.semi_major * self._parallel_radius(a) / (self.cone * self._isometric(a) ** self.cone)

    @cached_property
    def origin_radius(self) -> float:
        return self.scale * self._isometric(self.origin) ** self.cone

    def project(self, longitude: Column, latitude: Column) -> tuple[Column, Column]:
        e = self.eccentricity
        s = F.sin(F.radians(latitude)) * e
        isometric = F.tan(F.radians((F.lit(90.0) - latitude) / 2)) * F.pow((s + 1) / (F.lit(1.0) - s), F.lit(e / 2))
        radius = F.pow(isometric, F.lit(self.cone)) * self.scale
        angle = F.radians(longitude - self.meridian) * self.cone
        return radius * F.sin(angle), F.lit(self.origin_radius) - radius * F.cos(angle)

    def unproject(self, x: Column, y: Column, rounds: int = 12) -> tuple[Column, Column]:
        """Fixed-point latitude refinement folded inside the JVM (it converges well before `rounds`)."""
        e = self.eccentricity
        down = F.lit(self.origin_radius) - y
        radius = F.hypot(x, down) * (1.0 if self.cone > 0 else -1.0)
        isometric = F.pow(radius / self.scale, F.lit(1 / self.cone))

        def refine(phi: Column, _step: Column) -> Column:
            s = F.sin(phi) * e
            return F.lit(math.pi / 2) - F.atan(isometric * F.pow((F.lit(1.0) - s) / (s + 1), F.lit(e / 2))) * 2

        start = F.lit(math.pi / 2) - F.atan(isometric) * 2
        latitude = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, refine)
        return F.degrees(F.atan2(x, down) / self.cone) + self.meridian, F.degrees(latitude)

    def convergence(self, longitude: Column) -> Column:
        """Degrees to add to a grid bearing to get a true bearing."""
        return (longitude - self.meridian) * self.cone


def cell_index(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def cell_origin(value: Column, size: int) -> Column:
    return cell_index(value, size) * size


def cell_name(prefix: str, x: Column, y: Column) -> Column:
    return F.concat_ws("_", F.lit(prefix), x.cast("string"), y.cast("string"))


def distance_km(lon_a: Column, lat_a: Column, lon_b: Column, lat_b: Column) -> Column:
    """Great-circle distance, with the haversine clipped to [0, 1]."""
    half_lat = F.pow(F.sin(F.radians(lat_b - lat_a) / 2), F.lit(2.0))
    half_lon = F.pow(F.sin(F.radians(lon_b - lon_a) / 2), F.lit(2.0))
    h = half_lat + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * half_lon
    return F.asin(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), h)))) * (2 * EARTH_KM)


def bearing(east: Column, north: Column) -> Column:
    """Clockwise degrees from north; NULL for a zero-length offset."""
    return F.when(F.hypot(east, north) >= 1e-9, F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0)))


def angle_between(a: Column, b: Column) -> Column:
    """Smallest angle between two bearings, 0 to 180."""
    return F.abs(F.pmod(a - b + 180.0, F.lit(360.0)) - 180.0)


def wind_vector(speed: Column, from_direction: Column) -> tuple[Column, Column]:
    """East and north components of a wind blowing from a bearing."""
    return -speed * F.sin(F.radians(from_direction)), -speed * F.cos(F.radians(from_direction))


def wind_from(u: Column, v: Column) -> Column:
    """Bearing a wind vector blows from; NULL when calm, and a full turn reads as 0."""
    turn = F.pmod(F.degrees(F.atan2(-u, -v)), F.lit(360.0))
    return F.when(F.hypot(u, v) >= 1e-9, F.when(turn > 360.0 - 1e-9, 0.0).otherwise(turn))


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    length = dx * dx + dy * dy
    along = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / length))).otherwise(0.0)
    return F.hypot(px - (x1 + along * dx), py - (y1 + along * dy))


def crosses(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """1 when a ray going east from the point crosses the edge, else 0."""
    spans = (y1 > py) != (y2 > py)
    return F.when(spans & (px < (x2 - x1) * (py - y1) / F.nullif(y2 - y1, F.lit(0.0)) + x1), 1).otherwise(0)


def snapped_window(west: Column, south: Column, east: Column, north: Column, step: float, margin: float) -> dict[str, Column]:
    """Bounds grown by a margin and moved outward to the lattice."""
    down = lambda c: F.floor((c - margin) / step) * step
    up = lambda c: F.ceil((c + margin) / step) * step
    return {"west": down(west), "south": down(south), "east": up(east), "north": up(north)}
