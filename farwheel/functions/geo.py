"""Distances, bearings, projections and cells as Column expressions, in degrees and metres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6371000.0
DEGREE = 111194.9266


def _d(x: float) -> Column:
    return F.lit(float(x))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2.0)
    return 2 * _d(RADIUS) * F.asin(F.sqrt(F.least(_d(1.0), a)))


def equirect(lat1: Column, lon1: Column, lat2: Column, lon2: Column, degree: float = DEGREE) -> Column:
    y = (lat2 - lat1) * _d(degree)
    x = (lon2 - lon1) * _d(degree) * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(x * x + y * y)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """From north, 0 to 360."""
    a, b, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(dl) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(dl))) + 360.0, _d(360.0))


def bearing_delta(a: Column, b: Column) -> Column:
    x = F.pmod(F.abs(a - b), _d(360.0))
    return F.least(x, 360.0 - x)


def signed_angle(before: Column, after: Column) -> Column:
    """The turn from one bearing to another, over -180 up to 180."""
    x = F.pmod(after - before, _d(360.0))
    return F.when(x > 180.0, x - 360.0).otherwise(x)


def turn_class(angle: Column) -> Column:
    a = F.abs(angle)
    return F.when(a < 60, "slight").when(a < 130, "plain").otherwise("sharp")


def project(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """(t, metres): the nearest place on a segment, t clamped to 0..1; plane coordinates."""
    dx, dy = bx - ax, by - ay
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.greatest(_d(0.0), F.least(_d(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(size > 0, size)))).otherwise(_d(0.0))
    x, y = px - (ax + t * dx), py - (ay + t * dy)
    return F.struct(t.alias("t"), F.sqrt(x * x + y * y).alias("metres"))


def plane(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Metres east and north of a place."""
    return (lon - _d(lon0)) * _d(DEGREE * math.cos(math.radians(lat0))), (lat - _d(lat0)) * _d(DEGREE)


def crosses(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """Whether two segments cross properly."""
    side = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    one = side(ax, ay, bx, by, cx, cy) * side(ax, ay, bx, by, dx, dy) < 0
    two = side(cx, cy, dx, dy, ax, ay) * side(cx, cy, dx, dy, bx, by) < 0
    return one & two


def cell(lat: Column, lon: Column, step_lat: float, step_lon: float) -> tuple[Column, Column]:
    return F.floor(lat / _d(step_lat)).cast("int"), F.floor(lon / _d(step_lon)).cast("int")


def fixed(x: Column, scale: int = 1_000_000) -> Column:
    return F.round(x * _d(scale)).cast("int")


def tile_x(lon: Column, zoom: int) -> Column:
    return F.floor((lon + 180.0) / 360.0 * _d(1 << zoom)).cast("int")


def tile_y(lat: Column, zoom: int) -> Column:
    r = F.radians(lat)
    return F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / _d(math.pi)) / 2 * _d(1 << zoom)).cast("int")


def balanced_score(walk_m: Column, minutes: Column, detoured: Column) -> Column:
    return walk_m + 2.0 * minutes + F.when(detoured, 150.0).otherwise(0.0)


def merged_width(base: float, n: Column) -> Column:
    return _d(base) * F.least(1 + 0.4 * (n - 1), _d(3.0))


def derived_speed(metres: Column, seconds: Column) -> Column:
    """Metres a second from the fix before; -1 without one, too soon after it, or too long."""
    return F.coalesce(F.when(seconds.between(0.5, 30.0), metres / seconds), _d(-1.0))


def moving_like_a_vehicle(trail: Column, t: Column, along: Column, least_seconds: float = 6.0, speed: float = 7.5) -> Column:
    """Whether some span from a sample of `trail` (array<struct<t, along>>) until now is long and fast enough."""
    return F.exists(trail, lambda x: (t - x["t"] >= least_seconds) & ((along - x["along"]) / (t - x["t"]) >= speed))


def me_heading(speed: Column, course: Column, compass: Column, at_rest: bool = True) -> Column:
    """The course when moving, else the compass; without one the course, if it may stand in `at_rest`, or nothing."""
    return F.when(speed >= 4.0, course).otherwise(F.coalesce(compass, course) if at_rest else compass)
