"""Geometry on longitude and latitude, and on small polygons, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0


def _col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def utm_epsg(lon: str | Column, lat: str | Column) -> Column:
    """EPSG code of the UTM zone of a point."""
    zone = F.floor((_col(lon) + 180) / 6) + 1
    return (F.when(_col(lat) < 0, 32700).otherwise(32600) + zone).cast("int")


def bearing(dx: str | Column, dy: str | Column) -> Column:
    """Compass direction of a step east ``dx`` and north ``dy``, in degrees from 0 to 360."""
    return F.pmod(F.degrees(F.atan2(_col(dx), _col(dy))), F.lit(360.0))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(_col(lat1)), F.radians(_col(lat2))
    dp, dl = p2 - p1, F.radians(_col(lon2)) - F.radians(_col(lon1))
    a = F.sin(dp / 2) ** 2 + F.cos(p1) * F.cos(p2) * F.sin(dl / 2) ** 2
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


_N = (1 / 298.257223563) / (2 - 1 / 298.257223563)
_RADIUS = 0.9996 * 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)


def _series(terms: list[float], f) -> Column:
    return sum((t * f(2 * (j + 1)) for j, t in enumerate(terms)), F.lit(0.0))


def utm_forward(lon: str | Column, lat: str | Column, epsg: Column | None = None) -> Column:
    """Easting and northing on WGS 84 in the zone of ``epsg``, by default the point's own: Krueger's series to the fourth order."""
    n, lon, lat = _N, _col(lon), _col(lat)
    epsg = utm_epsg(lon, lat) if epsg is None else epsg
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    lam = F.radians(lon - (epsg % 100 * 6 - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east = eta + _series(alpha, lambda k: F.cos(k * xi) * F.sinh(k * eta))
    north = xi + _series(alpha, lambda k: F.sin(k * xi) * F.cosh(k * eta))
    return F.struct((500000 + _RADIUS * east).alias("x"), (F.when(epsg >= 32700, 1e7).otherwise(0.0) + _RADIUS * north).alias("y"))


def utm_inverse(x: str | Column, y: str | Column, epsg: Column) -> Column:
    """Longitude and latitude of an easting and northing in a zone, by the inverse series."""
    n = _N
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    xi, eta = (_col(y) - F.when(epsg >= 32700, 1e7).otherwise(0.0)) / _RADIUS, (_col(x) - 500000) / _RADIUS
    xi1 = xi - _series(beta, lambda k: F.sin(k * xi) * F.cosh(k * eta))
    eta1 = eta - _series(beta, lambda k: F.cos(k * xi) * F.sinh(k * eta))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi + _series(delta, lambda k: F.sin(k * chi))
    lon = F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + epsg % 100 * 6 - 183
    return F.struct(lon.alias("lon"), F.degrees(lat).alias("lat"))


def parse_polygon(text: str | Column) -> Column:
    """Array of points from ``x,y;x,y;...``."""
    def point(p: Column) -> Column:
        return F.struct(F.split_part(p, F.lit(","), F.lit(1)).try_cast("double").alias("x"), F.split_part(p, F.lit(","), F.lit(2)).try_cast("double").alias("y"))

    return F.transform(F.filter(F.split(_col(text), ";"), lambda p: F.trim(p) != ""), point)


def polygon_area(points: str | Column) -> Column:
    """Area of a simple polygon (shoelace); 0 below three points."""
    p = _col(points)
    turns = F.transform(p, lambda a, i: F.struct(a.alias("a"), F.get(p, (i + 1) % F.size(p)).alias("b")))
    twice = F.aggregate(turns, F.lit(0.0), lambda s, t: s + t["a"]["x"] * t["b"]["y"] - t["b"]["x"] * t["a"]["y"])
    return F.when(F.size(p) < 3, 0.0).otherwise(F.abs(twice) / 2)


def hull_iou(a: str | Column, b: str | Column) -> Column:
    """Intersection over union of the upright rectangles around two polygons; 0 if the union is empty."""
    def box(p: Column) -> tuple[Column, ...]:
        xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
        return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)

    ax, ay, aX, aY = box(_col(a))
    bx, by, bX, bY = box(_col(b))
    inter = F.greatest(F.lit(0.0), F.least(aX, bX) - F.greatest(ax, bx)) * F.greatest(F.lit(0.0), F.least(aY, bY) - F.greatest(ay, by))
    union = (aX - ax) * (aY - ay) + (bX - bx) * (bY - by) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)

