"""Measures of rectangles and of rings (``array<struct<x, y>>``, closed) as column expressions, and the HK80 grid."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-6


def box_area(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x2 - x1) * (y2 - y1)


def box_perimeter(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return 2 * ((x2 - x1) + (y2 - y1))


def compactness(area: Column, perimeter: Column) -> Column:
    return 4 * math.pi * area / (perimeter * perimeter + EPSILON)


def point_box_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = F.greatest(x1 - px, px - x2, F.lit(0.0)), F.greatest(y1 - py, py - y2, F.lit(0.0))
    return F.sqrt(dx * dx + dy * dy)


def point_distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def overlap_area(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _edges(ring: Column) -> Column:
    n = F.size(ring)
    return F.transform(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), lambda p, i: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), F.get(ring, i + 1)["x"].alias("x2"), F.get(ring, i + 1)["y"].alias("y2")))


def ring_area(ring: Column) -> Column:
    """Shoelace area of a closed ring, whichever way it turns."""
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda a, e: a + (e["x1"] * e["y2"] - e["x2"] * e["y1"]))) / 2


def ring_perimeter(ring: Column) -> Column:
    return F.aggregate(_edges(ring), F.lit(0.0), lambda a, e: a + point_distance(e["x1"], e["y1"], e["x2"], e["y2"]))


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Ray casting: whether a point is within a closed ring."""
    crosses = lambda e: ((e["y1"] > py) != (e["y2"] > py)) & (px < (e["x2"] - e["x1"]) * (py - e["y1"]) / (e["y2"] - e["y1"] + F.when(e["y2"] == e["y1"], 1.0).otherwise(0.0)) + e["x1"])
    return F.size(F.filter(_edges(ring), crosses)) % 2 == 1


def ring_distance(px: Column, py: Column, ring: Column) -> Column:
    """Distance of a point to a ring's boundary; 0 within it."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        long = dx * dx + dy * dy
        t = F.when(long == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - e["x1"]) * dx + (py - e["y1"]) * dy) / F.when(long == 0, 1.0).otherwise(long))))
        return point_distance(px, py, e["x1"] + t * dx, e["y1"] + t * dy)

    return F.when(in_ring(px, py, ring), 0.0).otherwise(F.array_min(F.transform(_edges(ring), to_edge)))


def valid_ring(ring: Column) -> Column:
    """At least four points, all finite, closed."""
    bad = F.exists(ring, lambda p: p["x"].isNull() | p["y"].isNull() | F.isnan(p["x"]) | F.isnan(p["y"]) | (F.abs(p["x"]) == float("inf")) | (F.abs(p["y"]) == float("inf")))
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    return F.coalesce((F.size(ring) >= 4) & ~bad & (first["x"] == last["x"]) & (first["y"] == last["y"]), F.lit(False))


# The published definition of the HK80 grid (transverse Mercator on the International 1924 ellipsoid).
_A, _F, _LAT0, _LON0, _N0, _E0 = 6378388.0, 1 / 297.0, math.radians(22 + 18 / 60 + 43.68 / 3600), math.radians(114 + 10 / 60 + 42.80 / 3600), 819069.80, 836694.05


def _arc(lat):
    e2 = 2 * _F - _F * _F
    sin = F.sin if isinstance(lat, Column) else np.sin if isinstance(lat, np.ndarray) else math.sin
    a0, a2, a4 = 1 - e2 / 4 - 3 * e2 * e2 / 64, 3 / 8 * (e2 + e2 * e2 / 4), 15 / 256 * e2 * e2
    return _A * (a0 * lat - a2 * sin(2 * lat) + a4 * sin(4 * lat))


def to_grid(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres of degrees on the grid's own datum."""
    e2 = 2 * _F - _F * _F
    p, d = F.radians(lat), F.radians(lon) - _LON0
    nu = _A / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    psi = (1 - e2 * F.sin(p) * F.sin(p)) / (1 - e2)
    t, c = F.tan(p), F.cos(p)
    north = _N0 + _arc(p) - _arc(_LAT0) + nu * F.sin(p) * d * d / 2 * c
    east = _E0 + nu * d * c + nu * d * d * d / 6 * c * c * c * (psi - t * t)
    return east, north


# WGS84's ellipsoid, and the published shift (metres), turn (seconds of arc) and scale (millionths) from HK80 to WGS84.
_WGS_A, _WGS_F = 6378137.0, 1 / 298.257223563
_SHIFT, _TURN, _SCALE = (-162.619, -276.959, -161.764), (0.067753, -2.243649, -1.158827), -1.094246


def wgs84_to_grid(lon: Column, lat: Column) -> tuple[Column, Column]:
    """(easting, northing) in metres of WGS84 degrees: through geocentric coordinates to the grid's datum, then projected."""
    e2 = 2 * _WGS_F - _WGS_F * _WGS_F
    p, d = F.radians(lat), F.radians(lon)
    nu = _WGS_A / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    m = 1 + _SCALE * 1e-6
    x, y, z = ((c - t) / m for c, t in zip((nu * F.cos(p) * F.cos(d), nu * F.cos(p) * F.sin(d), nu * (1 - e2) * F.sin(p)), _SHIFT))
    rx, ry, rz = (math.radians(s / 3600) for s in _TURN)
    x, y, z = x + rz * y - ry * z, y - rz * x + rx * z, z + ry * x - rx * y
    # geodetic latitude by Bowring's formula, exact to well below a millimetre on the ground
    e2, b = 2 * _F - _F * _F, _A * (1 - _F)
    flat = F.sqrt(x * x + y * y)
    t = F.atan2(z * _A, flat * b)
    out = F.atan2(z + e2 / (1 - e2) * b * F.pow(F.sin(t), 3), flat - e2 * _A * F.pow(F.cos(t), 3))
    return to_grid(F.degrees(F.atan2(y, x)), F.degrees(out))


def _forward(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """wgs84_to_grid of arrays of radians."""
    e2 = 2 * _WGS_F - _WGS_F * _WGS_F
    nu = _WGS_A / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    x = np.stack([nu * np.cos(lat) * np.cos(lon), nu * np.cos(lat) * np.sin(lon), nu * (1 - e2) * np.sin(lat)])
    x = _turned() @ ((x - np.array(_SHIFT)[:, None]) / (1 + _SCALE * 1e-6))
    d, p = _geodetic(x, _A, _F)
    e2, d = 2 * _F - _F * _F, d - _LON0
    nu = _A / np.sqrt(1 - e2 * np.sin(p) ** 2)
    psi, t, c = (1 - e2 * np.sin(p) ** 2) / (1 - e2), np.tan(p), np.cos(p)
    north = _N0 + _arc(p) - _arc(_LAT0) + nu * np.sin(p) * d * d / 2 * c
    return _E0 + nu * d * c + nu * d**3 / 6 * c**3 * (psi - t * t), north


def _turned() -> np.ndarray:
    rx, ry, rz = (math.radians(s / 3600) for s in _TURN)
    return np.array([[1, rz, -ry], [-rz, 1, rx], [ry, -rx, 1]])


def _geodetic(x: np.ndarray, a: float, f: float) -> tuple[np.ndarray, np.ndarray]:
    """(longitude, latitude) in radians of geocentric coordinates, by Bowring's formula."""
    e2, b = 2 * f - f * f, a * (1 - f)
    flat = np.hypot(x[0], x[1])
    t = np.arctan2(x[2] * a, flat * b)
    return np.arctan2(x[1], x[0]), np.arctan2(x[2] + e2 / (1 - e2) * b * np.sin(t) ** 3, flat - e2 * a * np.cos(t) ** 3)


def degrees_of(east: np.ndarray, north: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(longitude, latitude) in WGS84 degrees of places on the grid.

    The latitude at which the meridian's arc is as long as the northing (the footpoint) is found by iteration; the inverse series
    leads from there to the place, and the shift between the datums is undone. What then is left between the place and what
    wgs84_to_grid makes of the degrees, millimetres as the series end and heights are not known, is taken out in three steps.
    """
    e2 = 2 * _F - _F * _F
    m = north - _N0 + _arc(_LAT0)
    p = m / _A
    for _ in range(6):
        p = p + (m - _arc(p)) * (1 - e2 * np.sin(p) ** 2) ** 1.5 / (_A * (1 - e2))
    w = 1 - e2 * np.sin(p) ** 2
    nu, rho = _A / np.sqrt(w), _A * (1 - e2) / w**1.5
    psi, t, d = nu / rho, np.tan(p), east - _E0
    lon = _LON0 + (d / nu - d**3 / (6 * nu**3) * (psi + 2 * t * t)) / np.cos(p)
    lat = p - t / (rho * nu) * d * d / 2
    nu = _A / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    x = np.stack([nu * np.cos(lat) * np.cos(lon), nu * np.cos(lat) * np.sin(lon), nu * (1 - e2) * np.sin(lat)])
    lon, lat = _geodetic(np.linalg.inv(_turned()) @ x * (1 + _SCALE * 1e-6) + np.array(_SHIFT)[:, None], _WGS_A, _WGS_F)
    for _ in range(3):
        x, y = _forward(lon, lat)
        lon, lat = lon + (east - x) / (_A * np.cos(lat)), lat + (north - y) / _A
    return np.degrees(lon), np.degrees(lat)


def grid_to_wgs84(east: Column, north: Column) -> Column:
    """``struct(lon, lat)`` in WGS84 degrees of eastings and northings; null where either is."""

    @F.arrow_udf("struct<lon:double,lat:double>")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        none = np.asarray(x.is_null()) | np.asarray(y.is_null())
        lon, lat = degrees_of(*(np.asarray(c.cast(pa.float64()).fill_null(start)) for c, start in ((x, _E0), (y, _N0))))
        return pa.StructArray.from_arrays([pa.array(lon), pa.array(lat)], ["lon", "lat"], mask=pa.array(none))

    return run(east, north)
