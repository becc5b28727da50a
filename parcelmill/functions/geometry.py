"""Planar geometry and map projections as column expressions.

A polygon is an array of closed rings, a ring an array of {x, y} points. Holes
run opposite to their outer ring, so signed ring areas add up.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
SPHERE_RADIUS_M = 6378137.0


def edges(rings: Column) -> Column:
    """All ring edges as an array of {ax, ay, bx, by}."""

    def of_ring(r: Column) -> Column:
        n = F.greatest(F.size(r) - 1, F.lit(0))
        return F.zip_with(
            F.slice(r, F.lit(1), n),
            F.slice(r, F.lit(2), n),
            lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")),
        )

    return F.flatten(F.transform(rings, of_ring))


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, e: acc + f(e))


def _cross(e: Column) -> Column:
    return e["ax"] * e["by"] - e["bx"] * e["ay"]


def area(rings: Column) -> Column:
    return F.abs(_sum(edges(rings), _cross)) / 2.0


def perimeter(rings: Column) -> Column:
    return _sum(edges(rings), lambda e: F.hypot(e["bx"] - e["ax"], e["by"] - e["ay"]))


def centroid(rings: Column) -> Column:
    """Area centroid as {x, y}."""
    e = edges(rings)
    twice = _sum(e, _cross)
    x = _sum(e, lambda k: (k["ax"] + k["bx"]) * _cross(k)) / (3.0 * twice)
    y = _sum(e, lambda k: (k["ay"] + k["by"]) * _cross(k)) / (3.0 * twice)
    return F.struct(x.alias("x"), y.alias("y"))


def bbox(rings: Column) -> Column:
    """Bounds as {x0, y0, x1, y1}."""
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(
        F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1")
    )


def rings_valid(rings: Column) -> Column:
    """Every ring is closed, has four points or more and no missing coordinate."""

    def ok(r: Column) -> Column:
        closed = F.try_element_at(r, F.lit(1)).eqNullSafe(F.try_element_at(r, F.lit(-1)))
        known = F.forall(r, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
        return (F.size(r) >= 4) & closed & known

    return (F.size(rings) > 0) & F.forall(rings, ok)


def box_rings(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Rectangle as one counter-clockwise ring."""

    def p(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    return F.array(F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1), p(x0, y0)))


def contains_point(edge_list: Column, x: Column, y: Column) -> Column:
    """Even-odd test: how many edges does a ray to the right cross?"""

    def crosses(e: Column) -> Column:
        spans = (e["ay"] > y) != (e["by"] > y)
        at = (e["bx"] - e["ax"]) * (y - e["ay"]) / (e["by"] - e["ay"]) + e["ax"]
        return F.when(spans, F.when(x < at, 1).otherwise(0)).otherwise(0)

    return F.aggregate(edge_list, F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1


def segment_distance(e: Column, x: Column, y: Column) -> Column:
    dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, ((x - e["ax"]) * dx + (y - e["ay"]) * dy) / length2).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.hypot(x - (e["ax"] + t * dx), y - (e["ay"] + t * dy))


def point_distance(edge_list: Column, x: Column, y: Column) -> Column:
    """Distance from a point to a polygon, 0 inside."""
    outside = F.aggregate(edge_list, F.lit(float("inf")), lambda d, e: F.least(d, segment_distance(e, x, y)))
    return F.when(contains_point(edge_list, x, y), F.lit(0.0)).otherwise(outside)


def starts(rings: Column) -> Column:
    """The first corner of every ring."""
    return F.transform(rings, lambda r: r[0])


def box_distance(x: Column, y: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Distance from a point to a rectangle, 0 inside."""
    dx = F.greatest(x0 - x, F.lit(0.0), x - x1)
    dy = F.greatest(y0 - y, F.lit(0.0), y - y1)
    return F.sqrt(dx * dx + dy * dy)


def box_overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Overlap area of two rectangles given as (x0, y0, x1, y1)."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    x = F.radians(lon) * SPHERE_RADIUS_M
    y = F.log(F.tan(math.pi / 4 + F.radians(lat) / 2)) * SPHERE_RADIUS_M
    return x, y


def from_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    lon = F.degrees(x / SPHERE_RADIUS_M)
    lat = F.degrees(2 * F.atan(F.exp(y / SPHERE_RADIUS_M)) - math.pi / 2)
    return lon, lat


# The northern state-plane zone (two standard parallels, GRS80, US feet).
_LCC = {"lat1": 48 + 44 / 60, "lat2": 47.5, "lat0": 47.0, "lon0": -(120 + 50 / 60), "x0": 500000.0, "y0": 0.0}
_GRS80_A, _GRS80_F = 6378137.0, 1 / 298.257222101
_US_FOOT = 1200 / 3937
_ECC = math.sqrt(_GRS80_F * (2 - _GRS80_F))


def _lcc_constants() -> tuple[float, float, float]:
    def m(phi: float) -> float:
        return math.cos(phi) / math.sqrt(1 - (_ECC * math.sin(phi)) ** 2)

    def t(phi: float) -> float:
        s = _ECC * math.sin(phi)
        return math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (_ECC / 2)

    p1, p2, p0 = (math.radians(_LCC[k]) for k in ("lat1", "lat2", "lat0"))
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    return n, f, _GRS80_A * f * t(p0) ** n


def to_state_plane(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Lambert conformal conic easting and northing in US feet."""
    n, f, rho0 = _lcc_constants()
    phi = F.radians(lat)
    s = _ECC * F.sin(phi)
    t = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(_ECC / 2))
    rho = _GRS80_A * f * F.pow(t, F.lit(n))
    theta = n * F.radians(lon - _LCC["lon0"])
    x = (rho * F.sin(theta) + _LCC["x0"]) / _US_FOOT
    y = (rho0 - rho * F.cos(theta) + _LCC["y0"]) / _US_FOOT
    return x, y


def from_state_plane(x: Column, y: Column, rounds: int = 5) -> tuple[Column, Column]:
    n, f, rho0 = _lcc_constants()
    dx, dy = x * _US_FOOT - _LCC["x0"], rho0 - (y * _US_FOOT - _LCC["y0"])
    t = F.pow(F.sqrt(dx * dx + dy * dy) / (_GRS80_A * f), F.lit(1 / n))
    phi = math.pi / 2 - 2 * F.atan(t)
    for _ in range(rounds):
        s = _ECC * F.sin(phi)
        phi = math.pi / 2 - 2 * F.atan(t * F.pow((1 - s) / (1 + s), F.lit(_ECC / 2)))
    return F.degrees(F.atan2(dx, dy)) / n + _LCC["lon0"], F.degrees(phi)


def reproject(x: Column, y: Column, source: int, target: int) -> tuple[Column, Column]:
    """Coordinates between 4326, 3857 and 2926."""
    if source == target:
        return x, y
    into = {4326: lambda a, b: (a, b), 3857: from_mercator, 2926: from_state_plane}
    out = {4326: lambda a, b: (a, b), 3857: to_mercator, 2926: to_state_plane}
    if source not in into or target not in out:
        raise ValueError(f"unknown reference system {source} or {target}")
    return out[target](*into[source](x, y))
