"""Shapes of several parts, with holes and of many corners, against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelmill.operators import overlay as ov
from parcelmill.operators import pieces as pc

RINGS = "array<array<struct<x:double,y:double>>>"


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in [*pts, pts[0]]]


def box(x, y, w, h=None):
    h = h or w
    return ring((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def layer(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, rings {RINGS}")


def test_second_part_counts(spark):
    """The second part of the parcel lies inside the zone, the first one far away."""
    parcel = layer(spark, [(1, [box(50, 50, 1), box(1, 1, 1)])], "parcel_id")
    zone = layer(spark, [(9, [box(0, 0, 4)])], "zone_id")
    assert ov.intersects(parcel, zone, 1.0).first()["val"] is True
    assert ov.overlap_area(parcel, zone, 1.0).first()["val"] == pytest.approx(1.0)
    assert ov.parcels_within(parcel, zone, 0.1, 1.0).first()["val"] is True
    assert ov.nearest_shapes(parcel, ov.shape_features(zone, "zone_id", True)).first()["distance"] == 0
    assert ov.filter_intersecting(parcel, zone, 1.0, "parcel_id").count() == 1
    # The other way round: the zone has the two parts.
    assert ov.intersects(layer(spark, [(1, [box(0, 0, 4)])], "parcel_id"), layer(spark, [(9, [box(50, 50, 1), box(1, 1, 1)])], "zone_id"), 1.0).first()["val"] is True


def test_holes_on_both_sides(spark):
    holed = [box(0, 0, 10), box(2, 2, 6)[::-1]]
    inside, across = [box(4, 4, 1)], [box(1, 1, 8), box(3, 3, 4)[::-1]]
    zone = layer(spark, [(9, holed)], "zone_id")
    parcels = layer(spark, [(1, inside), (2, across)], "parcel_id")
    assert {r[0]: r[1] for r in ov.intersects(parcels, zone, 1.0).collect()} == {1: None, 2: True}
    areas = {r[0]: r[1] for r in ov.overlap_area(parcels, zone, 1.0).collect()}
    assert areas[1] is None and areas[2] == pytest.approx(64 - 36)
    assert {r["parcel_id"]: r["distance"] for r in ov.nearest_shapes(parcels, ov.shape_features(zone, "zone_id", True)).collect()} == {1: 2.0, 2: 0.0}
    back = layer(spark, [(1, holed)], "parcel_id")
    assert ov.intersects(back, layer(spark, [(8, inside)], "zone_id"), 1.0).first()["val"] is None


def star(rng, x, y, n, lo, hi):
    angle = np.sort(rng.uniform(0, 2 * math.pi, n))
    reach = rng.uniform(lo, hi, n)
    return list(zip((x + reach * np.cos(angle)).tolist(), (y + reach * np.sin(angle)).tolist(), strict=True))


def _edges(rings):
    paths = [np.array([(p["x"], p["y"]) for p in r]) for r in rings]
    return np.concatenate([np.concatenate([p[:-1], p[1:]], axis=1) for p in paths])


def _inside(edges, x, y):
    odd = 0
    for ax, ay, bx, by in edges.tolist():
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd ^= 1
    return bool(odd)


@pytest.fixture(scope="module")
def big():
    """A bent polygon of 3,000 corners with a hole of 900 and a part of 500."""
    rng = np.random.default_rng(2)
    return [ring(*star(rng, 0, 0, 3000, 6, 10)), ring(*star(rng, 0, 0, 900, 2, 4)[::-1]), ring(*star(rng, 30, 0, 500, 1, 3))]


def test_pieces_cover_the_polygon(big):
    edges = _edges(big)
    pieces = list(pc.cut_polygon(edges, 64))
    assert len(pieces) > 80 and max(sum(len(r) - 1 for r in p) for p in pieces) <= 64
    signed = lambda e: float((e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1]).sum() / 2)
    parts = [np.concatenate([np.concatenate([np.array(r[:-1]), np.array(r[1:])], axis=1) for r in p]) for p in pieces]
    assert sum(map(signed, parts)) == pytest.approx(signed(edges), rel=1e-12) and min(map(signed, parts)) > 0
    rng = random.Random(1)
    for _ in range(150):
        x, y = rng.uniform(-10, 33), rng.uniform(-10, 10)
        assert sum(_inside(p, x, y) for p in parts) == _inside(edges, x, y)


def test_large_polygons_in_joins(spark, big):
    rng = random.Random(7)
    edges = _edges(big)
    zone = layer(spark, [(9, big), (8, [box(100, 100, 1)])], "zone_id")
    assert pc.subdivide(zone)[1] and not pc.subdivide(zone.where("zone_id = 8"))[1]
    spots = [(i, rng.uniform(-11, 33), rng.uniform(-11, 11)) for i in range(300)]
    points = spark.createDataFrame(spots, "parcel_id long, x double, y double")
    held = [r["parcel_id"] for r in ov.contains_join(ov.as_points(points), zone, 2.0).collect()]
    assert sorted(held) == [i for i, x, y in spots if _inside(edges, x, y)]
    lots = [(i, x, y, rng.choice([0.2, 1.0, 4.0])) for i, x, y in spots[:80]] + [(999, -20.0, -20.0, 60.0)]
    parcels = layer(spark, [(i, [box(x, y, s)]) for i, x, y, s in lots], "parcel_id")
    whole = {i: ov.area_within(_edges([box(x, y, s)]), [edges]) for i, x, y, s in lots}
    got = {r["parcel_id"]: r["overlap"] for r in ov.overlap_pairs(parcels, zone, 2.0).where("zone_id = 9").collect()}
    assert {i for i, v in whole.items() if v > 1e-9} <= set(got) and got[999] == pytest.approx(whole[999])
    assert all(got.get(i, 0.0) == pytest.approx(v, abs=1e-9) for i, v in whole.items())
    far = {r["parcel_id"]: r["distance"] for r in ov.nearest_shapes(parcels, ov.shape_features(zone.where("zone_id = 9"), "zone_id", True)).collect()}
    line = {r["parcel_id"]: r["distance"] for r in ov.nearest_shapes(parcels, ov.shape_features(zone.where("zone_id = 9"), "zone_id", False)).collect()}
    for i, x, y, s in lots[:25]:
        square = [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
        sides = list(zip(square, square[1:] + square[:1], strict=True))
        gap = min(min(_gap(p, (a, b), (c, d)) for p in square for a, b, c, d in edges), min(_gap((a, b), *side) for a, b, _, _ in edges for side in sides))
        crossed = whole[i] > 0 and whole[i] < s * s - 1e-9
        assert far[i] == pytest.approx(0.0 if whole[i] > 0 else gap, abs=1e-9)
        assert line[i] == pytest.approx(0.0 if crossed else gap, abs=1e-9)
    near = {r["parcel_id"] for r in ov.parcels_within(parcels, zone, 0.7, 2.0).where("val").collect()}
    assert near == {i for i, d in far.items() if d <= 0.7}
    edge_of = {r["parcel_id"]: r["distance"] for r in ov.within(ov.as_points(points), zone, 0.5, 2.0).collect()}
    assert set(held) <= set(edge_of) and max(edge_of.values()) <= 0.5


def _gap(p, a, b):
    (px, py), (ax, ay), (bx, by) = p, a, b
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / n)) if n else 0.0
    return math.hypot(px - ax - t * dx, py - ay - t * dy)


def test_attribute_of_the_nearest_line(spark):
    lines = spark.createDataFrame([(1, "slow", [[{"x": 0.0, "y": 5.0}, {"x": 9.0, "y": 5.0}]]), (2, "fast", [[{"x": 0.0, "y": 7.0}, {"x": 9.0, "y": 7.0}]])], f"id long, kind string, rings {RINGS}")
    parcel = layer(spark, [(1, [box(1, 1, 1)])], "parcel_id")
    row = ov.nearest_shape_fact(parcel, lines, "id", "kind").first()
    assert (row["feature_id"], row["distance"], row["attribute"]) == (1, 3.0, "slow")
    assert ov.nearest_shape_fact(parcel, lines, "id", "kind", F.col("kind") == "fast").first()["distance"] == 5.0
