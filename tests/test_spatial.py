import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelmill.functions import geometry as gm
from parcelmill.operators import facts as fc
from parcelmill.operators import grid as gr
from parcelmill.operators import near
from parcelmill.operators import overlay as ov
from parcelmill.operators import raster as ra

POINT = "array<array<struct<x:double,y:double>>>"


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def layer(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, rings {POINT}")


SQUARE = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0))
HOLE = ring((1, 1), (1, 2), (2, 2), (2, 1), (1, 1))
ELL = ring((0, 0), (4, 0), (4, 1), (1, 1), (1, 4), (0, 4), (0, 0))


def test_area_centroid_hole(spark):
    df = layer(spark, [(1, [SQUARE, HOLE]), (2, [ELL])], "parcel_id")
    got = {r[0]: (r[1], r[2]) for r in df.select("parcel_id", gm.area(F.col("rings")), gm.perimeter(F.col("rings"))).collect()}
    assert got == {1: (15.0, 20.0), 2: (7.0, 16.0)}


def test_point_in_polygon_with_hole(spark):
    poly = layer(spark, [(1, [SQUARE, HOLE])], "zone_id")
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 5.0, 1.0), (4, 3.9, 3.9)], "parcel_id long, x double, y double")
    got = {r["parcel_id"] for r in ov.contains_join(ov.as_points(pts), poly, 1.0).collect()}
    assert got == {1, 4}


def test_overlap_of_concave_and_touching(spark):
    parcels = layer(spark, [(1, [ring((2, 2), (6, 2), (6, 6), (2, 6), (2, 2))]), (2, [ring((4, 0), (5, 0), (5, 1), (4, 1), (4, 0))])], "parcel_id")
    got = {r["parcel_id"]: r["val"] for r in ov.overlap_area(parcels, layer(spark, [(9, [SQUARE])], "zone_id"), 1.0).collect()}
    assert got[1] == pytest.approx(4.0) and got[2] == pytest.approx(0.0)
    concave = {r["parcel_id"]: r["val"] for r in ov.overlap_area(parcels, layer(spark, [(9, [ELL])], "zone_id"), 1.0).collect()}
    assert concave[1] is None and concave[2] == pytest.approx(0.0)
    wide = layer(spark, [(1, [ring((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))])], "parcel_id")
    assert ov.overlap_area(wide, layer(spark, [(9, [ELL])], "zone_id"), 1.0).first()["val"] == pytest.approx(3.0)
    holed = ov.overlap_area(wide, layer(spark, [(9, [SQUARE, HOLE])], "zone_id"), 1.0).first()["val"]
    assert holed == pytest.approx(3.0)


def test_boxes_of_every_size_pair_once(spark):
    rnd = random.Random(5)
    boxes = [(i, x, y, x + s, y + s) for i in range(60) for x, y, s in [(rnd.uniform(-50, 50), rnd.uniform(-50, 50), rnd.choice([0.0, 0.2, 3, 40]))]]
    side = {}
    for p, rows in (("l_", boxes[:30]), ("r_", boxes[30:])):
        df = spark.createDataFrame(rows, f"{p}id long, a double, b double, d double, e double")
        side[p] = gr.box_of(df, F.col("a"), F.col("b"), F.col("d"), F.col("e"), p).drop("a", "b", "d", "e")
    got = sorted((r["l_id"], r["r_id"]) for r in gr.cell_pairs(side["l_"], side["r_"], 0.5, hot_rows=5).collect())
    want = sorted(
        (a[0], b[0]) for a, b in itertools.product(boxes[:30], boxes[30:]) if a[1] <= b[3] and b[1] <= a[3] and a[2] <= b[4] and b[2] <= a[4]
    )
    assert got == want


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_equals_brute_force_with_hot_spot(spark, k):
    rnd = random.Random(11)
    feats = [(i, 3.0, 3.0) for i in range(2500)] + [(3000 + i, rnd.uniform(0, 100), rnd.uniform(0, 100)) for i in range(150)]
    pts = [(i, rnd.uniform(-20, 120), rnd.uniform(-20, 120)) for i in range(80)] + [(100 + i, 3.0, 3.0) for i in range(20)]
    f = gr.point_box(spark.createDataFrame(feats, "feature_id long, x double, y double")).drop("x", "y")
    got = gr.nearest(spark.createDataFrame(pts, "point_id long, x double, y double"), f, k)
    found = sorted((r["point_id"], r["rank"], r["feature_id"]) for r in got.collect())
    want = []
    for pid, x, y in pts:
        order = sorted(feats, key=lambda q: (math.hypot(q[1] - x, q[2] - y), q[0]))[:k]
        want += [(pid, i, q[0]) for i, q in enumerate(order, 1)]
    assert found == sorted(want)


def _nearest_by_hand(pts, feats, k, within):
    want = []
    for pid, x, y, use in pts:
        near = sorted((math.sqrt((fx - x) * (fx - x) + (fy - y) * (fy - y)), fid) for fid, fx, fy, own in feats if own == use)[:k]
        want += [(pid, i, fid) for i, (d, fid) in enumerate(near, 1) if d <= within]
    return sorted(want)


@pytest.mark.parametrize("most, k, within", [(20_000, 3, 9.0), (20_000, 1, 1000.0), (30, 3, 9.0)])
def test_nearest_within_a_distance(spark, monkeypatch, most, k, within):
    rnd = random.Random(5)
    monkeypatch.setattr(near, "MAX_TILE_FEATURES", most)  # tiles beyond it go by the pyramid
    monkeypatch.setattr(near, "CHUNK_POINTS", 16)
    spot = lambda n: (rnd.gauss(0, 0.5), rnd.gauss(0, 0.5)) if n % 3 == 0 else (rnd.uniform(-60, 60), rnd.uniform(-5, 5))
    feats = [(i, *spot(i), "ab"[i % 5 == 0]) for i in range(600)] + [(900, 0.0, 0.0, "c")]
    pts = [(i, *spot(i), "abc"[i % 3]) for i in range(150)] + [(200, 90.0, 90.0, "a"), (201, 0.0, 0.0, "none")]
    f = gr.point_box(spark.createDataFrame(feats, "feature_id long, x double, y double, use string")).drop("x", "y")
    found = gr.nearest(spark.createDataFrame(pts, "point_id long, x double, y double, use string"), f, k, by=["use"], within=within)
    assert sorted((r["point_id"], r["rank"], r["feature_id"]) for r in found.collect()) == _nearest_by_hand(pts, feats, k, within)


def test_nearest_polygon_by_reach(spark, monkeypatch):
    rnd = random.Random(8)
    boxes = [(i, rnd.uniform(-20, 20), rnd.uniform(-20, 20), rnd.choice([0.1, 1.0, 9.0])) for i in range(120)]
    rings = [(i, [ring((x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y))]) for i, x, y, s in boxes]
    pts = [(i, rnd.uniform(-25, 25), rnd.uniform(-25, 25)) for i in range(100)] + [(500, 300.0, -400.0), (501, 3000.0, 10.0)]
    used = []
    pairs = gr.cell_pairs
    monkeypatch.setattr(gr, "cell_pairs", lambda left, *a, **b: used.append(left.count()) or pairs(left, *a, **b))
    found = ov.nearest_polygon(spark.createDataFrame(pts, "parcel_id long, x double, y double"), layer(spark, rings, "zone_id"), "zone_id")
    got = {r["parcel_id"]: (r["feature_id"], r["distance"]) for r in found.collect()}
    gap = lambda p, b: math.hypot(max(b[1] - p[1], 0, p[1] - b[1] - b[3]), max(b[2] - p[2], 0, p[2] - b[2] - b[3]))
    want = {p[0]: min((gap(p, b), b[0]) for b in boxes) for p in pts}
    assert {k: v[0] for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert all(got[k][1] == pytest.approx(v[0]) for k, v in want.items())
    assert used and used[0] == 100  # all but the far ones meet polygons by their reach


def test_points_of_a_tile_share_their_search(spark):
    # No list of cells for each point: points and features meet by tile, without a window over pairs.
    rows = spark.range(4000).selectExpr("id AS point_id", "id % 64 * 1e0 AS x", "floor(id / 64) * 1e0 AS y")
    f = gr.point_box(rows.withColumnRenamed("point_id", "feature_id")).drop("x", "y")
    plan = gr.nearest(rows, f, 17, within=5.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Window" not in plan


def test_diagonal_neighbor_is_not_missed(spark):
    f = gr.point_box(spark.createDataFrame([(1, 1.0, 0.0), (2, 0.72, 0.72)], "feature_id long, x double, y double")).drop("x", "y")
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.02, 0.0)], "point_id long, x double, y double")
    assert {r["point_id"]: r["feature_id"] for r in gr.nearest(p, f).collect()} == {1: 1, 2: 1}


def test_plane_slope_and_aspect(spark):
    dem = spark.createDataFrame([(i, j, 2.0 * i + 1.0 * j) for i in range(5) for j in range(5)], "ix long, iy long, z double")
    mid = ra.slope_aspect(dem, 1.0).where("ix = 2 AND iy = 2").first()
    assert mid["slope"] == pytest.approx(math.degrees(math.atan(math.sqrt(5))))
    assert mid["aspect"] == pytest.approx(270 - math.degrees(math.atan(0.5)))  # downhill: west-south-west
    flat = spark.createDataFrame([(i, j, 1.0) for i in range(3) for j in range(3)], "ix long, iy long, z double")
    assert ra.slope_aspect(flat, 1.0).where("aspect IS NOT NULL").count() == 0


def test_hood_outline_and_projection(spark):
    pts = spark.createDataFrame([("a", float(x), float(y)) for x in range(5) for y in range(5)] + [("b", 1.0, 1.0)], "hood string, x double, y double")
    area = {r[0]: r[1] for r in ov.hood_outline(pts, "hood", pad=2.0).select("hood", gm.area(F.col("rings"))).collect()}
    assert area["a"] == pytest.approx(16.0) and area["b"] == pytest.approx(16 * 0.5 * 4 * math.sin(math.pi / 8))
    one = spark.createDataFrame([(-122.33, 48.42)], "lon double, lat double")
    x, y = gm.to_state_plane(F.col("lon"), F.col("lat"))
    back = gm.from_state_plane(F.col("x"), F.col("y"))
    row = one.select("*", x.alias("x"), y.alias("y")).select(*[v.alias(n) for v, n in zip(back, ("a", "b"))]).first()
    assert (row["a"], row["b"]) == (pytest.approx(-122.33), pytest.approx(48.42))


def _edges(points):
    return [{"ax": a[0], "ay": a[1], "bx": b[0], "by": b[1]} for a, b in zip(points, points[1:] + points[:1])]


def test_grown_shapes_keep_their_form():
    n = 32
    angle = 2 * np.pi * np.arange(n) / n
    circle = np.stack([np.cos(angle), np.sin(angle)], axis=1)
    square = lambda x, y, s: _edges([(x, y), (x + s, y), (x + s, y + s), (x, y + s)])
    caps = n / 2 * math.sin(2 * math.pi / n)
    assert ov.grown_overlap(square(-9, -9, 30), square(0, 0, 2), 0.5 * circle) == pytest.approx(4 + 4 * 2 * 0.5 + caps * 0.25)
    bent = _edges([(0, 0), (10, 0), (10, 1), (1, 1), (1, 10), (0, 10)])
    assert ov.grown_overlap(square(3, 3, 1), bent, 0.1 * circle) == 0
    assert ov.grown_overlap(square(3, 1.05, 1), bent, 0.1 * circle) == pytest.approx(0.05)
    ring_shaped = square(0, 0, 10) + _edges([(3, 3), (3, 7), (7, 7), (7, 3)])
    assert ov.grown_overlap(square(4, 4, 2), ring_shaped, 0.5 * circle) == 0
    assert ov.grown_overlap(square(4, 4, 2), ring_shaped, 1.5 * circle) == pytest.approx(3)


def test_bent_feature_has_no_overlap_in_its_hull(spark):
    bent = layer(spark, [(1, [ring((0, 0), (10, 0), (10, 1), (1, 1), (1, 10), (0, 10))])], "zone_id")
    lot = layer(spark, [(7, [ring((3, 3), (4, 3), (4, 4), (3, 4))])], "parcel_id")
    assert ov.buffer_overlap_area(lot, bent, 0.1, 1.0).first()["val"] is None


def test_buffer_overlap_and_fact_table(spark):
    parcels = layer(spark, [(1, [ring((5, 0), (7, 0), (7, 4), (5, 4), (5, 0))])], "parcel_id")
    zone = layer(spark, [(9, [SQUARE])], "zone_id")
    assert ov.buffer_overlap_area(parcels, zone, 2.0, 1.0, corners=256).first()["val"] == pytest.approx(4.0, rel=1e-2)
    manifest = [
        {"layer": "z", "metric": "buffer_intersects", "distance": 1.5, "field": "near"},
        {"layer": "z", "metric": "buffer_intersects", "distance": 0.5, "field": "very_near"},
        {"layer": "z", "metric": "boolean_overlay", "field": "on"},
    ]
    row = fc.build_facts(parcels.withColumns({"x": F.lit(6.0), "y": F.lit(2.0)}), {"z": zone}, manifest, 1.0).first()
    assert (row["near"], row["very_near"], row["on"]) == (True, None, None)
