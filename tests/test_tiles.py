"""Joins of shapes by tile against brute force: meetings, areas, distances, grown features, and rollups that read once."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelmill.functions.shapes import _compare
from parcelmill.operators import overlay as ov
from parcelmill.operators import rollups as ru
from parcelmill.operators import tiles as tl

RINGS = "array<array<struct<x:double,y:double>>>"


def ring(points):
    return [{"x": float(x), "y": float(y)} for x, y in [*points, points[0]]]


def box(x, y, w):
    return ring([(x, y), (x + w, y), (x + w, y + w), (x, y + w)])


def star(rng, x, y, n, lo, hi):
    angle = np.sort(rng.uniform(0, 2 * math.pi, n))
    reach = rng.uniform(lo, hi, n)
    return ring(list(zip(x + reach * np.cos(angle), y + reach * np.sin(angle), strict=True)))


def edges(rings):
    return [{"ax": p["x"], "ay": p["y"], "bx": q["x"], "by": q["y"]} for r in rings for p, q in zip(r, r[1:], strict=False)]


def table(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, rings {RINGS}").repartition(4)


@pytest.fixture(scope="module")
def shapes():
    """Lots of two far squares, and zones: stars with holes that run either way, rings, a bow tie, one of 700 corners."""
    rng = np.random.default_rng(4)
    spots = rng.uniform(0, 12, (40, 2)).round(2)
    lots = [(i, [box(x, y, 0.4), box(x + 3, y + 1, 0.3)]) for i, (x, y) in enumerate(spots.tolist())]
    zones = []
    for i, (x, y) in enumerate(rng.uniform(0, 14, (50, 2)).round(2).tolist()):
        hole = star(rng, x, y, 30, 0.2, 0.4)
        kind = [[star(rng, x, y, 60, 0.5, 1.5), hole[::-1]], [star(rng, x, y, 80, 0.5, 1.0), hole], [box(x, y, 1.0)], [box(x, y, 1.0), box(x + 0.25, y + 0.25, 0.5)[::-1]]][i % 4]
        zones.append((100 + i, kind))
    zones.append((200, [ring([(5, 5), (7, 7), (7, 5), (5, 7), (4, 6), (3.5, 6), (3, 5.5), (3, 5.2), (4, 5)])]))
    zones.append((201, [star(rng, 9, 9, 700, 1.0, 2.0)]))
    return lots, zones


def brute(shapes, measured):
    lots, zones = shapes
    pairs = [(a, b) for a in lots for b in zones]
    side = lambda k: pa.array([edges(p[k][1]) for p in pairs])
    far = _compare(side(0), side(1), np.ones(len(pairs), bool), measured)
    return {(a[0], b[0]): d for (a, b), d in zip(pairs, far.tolist(), strict=True)}


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_overlap_areas_by_tile(spark, shapes, monkeypatch):
    monkeypatch.setattr(tl, "BLOCK_ROWS", 20)  # crowded tiles
    lots, zones = shapes
    found = ov.overlap_pairs(table(spark, lots, "parcel_id"), table(spark, zones, "zone_id"), 1.0)
    assert "ArrowEvalPython" not in plan(found)  # no pair is a row before it is known to count
    got = {(r["parcel_id"], r["zone_id"]): r["overlap"] for r in found.collect()}
    assert set(got) == {k for k, d in brute(shapes, False).items() if d == 0}
    area = {(a, b): ov.area_within(ov._edge_array(edges(p)), [ov._edge_array(edges(q))]) for a, p in lots for b, q in zones}
    assert all(got.get(k, 0.0) == pytest.approx(v, abs=1e-9) for k, v in area.items())


def test_nearest_shapes_by_tile(spark, shapes):
    lots, zones = shapes
    lots = [*lots, (900, [box(200, 300, 1.0)])]  # far from all
    far = brute((lots, zones), True)
    found = ov.nearest_shape_fact(table(spark, lots, "parcel_id"), table(spark, zones, "zone_id"), "zone_id")
    assert "ArrowEvalPython" not in plan(found)
    got = {r["parcel_id"]: (r["distance"], r["feature_id"]) for r in found.collect()}
    best = {a: min((far[a, b], b) for b, _ in zones) for a, _ in lots}
    assert {a: b for a, (_, b) in got.items()} == {a: b for a, (_, b) in best.items()}
    assert all(got[a][0] == pytest.approx(d, abs=1e-9) for a, (d, _) in best.items())


def test_meetings_by_tile(spark, shapes):
    lots, zones = shapes
    named = table(spark, zones, "zone_id").select("rings", (F.col("zone_id") % 5).cast("string").alias("kind"))
    found = ov.intersects_list(table(spark, lots, "parcel_id"), named, "kind", 1.0)
    assert "ArrowEvalPython" not in plan(found)
    want = {}
    for (a, b), d in brute(shapes, False).items():
        want.setdefault(a, set()).update([str(b % 5)] if d == 0 else [])
    assert {r["parcel_id"]: r["val"] or [] for r in found.collect()} == {a: sorted(v) for a, v in want.items()}


@pytest.mark.parametrize("square", [False, True])
def test_grown_features_by_tile(spark, shapes, square):
    lots, zones = shapes
    angle = 2 * np.pi * np.arange(32) / 32
    shape = 0.2 * (np.array([(1, 1), (-1, 1), (-1, -1), (1, -1)], float) if square else np.stack([np.cos(angle), np.sin(angle)], axis=1))
    some = [z for z in zones if z[0] < 120]
    found = ov.buffer_overlap_area(table(spark, lots, "parcel_id"), table(spark, some, "zone_id"), 0.2, 1.0, square=square)
    assert "ArrowEvalPython" not in plan(found)
    want = {a: max(ov.grown_overlap(edges(p), edges(q), shape) for _, q in some) for a, p in lots}
    assert all((r["val"] or 0.0) == pytest.approx(want[r["parcel_id"]], abs=1e-9) for r in found.collect())


def test_shape_distances_by_tile(spark, shapes):
    lots, zones = shapes
    lines = [(i, [r[0][: len(r[0]) // 2]]) for i, r in zones[:20]]
    spots = [(i, [[r[0][0]]]) for i, r in zones[20:40]]
    kinds = [("area", zones[40:]), ("line", lines), ("point", spots)]
    layer = None
    for name, rows in kinds:
        one = table(spark, rows, "id").withColumn("cls", F.lit(name))
        layer = one if layer is None else layer.unionByName(one)
    features = ov.shape_features(layer.repartition(3), "id", F.col("cls") == "area", F.col("cls"))
    found = ov.shape_distances(table(spark, lots, "parcel_id"), features, ["area", "line", "point", "none"])
    assert "ArrowEvalPython" not in plan(found)
    got = {r["parcel_id"]: r for r in found.collect()}
    for name, rows in kinds:
        paths = [(i, [r * 2 if len(r) == 1 else r for r in rings]) for i, rings in rows]
        pairs = [(a, b) for a in lots for b in paths]
        gaps = _compare(*[pa.array([edges(p[k][1]) for p in pairs]) for k in (0, 1)], np.full(len(pairs), name == "area"), True)
        for n, (a, _) in enumerate(lots):
            assert got[a][f"dist_{name}"] == pytest.approx(min(gaps[n * len(rows) : (n + 1) * len(rows)]), abs=1e-9)
    assert all(r["dist_none"] is None for r in got.values())


def test_near_shapes_by_tile(spark, shapes):
    lots, zones = shapes
    found = ov.parcels_within(table(spark, lots, "parcel_id"), table(spark, zones, "zone_id"), 0.3, 1.0)
    assert "ArrowEvalPython" not in plan(found)
    want = {a for (a, _), d in brute(shapes, True).items() if d <= 0.3}
    assert {r["parcel_id"] for r in found.where("val").collect()} == want


def test_display_rollup_reads_its_rows_once(spark):
    rows = [
        (1, 10, "MA", "MSA", "A", 100.0, "two story", 5.0, 1), (1, 11, "MA2", "MSG", "G", 50.0, "", 6.0, 2), (1, 11, "MA2", "MSG", "G", 50.0, "", 4.0, 3),
        (1, 12, "SHED", "MSA", "A", 30.0, None, 1.0, 4), (1, None, "SHED", "ZZ", "U", 20.0, None, 1.0, 5), (1, 0, "SHED", "ZZ", "U", 10.0, None, 1.0, 6),
        (1, 0, "SHED", "ZZ", "U", 10.0, None, 1.0, 6), (2, 13, "DECK", "MSA", "A", 7.0, None, 1.0, 7), (2, 14, "SHED", "MSA", "A", 9.0, None, 1.0, 8),
    ]
    names = "parcel_id long, improvement_id long, type_code string, class_code string, condition_code string, area double, building_style string, value double, detail_id long"
    asked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(code):
        asked.add(1)
        return code

    df = spark.createDataFrame(rows, names).withColumns({"year_built": F.lit(1990), "eff_year_built": F.lit(2000)})
    read = df.withColumn("type_code", seen.asNondeterministic()("type_code"))
    got = {r["parcel_id"]: r for r in ru.display_rollup(ru.dedupe_details(read)).collect()}
    assert asked.value == len(rows)
    one, two = got[1], got[2]
    assert (one["main_sqft"], one["by_story"], one["primary_code"], one["style"]) == (150, {"1": 100, "2": 50}, "MA", "Two Story")
    assert [(x["code"], x["count"], x["total_sqft"]) for x in one["components"]] == [("SHED", 4, 70)]
    assert (two["main_sqft"], two["by_story"], two["primary_code"], two["quality_code"]) == (0, None, "SHED", None)
    assert [(x["code"], x["count"], x["total_sqft"]) for x in two["components"]] == [("DECK", 1, 7)]


def test_touching_is_no_overlap_and_unknown_corners_are_cut(spark):
    lot = table(spark, [(1, [box(1.3, 0.1, 0.07)])], "parcel_id")
    zone = table(spark, [(9, [box(0.95, 0.1, 0.3)])], "zone_id")  # grown by 0.05 it ends where the lot begins
    assert (ov.buffer_overlap_area(lot, zone, 0.05, 1.0).first()["val"] or 0.0) == 0.0
    half = [[{"x": 0.1 * i if i < 40 else None, "y": 0.0} for i in range(80)]]
    pieces, large = tl.in_pieces(tl.packed(spark.createDataFrame([(9, half)], f"zone_id long, rings {RINGS}")))
    assert large and pieces.columns.count(tl.PIECE) == 1
