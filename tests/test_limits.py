"""Rounding at limits, crowded and wide inputs of the spatial and quality operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelmill.operators import grid as gr
from parcelmill.operators import overlay as ov
from parcelmill.operators import pieces as pc
from parcelmill.operators import quality as ql
from parcelmill.operators import raster as ra

POINT = "array<array<struct<x:double,y:double>>>"


def test_tile_edges_decide_not_quotients(spark):
    rnd = random.Random(3)
    boxes = [(0, -0.03, -0.03, 0.0, 0.0), (1, 3.97, 0.0, 4.03, 0.5), (2, 0.0, 9.97, 0.5, 10.067)]  # corners that miss an edge by rounding
    boxes += [(i, x, y, x + s, y + s) for i in range(3, 400) for x, y, s in [(0.001 * rnd.randrange(9000), 0.001 * rnd.randrange(9000), 0.001 * rnd.randrange(100))]]
    size = 2.0
    x0, y0 = min(b[1] for b in boxes), min(b[2] for b in boxes)
    wide, high = (int(np.ceil((max(b[3 + a] for b in boxes) - low) / size)) for a, low in ((0, x0), (1, y0)))
    want = {
        (b[0], i, j) for b in boxes for i in range(wide) for j in range(high)
        if b[1] <= x0 + i * size + size and b[3] >= x0 + i * size and b[2] <= y0 + j * size + size and b[4] >= y0 + j * size
    }
    got = ra.tile_pairs(spark.createDataFrame(boxes, "parcel_id long, x0 double, y0 double, x1 double, y1 double"), size).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_outliers_keep_the_stated_number(spark):
    rows = spark.range(9000).select(F.col("id").alias("k"), F.col("id").cast("double").alias("v"))
    tops = {most: len(ql.outliers(rows, ["v"], "k", most=most).first()["top"]) for most in (5, 20)}
    assert tops == {5: 5, 20: 9}


def test_stated_distance_decides_at_the_limit(spark):
    from parcelmill.functions import geometry as gm

    rnd = random.Random(8)
    c = F.col
    squares = [(i, 0.001 * rnd.randrange(1000), 0.001 * rnd.randrange(1000), 0.05 + 0.01 * rnd.randrange(9)) for i in range(40)]
    spots = [(i * 10 + j, x + s + 0.15 if j % 2 else x - 0.15, y + s / 2) for i, x, y, s in squares for j in range(2)]
    gap = lambda z, p, s: max(z - p, 0, p - z - s) ** 2
    want = {(p, z) for p, px, py in spots for z, x, y, s in squares if np.sqrt(gap(x, px, s) + gap(y, py, s)) <= 0.15}
    layer = spark.createDataFrame(squares, "zone_id long, x0 double, y0 double, side double")
    layer = layer.withColumn("rings", gm.box_rings(c("x0"), c("y0"), c("x0") + c("side"), c("y0") + c("side")))
    points = ov.as_points(spark.createDataFrame(spots, "parcel_id long, x double, y double"))
    far = lambda z, p: F.pow(F.greatest(c(z) - c(p), F.lit(0.0), c(p) - c(z) - c("side")), 2)
    got = ov.within(points, layer, 0.15, 0.5, measure=F.sqrt(far("x0", "px") + far("y0", "py")))
    assert {(r["parcel_id"], r["zone_id"]) for r in got.collect()} == want


def test_wide_sides_are_never_broadcast(spark):
    boxes = spark.range(6000).select("id", *[(F.col("id") * 0.1 + d).alias(n) for n, d in (("x0", 0.0), ("y0", 0.0), ("x1", 0.05), ("y1", 0.05))])
    sides = [gr.box_of(boxes, *map(F.col, gr.BOX), p).drop(*gr.BOX).withColumnRenamed("id", f"{p}id") for p in ("l_", "r_")]
    for hot_rows in (gr.HOT_CELL_ROWS, 1000):  # without and with a count of crowded cells
        pairs = gr.cell_pairs(*sides, 0.5, hot_rows=hot_rows)
        assert "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()
        assert pairs.count() == 6000


def test_large_polygons_are_cut_by_many_tasks_once(spark, tmp_path):
    t = 2 * np.pi * np.arange(100) / 100
    circle = lambda x: [{"x": float(x + np.cos(a)), "y": float(np.sin(a))} for a in [*t, t[0]]]
    square = [{"x": float(x), "y": float(y)} for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    rows = [(i, [circle(3 * i)]) for i in range(60)] + [(60, [square])]
    asked = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def seen(i):
        asked.add(1)
        return i

    one_task = spark.createDataFrame(rows, f"zone_id long, rings {POINT}").coalesce(1)
    read = one_task.withColumn("seen", seen.asNondeterministic()("zone_id"))
    pieces, cut = pc.subdivide(read)
    assert cut and {r["zone_id"] for r in pieces.collect()} == set(range(61))
    before = asked.value
    assert before <= 2 * 61  # once to count, once to store
    assert pieces.groupBy("zone_id").count().count() == 61 and pieces.count() >= 121
    assert asked.value == before  # the source is not read again
    assert pieces.rdd.getNumPartitions() > 1
