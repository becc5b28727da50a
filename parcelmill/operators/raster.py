"""Tiles, point clouds and rasters as long tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.operators import grid as gr
from parcelmill.operators.overlay import as_points, contains_join

c = F.col
KEY = "parcel_id"
FEET_PER_METRE = 3.28084


def tile_grid(boxes: DataFrame, size: float) -> DataFrame:
    """Square tiles over the extent of all boxes (x0, y0, x1, y1).

    Tiles are counted out by a distributed range, so no task makes them all.
    """
    extent = boxes.agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).first()
    if extent["x0"] is None:
        return boxes.sparkSession.createDataFrame([], "tx long, ty long, tile_x double, tile_y double")
    x0, y0 = float(extent["x0"]), float(extent["y0"])
    wide, high = (max(1, math.ceil((float(extent[f"{a}1"]) - float(extent[f"{a}0"])) / size)) for a in ("x", "y"))
    tiles = boxes.sparkSession.range(wide * high).select(F.expr(f"id div {high}").alias("tx"), F.expr(f"id % {high}").alias("ty"))
    return tiles.select("tx", "ty", (F.lit(x0) + c("tx") * size).alias("tile_x"), (F.lit(y0) + c("ty") * size).alias("tile_y"))


def tile_pairs(boxes: DataFrame, size: float, key: str = KEY) -> DataFrame:
    """(tile, parcel) pairs whose squares share a point; a box on a tile edge belongs to both sides."""
    extent = boxes.agg(F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))).scalar()
    rows = boxes.withColumn("e", extent)

    def span(a: str) -> Column:
        # Divisions may round over a tile's edge: one tile more on both sides, then the edges themselves decide.
        low, high = (c(f"{a}0") - c(f"e.{a}0")) / size, (c(f"{a}1") - c(f"e.{a}0")) / size
        last = F.greatest(F.ceil((c(f"e.{a}1") - c(f"e.{a}0")) / size) - 1, F.lit(0))
        first = F.greatest(F.ceil(low) - 2, F.lit(0))
        near = F.sequence(F.least(first, last), F.least(F.floor(high) + 1, last))
        edge = lambda i: c(f"e.{a}0") + i * F.lit(float(size))
        return F.filter(near, lambda i: (c(f"{a}0") <= edge(i) + F.lit(float(size))) & (c(f"{a}1") >= edge(i)))

    return rows.withColumn("tx", F.explode(span("x"))).select(key, "tx", span("y").alias("tys")).select(key, "tx", F.explode("tys").alias("ty"))


def cloud_stats(points: DataFrame, parcels: DataFrame, cell: float, to_feet: float = FEET_PER_METRE) -> DataFrame:
    """Height statistics of the points inside each parcel's box.

    Heights become feet, the spread stays in metres. Parcels carry x0, y0, x1, y1, area.
    """
    left = as_points(points, key="point_id", keep=["z"])
    right = gr.box_of(parcels.select(KEY, "area", *gr.BOX), *[c(n) for n in gr.BOX], "r_").drop(*gr.BOX)
    hits = gr.cell_pairs(left, right, cell)
    return hits.groupBy(KEY, "area").agg(
        (F.min("z") * to_feet).alias("min_elevation_ft"),
        (F.max("z") * to_feet).alias("max_elevation_ft"),
        (F.avg("z") * to_feet).alias("mean_z_ft"),
        F.stddev_pop("z").alias("roughness"),
        ((F.max("z") - F.avg("z")) * to_feet).alias("canopy_ft"),
        F.count(F.lit(1)).alias("points"),
    ).select("*", (c("points") / c("area")).alias("density")).drop("area")


def sample_raster(points: DataFrame, dem: DataFrame, cell: float, value: str = "z", x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Raster value of the cell under each point, NULL outside."""
    placed = points.withColumn("ix", F.floor((c("x") - x0) / cell)).withColumn("iy", F.floor((c("y") - y0) / cell))
    return placed.join(dem.select("ix", "iy", value), ["ix", "iy"], "left").drop("ix", "iy")


def zonal_mean(polygons: DataFrame, dem: DataFrame, cell: float, value: str = "z", x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """Mean of the raster cells whose center lies in each polygon."""
    centers = dem.select(
        value, (x0 + (c("ix") + 0.5) * cell).alias("x"), (y0 + (c("iy") + 0.5) * cell).alias("y"),
        F.struct("ix", "iy").alias("cell_id"),
    )
    hits = contains_join(as_points(centers, key="cell_id", keep=[value]), polygons.select(KEY, "rings"), cell * 4)
    means = hits.groupBy(KEY).agg(F.avg(value).alias("val"), F.count(F.lit(1)).alias("cells"))
    return polygons.select(KEY).join(means, KEY, "left")


def slope_aspect(dem: DataFrame, cell: float, value: str = "z") -> DataFrame:
    """Slope and aspect in degrees of every raster cell from its 3 x 3 surroundings.

    Each cell sends its height to its neighbors and one sum gathers the weighted
    differences, so neighbors stored together combine before the shuffle. A missing
    neighbor counts with the height of the center. Flat cells have no aspect.
    """
    steps = F.explode(
        F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    )
    sent = dem.where(c(value).isNotNull()).select("ix", "iy", c(value).cast("double").alias("h"), steps.alias("s"))
    to_east = -c("s.dx") * F.when(c("s.dy") == 0, 2).otherwise(1)
    to_south = c("s.dy") * F.when(c("s.dx") == 0, 2).otherwise(1)
    sums = sent.groupBy((c("ix") + c("s.dx")).alias("ix"), (c("iy") + c("s.dy")).alias("iy")).agg(
        F.sum(to_east * c("h")).alias("east"), F.sum(to_east).alias("we"),
        F.sum(to_south * c("h")).alias("south"), F.sum(to_south).alias("ws"),
        F.max(F.when((c("s.dx") == 0) & (c("s.dy") == 0), c("h"))).alias("h"),
    ).where(c("h").isNotNull())
    gx = c("east") - c("we") * c("h")
    gy = c("south") - c("ws") * c("h")
    angle = F.degrees(F.atan2(gy, -gx))
    compass = F.when(angle > 90, 450 - angle).otherwise(90 - angle)
    flat = (gx == 0) & (gy == 0)
    return sums.select(
        "ix", "iy", c("h").alias(value),
        F.degrees(F.atan(F.sqrt(gx * gx + gy * gy) / (8 * cell))).alias("slope"),
        F.when(~flat, F.when(compass == 360, 0.0).otherwise(compass)).alias("aspect"),
    )


def parcel_terrain(points: DataFrame, dem: DataFrame, cell: float) -> DataFrame:
    """Elevation, slope and aspect at each parcel centroid; aspect must lie in [0, 360)."""
    surface = slope_aspect(dem, cell)
    placed = points.withColumn("ix", F.floor(c("x") / cell)).withColumn("iy", F.floor(c("y") / cell))
    out = placed.join(surface, ["ix", "iy"], "left")
    ok = F.when((c("aspect") >= 0) & (c("aspect") < 360), c("aspect"))
    return out.select(KEY, c("z").alias("elevation"), "slope", ok.alias("aspect"))


