"""Fact tables: one column per entry of a manifest of metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmill.functions.codes import aspect_direction
from parcelmill.operators import overlay as ov
from parcelmill.operators import raster as rs
from parcelmill.operators.joins import lookup_zoning

c = F.col
KEY = ov.KEY
METRIC_ALIASES = {
    "area_intersect_pct": "intersection_area_pct",
    "boolean_overlay": "intersects_boolean",
    "categorical_overlay": "intersects_attribute",
    "nearest_distance_ft": "nearest_distance",
}


def _value(metric: str, op: Mapping[str, object], parcels: DataFrame, layer: DataFrame, cell: float) -> DataFrame:
    """(parcel, val) of one metric."""
    where = c(str(op["filter_column"])).isin(*op["filter_values"]) if "filter_column" in op else None
    if metric == "intersects_boolean":
        return ov.intersects(parcels, layer, cell)
    if metric == "intersects_attribute":
        return ov.intersects_attr(parcels, layer, str(op["column"]), str(op.get("order_by", op["column"])), cell)
    if metric == "intersects_attribute_list":
        return ov.intersects_list(parcels, layer, str(op["column"]), cell)
    if metric == "intersection_area":
        return ov.overlap_area(parcels, layer, cell)
    if metric == "intersection_area_pct":
        return ov.overlap_pct(parcels, layer, cell)
    if metric in ("buffer_intersects", "buffer_intersects_boolean", "buffer_intersects_filtered_boolean"):
        return ov.parcels_within(parcels, layer, float(op["distance"]), cell, where)
    if metric == "buffer_intersection_area":
        return ov.buffer_overlap_area(parcels, layer, float(op["distance"]), cell)
    if metric in ("nearest_distance", "nearest_boundary_distance", "nearest_distance_filtered"):
        if "rings" not in layer.columns:
            return ov.nearest_fact(parcels, layer, str(op["id"]), None, where).select(KEY, c("distance").alias("val"))
        # A boundary is a line: inside of it the distance is not 0.
        filled = False if metric == "nearest_boundary_distance" else None
        return ov.nearest_shape_fact(parcels, layer, str(op["id"]), None, where, filled).select(KEY, c("distance").alias("val"))
    if metric == "nearest_attribute":
        nearest = ov.nearest_shape_fact if "rings" in layer.columns else ov.nearest_fact
        return nearest(parcels, layer, str(op["id"]), str(op["column"]), where).select(KEY, c("attribute").alias("val"))
    if metric == "yield_classification":
        return ov.nearest_yield_class(parcels, layer, str(op["id"]), str(op["column"]), where)
    if metric == "density_per_acre":
        return ov.density_per_acre(parcels, layer, cell)
    if metric == "contains_boolean":
        held = ov.contains_join(layer, parcels.select(KEY, "rings"), cell).select(KEY).distinct()
        return held.withColumn("val", F.lit(True))
    value, size = str(op.get("value", "z")), float(op.get("cell", cell))
    if metric == "raster_value":
        return rs.sample_raster(parcels.select(KEY, "x", "y"), layer, size, value).select(KEY, c(value).alias("val"))
    if metric == "raster_value_mean":
        return rs.zonal_mean(parcels, layer, size, value).select(KEY, "val")
    if metric in ("raster_slope", "raster_aspect", "aspect_direction"):
        surface = rs.slope_aspect(layer, size, value)
        name = "slope" if metric == "raster_slope" else "aspect"
        found = rs.sample_raster(parcels.select(KEY, "x", "y"), surface, size, name).select(KEY, c(name).alias("val"))
        return found.withColumn("val", aspect_direction(c("val"))) if metric == "aspect_direction" else found
    raise ValueError(f"unknown metric {metric}")


def build_facts(parcels: DataFrame, layers: Mapping[str, DataFrame], manifest: Sequence[Mapping[str, object]], cell: float) -> DataFrame:
    """Wide fact table: one column per manifest entry.

    An entry has layer, metric, field and the metric's own options. Parcels carry rings and a
    centroid in x and y; layers carry rings (x and y for points, cells ix, iy and a value for
    rasters). All metrics meet in one grouping by parcel. `lookup_zoning_rule` takes its zone
    code and jurisdiction from the fields named in the entry, whatever their place.
    """
    lookups = [op for op in manifest if str(op["metric"]) == "lookup_zoning_rule"]
    rest = [op for op in manifest if op not in lookups]
    found = [(str(op["field"]), _value(METRIC_ALIASES.get(str(op["metric"]), str(op["metric"])), op, parcels, layers[str(op["layer"])], cell)) for op in rest]
    types = {field: df.schema["val"].dataType for field, df in found}
    kinds = list(dict.fromkeys(t.simpleString() for t in types.values()))
    column = {field: f"v{kinds.index(t.simpleString())}" for field, t in types.items()}
    long = None
    for field, df in found:
        values = [(c("val") if column[field] == f"v{i}" else F.lit(None).cast(kind)).alias(f"v{i}") for i, kind in enumerate(kinds)]
        part = df.where(c("val").isNotNull()).select(KEY, F.lit(field).alias("field"), *values)
        long = part if long is None else long.unionByName(part)
    out = parcels.select(KEY)
    if long is not None:
        wide = long.groupBy(KEY).agg(*[F.max(F.when(c("field") == field, c(column[field]))).alias(field) for field in types])
        out = out.join(wide, KEY, "left")
    for op in lookups:
        named = out.select(KEY, c(str(op["zone_field"])).alias("zone_code"), c(str(op["jurisdiction_field"])).alias("jurisdiction"))
        rule = lookup_zoning(named, layers[str(op["layer"])]).select(KEY, c("rule_id").alias(str(op["field"])))
        out = out.join(rule, KEY, "left")
    return out
