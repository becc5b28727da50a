"""Census facts of parcels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmill.operators.overlay import as_points, contains_join

c = F.col


def census_join(parcels: DataFrame, block_groups: DataFrame, acs: DataFrame, cell: float, key: str = "parcel_id") -> DataFrame:
    """Block group of each parcel (lowest geoid where several hold it) with its census row."""
    hits = contains_join(as_points(parcels, key), block_groups.select("geoid", "rings"), cell)
    one = hits.groupBy(key).agg(F.min("geoid").alias("geoid"))
    return one.join(acs, "geoid")
