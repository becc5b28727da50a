"""A few registered queries against DuckDB on the smallest data; tools/check.py runs all."""

import duckdb
import pytest

import __spark_entry__ as entry
from parcelmill.plans.bindings import SOURCE_TABLES
from tools.check import rows_of

FOLDER = "/root/testdata/sf0.001"
NAMES = [
    "r01_ratio_study", "a01_improvement_rollup", "a09_display_rollup", "a17_history_medians", "g01_points_in_zones", "g08_nearest_amenity",
    "c01_comp_candidates", "m03_merge_changed", "q09_outliers", "v01_parcel_details", "r23_segment_diagnostics",
]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["hood_code", "sales_ratio", "median_ratio", "cod", "prd", "sample_size", "reliability"]


@pytest.mark.parametrize("name", NAMES)
def test_against_duckdb(spark, name):
    con = duckdb.connect()
    for t in SOURCE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    res = con.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of([d[0] for d in res.description], res.fetchall())
