"""Stand-in property tables, written once as SQL both engines accept.

Each entry is a SELECT over test tables or other entries, named in braces. Land
grows with the data: parcels, zones, amenities and terrain cells fill the plane
block by block, so the density of every layer stays the same at any scale.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

SOURCE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _place(key: str, per_block: int, axis: str, factor: int) -> str:
    """Position in km of a key: 64 half-kilometre blocks per row, then an offset."""
    block = f"CAST(floor({key} / {per_block}e0) AS BIGINT)"
    along = f"({block} % 64)" if axis == "x" else f"CAST(floor({block} / 64e0) AS BIGINT)"
    return f"(5e-1 * {along} + 5e-4 * (({key} * {factor}) % 1000))"


BINDINGS: dict[str, str] = {
    "parcels": f"""
        SELECT c_custkey AS parcel_id,
               c_nationkey AS hood_id,
               CASE c_nationkey % 7 WHEN 0 THEN '20B' WHEN 1 THEN '21LC' WHEN 2 THEN '20A'
                    WHEN 3 THEN '21SW' WHEN 4 THEN '10CC' WHEN 5 THEN '21MV' ELSE '99ZZ' END AS hood_prefix,
               CASE c_nationkey % 7 WHEN 0 THEN '20B' WHEN 1 THEN '21LC' WHEN 2 THEN '20A'
                    WHEN 3 THEN '21SW' WHEN 4 THEN '10CC' WHEN 5 THEN '21MV' ELSE '99ZZ' END
                 || CASE c_nationkey % 3 WHEN 0 THEN 'WFT' WHEN 1 THEN 'SKY' ELSE 'C' END
                 || CAST(c_nationkey AS STRING) AS hood_code,
               CASE WHEN c_mktsegment = 'MACHINERY' THEN 'C' ELSE 'R' END AS proptype,
               CASE c_custkey % 9 WHEN 0 THEN '111' WHEN 1 THEN '112' WHEN 2 THEN '113' WHEN 3 THEN ' 110 '
                    WHEN 4 THEN '180' WHEN 5 THEN 'X1' WHEN 6 THEN NULL ELSE '110' END AS land_use_code,
               'CITY_' || CAST(c_nationkey % 5 AS STRING) AS city_district,
               'SCHOOL_' || CAST(c_nationkey % 4 AS STRING) AS school_district,
               CASE WHEN c_custkey % 17 = 0 THEN 'nan nan, nan' WHEN c_custkey % 19 = 0 THEN ''
                    WHEN c_custkey % 23 = 0 THEN NULL
                    ELSE CAST(100 + c_custkey % 900 AS STRING) || ' ' || c_name || ' ST' END AS address,
               200000 + 12 * c_acctbal                AS assessed_value,
               CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 210000 + 125e-1 * c_acctbal END AS total_market_value,
               1e-1 + (c_custkey % 50) * 1e-1         AS acres,
               CAST(800 + (c_custkey * 37) % 2400 AS DOUBLE) AS living_area,
               1920 + (c_custkey * 13) % 105          AS year_built,
               CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 1930 + (c_custkey * 13) % 95 END AS eff_year_built,
               CASE WHEN c_custkey % 29 = 0 THEN NULL ELSE 1 + c_custkey % 5 END AS bedrooms,
               1 + (c_custkey % 6) * 5e-1             AS bathrooms,
               CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE 1 + c_custkey % 6 END AS quality_score,
               CASE WHEN c_custkey % 12 = 0 THEN NULL ELSE c_custkey % 7 END AS condition_score,
               CAST((c_custkey % 4) * 200 AS DOUBLE)  AS garage_sqft,
               CASE WHEN c_custkey % 3 = 0 THEN 400e0 ELSE 0e0 END AS basement_sqft,
               50000 + 3 * c_acctbal                  AS land_market_value,
               '$' || CAST(1000 + (c_custkey * 7) % 5000 AS STRING) || '.50' AS total_taxes,
               CASE c_custkey % 4 WHEN 0 THEN 'RAMBLER' WHEN 1 THEN 'TWO STORY' WHEN 2 THEN NULL ELSE 'SPLIT' END AS building_style,
               {_place('c_custkey', 16, 'x', 7919)}   AS x,
               {_place('c_custkey', 16, 'y', 104729)} AS y
        FROM {{customer}}""",
    "sales": """
        SELECT o_orderkey AS sale_id, o_custkey AS parcel_id, o_totalprice AS sale_price,
               o_orderdate AS sale_date,
               CASE o_orderstatus WHEN 'F' THEN 'VALID SALE' WHEN 'O' THEN ' valid sale ' ELSE 'OTHER' END AS sale_type,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'WARRANTY DEED' WHEN '2-HIGH' THEN 'STATUTORY WARRANTY DEED'
                    ELSE 'QUIT CLAIM' END AS deed_type,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'R' || CAST(o_orderkey % 4000 AS STRING) END AS recording_number
        FROM {orders}""",
    "improvements": """
        SELECT o_custkey AS parcel_id, l_orderkey * 10 + l_linenumber AS improvement_id,
               CASE p_type WHEN 'ECONOMY' THEN 'MA' WHEN 'SMALL' THEN 'SHED' WHEN 'MEDIUM' THEN 'DGAR'
                    WHEN 'PROMO' THEN 'DECK' WHEN 'STANDARD' THEN 'BMF' ELSE 'SHOP' END
                 || CASE WHEN p_size % 10 = 0 THEN '2' ELSE '' END AS type_code,
               CASE p_size % 4 WHEN 0 THEN 'MSA' WHEN 1 THEN 'MSG' WHEN 2 THEN 'MSF' ELSE 'ZZ' END AS class_code,
               CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'G' ELSE 'U' END AS condition_code,
               CASE l_linenumber % 4 WHEN 0 THEN '2FB,HB' WHEN 1 THEN 'FB' WHEN 2 THEN '3QB;HB' ELSE NULL END AS plumbing,
               CASE WHEN p_size % 5 = 0 THEN 'two story' WHEN p_size % 5 = 1 THEN 'RAMBLER' ELSE NULL END AS building_style,
               CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity * 40 END AS area,
               l_extendedprice AS value,
               CASE WHEN l_linenumber % 6 = 0 THEN NULL ELSE CAST(year(l_shipdate) AS INT) - p_size END AS year_built,
               CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(year(l_shipdate) AS INT) - p_size % 20 END AS eff_year_built,
               CASE WHEN l_linenumber % 4 = 1 THEN CAST(year(l_shipdate) AS INT) ELSE NULL END AS new_const_year,
               CASE WHEN l_linenumber % 7 = 0 THEN 1 ELSE NULL END AS fireplaces,
               l_orderkey * 8 + l_linenumber + 100000000 * (l_partkey + 1) AS detail_id
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey""",
    "land": """
        SELECT o_custkey AS parcel_id, l_linenumber AS land_segment_id,
               CAST(year(l_shipdate) AS INT) AS value_year,
               CASE l_returnflag WHEN 'A' THEN 'SITE' WHEN 'R' THEN 'TIMBER' ELSE 'OPEN' END AS land_type,
               CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity / 100 END AS size_acres,
               l_quantity * 4356e-1 AS size_sqft,
               l_extendedprice AS market_value
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "history": """
        SELECT o_custkey AS parcel_id, CAST(year(o_orderdate) AS INT) AS value_year,
               max(o_totalprice) AS market_total, min(o_totalprice) AS land_market
        FROM {orders} GROUP BY o_custkey, year(o_orderdate)""",
    "rolls": """
        SELECT c_custkey AS parcel_id, 2025 AS roll_year, 200000 + 12 * c_acctbal AS assessed_value,
               CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 210000 + 125e-1 * c_acctbal END AS total_market_value,
               c_custkey * 2 AS roll_id
        FROM {customer} WHERE c_custkey % 8 <> 0
        UNION ALL
        SELECT c_custkey AS parcel_id, 2024 AS roll_year, 190000 + 11 * c_acctbal AS assessed_value,
               CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE 205000 + 12 * c_acctbal END AS total_market_value,
               c_custkey * 2 + 1 AS roll_id
        FROM {customer} WHERE c_custkey % 5 <> 0""",
    "zones": f"""
        SELECT p_partkey AS zone_id, p_type AS zone_class, p_brand AS zone_code,
               CASE p_size % 4 WHEN 0 THEN 'ManualOverride' WHEN 1 THEN 'CityGIS' WHEN 2 THEN 'WAZA' ELSE 'OTHER' END AS source,
               p_size AS zone_rank,
               {_place('p_partkey', 16, 'x', 3571)} AS x0,
               {_place('p_partkey', 16, 'y', 6007)} AS y0,
               5e-2 + 1e-2 * p_size AS side
        FROM {{part}}""",
    "lots": f"""
        SELECT c_custkey AS parcel_id,
               {_place('c_custkey', 16, 'x', 7919)} - 3e-2 AS x0,
               {_place('c_custkey', 16, 'y', 104729)} - 3e-2 AS y0,
               6e-2 + 1e-3 * (c_custkey % 40) AS side
        FROM {{customer}}""",
    "amenities": f"""
        SELECT s_suppkey AS amenity_id, s_nationkey % 9 AS class_id,
               {_place('s_suppkey', 1, 'x', 7907)} AS x,
               {_place('s_suppkey', 1, 'y', 5003)} AS y,
               s_acctbal AS flow
        FROM {{supplier}}""",
    "terrain": """
        SELECT o_orderkey % 160 AS ix, CAST(floor(o_orderkey / 160e0) AS BIGINT) AS iy,
               CAST((o_orderkey * 37) % 101 AS DOUBLE) + o_totalprice / 10000 AS z
        FROM {orders}""",
    "cloud": f"""
        SELECT l_orderkey * 10 + l_linenumber AS point_id,
               {_place('l_orderkey', 160, 'x', 7919)} + 1e-3 * l_linenumber AS x,
               {_place('l_orderkey', 160, 'y', 104729)} + 1e-3 * l_partkey / (1 + l_partkey) AS y,
               l_quantity + l_tax AS z
        FROM {{lineitem}}""",
    "reviews": """
        SELECT event_id AS review_id, user_id AS place_id, ts AS created_at, value AS rating,
               event_type AS source, props AS text
        FROM {events}""",
    "hood_metrics": """
        SELECT n_name AS hood_code, CAST(year(o_orderdate) AS INT) AS metric_year,
               avg((200000 + 12 * c_acctbal) / o_totalprice) * 100 AS sales_ratio,
               avg(o_totalprice) / 20000 AS cod,
               avg((200000 + 12 * c_acctbal) / o_totalprice) / 2 AS prd,
               count(*) AS sample_size,
               CASE c_nationkey % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Moderate' WHEN 2 THEN 'LOW' ELSE NULL END AS reliability
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey
        WHERE o_totalprice > 1000
        GROUP BY n_name, year(o_orderdate), c_nationkey""",
    "segment_stats": """
        SELECT 'RUN' || CAST(l_linenumber % 3 AS STRING) AS run_id, p_type AS market_group, l_returnflag AS value_tier,
               count(*) AS n, avg(l_discount) * 200 AS cod, 95e-2 + avg(l_tax) * 2 AS prd,
               CASE WHEN p_type = 'PROMO' THEN NULL ELSE avg(l_discount) - avg(l_tax) END AS prb,
               1 - avg(l_discount) AS r2, sum(l_discount * l_discount) AS residual_sum_sq
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
        GROUP BY l_linenumber % 3, p_type, l_returnflag""",
    "coefficients": """
        SELECT 'RUN' || CAST(o_orderkey % 3 AS STRING) AS run_id,
               CASE c_nationkey % 7 WHEN 0 THEN 'BURLINGTON' WHEN 1 THEN 'LACONNER_CONWAY' WHEN 2 THEN 'ANACORTES'
                    WHEN 3 THEN 'SEDRO_WOOLLEY' WHEN 4 THEN 'CONCRETE' WHEN 5 THEN 'MOUNT_VERNON' ELSE 'OTHER' END AS market_group,
               CASE o_orderkey % 13 WHEN 0 THEN 'log_area' WHEN 1 THEN 'log_lot' WHEN 2 THEN 'log_age' WHEN 3 THEN 't'
                    WHEN 4 THEN 'area_time' WHEN 5 THEN 'quality_score' WHEN 6 THEN 'condition_score' WHEN 7 THEN 'has_garage'
                    WHEN 8 THEN 'has_basement' WHEN 9 THEN 'is_view' WHEN 10 THEN 'const' WHEN 11 THEN 'pt_1.0'
                    ELSE 'missing_quality' END AS term,
               round(avg(o_totalprice) / 1000000, 6) AS beta,
               max(o_orderdate) AS created_at
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey
        GROUP BY 1, 2, 3""",
    "rawtext": """
        SELECT c_custkey AS id,
               CASE c_custkey % 5 WHEN 0 THEN ' p-' || CAST(c_custkey AS STRING) || '.x ' WHEN 1 THEN lower(c_name)
                    WHEN 2 THEN NULL WHEN 3 THEN '#!' ELSE 'P' || CAST(c_custkey AS STRING) END AS parcel_raw,
               CASE c_custkey % 6 WHEN 0 THEN '*' WHEN 1 THEN ' nan' WHEN 2 THEN 'None ' WHEN 3 THEN ' good '
                    WHEN 4 THEN NULL ELSE lower(c_mktsegment) END AS cat_raw,
               CASE c_custkey % 7 WHEN 0 THEN '(110' || CAST(c_custkey AS STRING) || ') uga-' || lower(c_mktsegment) || ' EAST'
                    WHEN 1 THEN ' 20asky - conway' WHEN 2 THEN '( ) x' WHEN 3 THEN '' WHEN 4 THEN NULL
                    WHEN 5 THEN 'see (20MV8) hill' ELSE '20mv' || CAST(c_custkey AS STRING) END AS code_raw,
               CASE c_custkey % 7 WHEN 0 THEN '1650' WHEN 1 THEN 'x' WHEN 2 THEN '2051' ELSE CAST(1900 + c_custkey % 150 AS STRING) END AS year_raw,
               CASE c_custkey % 7 WHEN 0 THEN '0' WHEN 1 THEN '-3' WHEN 2 THEN '60000.5' ELSE CAST(c_custkey AS STRING) || '.25' END AS area_raw,
               CASE c_custkey % 10 WHEN 0 THEN '2FB,HB' WHEN 1 THEN '33FB' WHEN 2 THEN '3QB' WHEN 3 THEN 'QTR' WHEN 4 THEN 'FB;HB MB'
                    WHEN 5 THEN '' WHEN 6 THEN NULL WHEN 7 THEN '2HB, fb' WHEN 8 THEN '12fb 33QB' ELSE '3FB,3QB,zz' END AS plumbing_raw,
               CASE c_custkey % 10 WHEN 0 THEN '3' WHEN 1 THEN '¾' WHEN 2 THEN '3qb' WHEN 3 THEN '1 / 2' WHEN 4 THEN 'NA' WHEN 5 THEN '2.5 baths'
                    WHEN 6 THEN NULL WHEN 7 THEN '4/0' WHEN 8 THEN '2q' ELSE 'about ' || CAST(c_custkey AS STRING) END AS count_raw,
               CASE c_custkey % 8 WHEN 0 THEN '$4,900.00' WHEN 1 THEN '$.00' WHEN 2 THEN '(1,200)' WHEN 3 THEN 'x' WHEN 4 THEN NULL
                    WHEN 5 THEN '' WHEN 6 THEN '$ 12.50' ELSE '$' || CAST(c_custkey AS STRING) || ',000.75' END AS money_raw,
               CASE c_custkey % 6 WHEN 0 THEN 'Fish $12.50 today' WHEN 1 THEN 'market' WHEN 2 THEN '1,25 each' WHEN 3 THEN NULL
                    WHEN 4 THEN '$ 7' ELSE 'No. ' || CAST(c_custkey AS STRING) END AS price_raw,
               CASE c_custkey % 6 WHEN 0 THEN '12.5%' WHEN 1 THEN ' 7 %' WHEN 2 THEN 'n/a' WHEN 3 THEN NULL WHEN 4 THEN ''
                    ELSE CAST(c_custkey AS STRING) || '%' END AS percent_raw,
               CASE c_custkey % 8 WHEN 0 THEN 'nan' WHEN 1 THEN ' NaN nan, nan ' WHEN 2 THEN NULL WHEN 3 THEN ' ' WHEN 4 THEN '-'
                    WHEN 5 THEN 'nan ,nan' ELSE ' ' || c_name || ' ' END AS address_raw,
               CASE c_custkey % 9 WHEN 0 THEN 'MA' WHEN 1 THEN 'LOFT' WHEN 2 THEN 'LOFTX' WHEN 3 THEN 'MPS' WHEN 4 THEN 'CWP'
                    WHEN 5 THEN 'BMU' WHEN 6 THEN 'ARK' WHEN 7 THEN NULL ELSE substr(c_mktsegment, 1, 2) END AS type_raw,
               CASE c_custkey % 6 WHEN 0 THEN 'McDonalds ' || c_name WHEN 1 THEN 'Taco  Time' WHEN 2 THEN 'Denny''s' WHEN 3 THEN NULL
                    WHEN 4 THEN 'The Sonic' ELSE c_name END AS place_name
        FROM {customer}""",
    "visits": """
        SELECT event_id, user_id AS place_id, ts, value, event_type,
               CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'skip' ELSE 'success' END AS outcome
        FROM {events}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def duckdb_sql(body: str) -> str:
    """Prefix `body` with the stand-in tables it names, for DuckDB."""
    used: list[str] = []

    def visit(name: str) -> None:
        if name in used or name not in BINDINGS:
            return
        for child in _NAME.findall(BINDINGS[name]):
            visit(child)
        used.append(name)

    for name in BINDINGS:
        if re.search(rf"\b{name}\b", body):
            visit(name)
    if not used:
        return body.strip()
    parts = [f"{name} AS ({_NAME.sub(lambda m: m.group(1), BINDINGS[name])})" for name in used]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


class Tables:
    """Lazy access to source tables and stand-in tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in BINDINGS and name not in SOURCE_TABLES):
            raise AttributeError(name)
        if name not in self._cache:
            if name in SOURCE_TABLES:
                self._cache[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                self._cache[name] = self.sql(BINDINGS[name])
        return self._cache[name]

    def sql(self, text: str) -> DataFrame:
        """Run SQL whose table names stand in braces."""
        frames = {name: getattr(self, name) for name in set(_NAME.findall(text))}
        return self.spark.sql(text, **frames)
