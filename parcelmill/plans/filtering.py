"""Queries for the predicate sets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv
from parcelmill.operators import filters as fl
from parcelmill.operators import joins as jn
from parcelmill.plans.cleaning import sql_list
from parcelmill.plans.registry import query

c = F.col

LATEST = """latest AS (SELECT parcel_id, sale_price AS last_sale_price, sale_date AS last_sale_date, deed_type AS last_deed_type FROM (
    SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY sale_date DESC NULLS LAST, sale_id DESC) AS rn FROM sales) WHERE rn = 1)"""
LATEST_VALID = LATEST.replace("FROM sales)", "FROM sales WHERE lower(trim(sale_type)) = 'valid sale')").replace(
    "latest AS", "latest_valid AS"
)


@query(
    "p01_parcel_filter",
    f"""WITH {LATEST}
        SELECT p.parcel_id, p.assessed_value, l.last_sale_price FROM parcels p LEFT JOIN latest l ON p.parcel_id = l.parcel_id
        WHERE upper(trim(coalesce(proptype, ''))) = 'R' AND address ILIKE '%customer%' AND assessed_value BETWEEN 200000 AND 300000
          AND year_built BETWEEN 1930 AND 2010 AND acres BETWEEN 0.5 AND 4.5 AND last_sale_price BETWEEN 1000 AND 400000
          AND city_district = 'CITY_2'""",
)
def _(t):
    found = fl.parcel_filter(
        jn.with_latest_sale(t.parcels, t.sales), address="Customer", value=(200000.0, 300000.0), year=(1930, 2010),
        acres=(0.5, 4.5), sale_price=(1000.0, 400000.0), district="CITY_2",
    )
    return found.select("parcel_id", "assessed_value", "last_sale_price")


@query(
    "p02_sales_filter",
    """SELECT s.sale_id, s.parcel_id, s.sale_price FROM sales s JOIN parcels p ON s.parcel_id = p.parcel_id
       WHERE lower(trim(sale_type)) = 'valid sale' AND upper(trim(coalesce(proptype, ''))) = 'R' AND city_district = 'CITY_1'
         AND sale_price BETWEEN 20000 AND 350000 AND sale_date BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-12-31'
         AND acres BETWEEN 0.3 AND 4.0 AND land_use_code = '110'""",
)
def _(t):
    joined = t.sales.join(t.parcels, "parcel_id")
    return fl.sales_filter(
        joined, city="CITY_1", price=(20000.0, 350000.0), dates=(dt.date(1996, 1, 1), dt.date(2000, 12, 31)),
        acres=(0.3, 4.0), land_use="110",
    ).select("sale_id", "parcel_id", "sale_price")


@query(
    "p03_comparable_filter",
    """SELECT s.sale_id, s.parcel_id FROM sales s JOIN parcels p ON s.parcel_id = p.parcel_id
       WHERE lower(proptype) = 'r' AND sale_date >= TIMESTAMP '1996-03-01' AND sale_date < TIMESTAMP '2000-01-01'
         AND sale_price BETWEEN 10000 AND 400000 AND bedrooms >= 2 AND bathrooms >= 1.5
         AND x BETWEEN 1 AND 25 AND y BETWEEN 0 AND 0.9""",
)
def _(t):
    joined = t.sales.join(t.parcels, "parcel_id")
    return fl.cma_filter(
        joined, property_type="R", dates=(dt.date(1996, 3, 1), dt.date(1999, 12, 31)), price=(10000.0, 400000.0),
        bedrooms=2, bathrooms=1.5, bbox=(1.0, 0.0, 25.0, 0.9),
    ).select("sale_id", "parcel_id")


_NUMBERED = "SELECT *, 'P' || CAST(parcel_id AS VARCHAR) AS parcel_number FROM parcels"
_LIVE = "upper(trim(coalesce(proptype, ''))) = 'R' AND trim(address) <> '' AND NOT contains(lower(address), 'nan')"


def _numbered(t):
    return t.parcels.withColumn("parcel_number", F.concat(F.lit("P"), c("parcel_id").cast("string")))


@query(
    "p04_lookup_by_id",
    f"SELECT parcel_number, address FROM ({_NUMBERED}) WHERE {_LIVE} AND starts_with(parcel_number, 'P12') ORDER BY parcel_number LIMIT 15",
)
def _(t):
    return fl.parcel_lookup(_numbered(t), "p 12").select("parcel_number", "address")


@query(
    "p04_lookup_by_house_number",
    f"SELECT parcel_number, address FROM ({_NUMBERED}) WHERE {_LIVE} AND starts_with(lower(address), '112') ORDER BY address, parcel_number LIMIT 15",
)
def _(t):
    return fl.parcel_lookup(_numbered(t), "112", order_by="address").select("parcel_number", "address")


@query(
    "p04_lookup_by_street",
    f"SELECT parcel_number, address FROM ({_NUMBERED}) WHERE {_LIVE} AND contains(lower(address), '#000000077 st') ORDER BY parcel_number LIMIT 15",
)
def _(t):
    return fl.parcel_lookup(_numbered(t), "#000000077 St").select("parcel_number", "address")


@query(
    "p05_drop_junk_addresses",
    f"""SELECT id, address_raw FROM rawtext WHERE address_raw IS NOT NULL AND address_raw NOT IN ({sql_list(fv.JUNK_ADDRESSES)})
        AND trim(address_raw) <> '' AND NOT regexp_matches(address_raw, '(?i)^nan[ ,nan]*$')""",
)
def _(t):
    return fl.drop_junk_addresses(t.rawtext.select("id", "address_raw"), "address_raw")


@query(
    "p06_prefix_scope",
    "SELECT parcel_id, hood_code FROM parcels WHERE " + " OR ".join(f"starts_with(hood_code, '{p}')" for p in fv.TREND_PREFIXES),
)
def _(t):
    return fl.in_prefixes(t.parcels, "hood_code").select("parcel_id", "hood_code")


@query(
    "p07_mode_rows",
    r"""WITH n AS (SELECT parcel_id, proptype, CASE WHEN regexp_matches(trim(land_use_code), '^\d+$') THEN TRY_CAST(trim(land_use_code) AS INT) END AS lu FROM parcels)
        SELECT 'sfr' AS mode, count(*) AS parcels, CAST(sum(parcel_id) AS BIGINT) AS id_sum FROM n WHERE coalesce(proptype, '') = 'R' AND lu IN (110, 111, 112, 113)
        UNION ALL SELECT 'mobile_home', count(*), CAST(sum(parcel_id) AS BIGINT) FROM n WHERE lu IN (180, 181) OR upper(coalesce(proptype, '')) IN ('M', 'MH')
        UNION ALL SELECT 'condo', count(*), CAST(sum(parcel_id) AS BIGINT) FROM n WHERE coalesce(proptype, '') = 'R'""",
)
def _(t):
    parts = [fl.mode_filter(t.parcels, m).select(F.lit(m).alias("mode"), "parcel_id") for m in ("sfr", "mobile_home", "condo")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("mode").agg(F.count(F.lit(1)).alias("parcels"), F.sum("parcel_id").alias("id_sum"))


@query(
    "p08_recent_sales",
    "SELECT sale_id FROM sales WHERE sale_date >= TIMESTAMP '2001-08-01' - INTERVAL 540 DAY",
)
def _(t):
    return fl.recent(t.sales, "sale_date", 540, dt.date(2001, 8, 1)).select("sale_id")


@query(
    "p09_ratio_window",
    """SELECT s.sale_id, round(p.assessed_value / s.sale_price, 6) AS ratio FROM sales s JOIN parcels p ON s.parcel_id = p.parcel_id
       WHERE s.sale_price > 0 AND p.assessed_value / s.sale_price BETWEEN 0.25 AND 2.5""",
)
def _(t):
    rows = t.sales.where("sale_price > 0").join(t.parcels, "parcel_id").select("sale_id", (c("assessed_value") / c("sale_price")).alias("ratio"))
    return fl.ratio_window(rows).select("sale_id", F.round("ratio", 6).alias("ratio"))
