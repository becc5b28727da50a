"""Queries for nested documents and vector search."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelmill.functions.cleaning import describe, pick_keys
from parcelmill.operators import documents as dc
from parcelmill.plans.aggregating import r6
from parcelmill.plans.registry import query
from parcelmill.plans.windowing import IMPR_SQL, LAND_SQL, SALE_SQL

c = F.col

LISTS_SQL = f"""{LAND_SQL}, {IMPR_SQL}, {SALE_SQL},
    ll AS (SELECT parcel_id, string_agg(concat_ws('|', value_year, land_type, size_acres, market_value), ';' ORDER BY value_year DESC NULLS LAST, land_segment_id, market_value DESC NULLS LAST, land_type) AS land,
           sum(size_acres) AS acres_sum, sum(market_value) AS value_sum FROM land1 GROUP BY 1),
    il AS (SELECT parcel_id, string_agg(concat_ws('|', improvement_id, type_code, value), ';' ORDER BY improvement_id) AS imps FROM impr1 GROUP BY 1),
    sl AS (SELECT parcel_id, string_agg(concat_ws('|', sale_price, deed_type, recording_number), ';' ORDER BY sale_date DESC NULLS LAST, sale_price DESC NULLS LAST, sale_id) AS sales_text,
           count(*) AS n FROM sale1 GROUP BY 1)"""


def _text(array, *fields):
    return F.array_join(F.transform(array, lambda s: F.concat_ws("|", *[s[f].cast("string") for f in fields])), ";")


@query(
    "v01_parcel_details",
    f"""WITH {LISTS_SQL} SELECT p.parcel_id, coalesce(land, '') AS land, coalesce(imps, '') AS improvements, coalesce(sales_text, '') AS sales
        FROM parcels p LEFT JOIN ll ON p.parcel_id = ll.parcel_id LEFT JOIN il ON p.parcel_id = il.parcel_id LEFT JOIN sl ON p.parcel_id = sl.parcel_id
        WHERE upper(trim(coalesce(proptype, ''))) = 'R'""",
)
def _(t):
    return dc.parcel_detail(t.parcels, t.land, t.improvements, t.sales).select(
        "parcel_id", _text("land_segments", "value_year", "land_type", "size_acres", "market_value").alias("land"),
        _text("improvements", "improvement_id", "type_code", "value").alias("improvements"),
        _text("sales", "sale_price", "deed_type", "recording_number").alias("sales"),
    )


@query(
    "v02_detail_summaries",
    f"""WITH {LISTS_SQL}, v AS (SELECT parcel_id, count(*) FILTER (sale_price > 0) AS real_sales FROM sale1 GROUP BY 1),
        f AS (SELECT parcel_id, sale_price FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY sale_date DESC NULLS LAST, sale_price DESC NULLS LAST, sale_id) AS k FROM sale1) WHERE k = 1)
        SELECT p.parcel_id, round(coalesce(nullif(acres_sum, 0), acres), 6) AS land_acres, round(coalesce(nullif(value_sum, 0), total_market_value), 4) AS land_market_value,
               f.sale_price AS latest_price, CAST(least(5, coalesce(real_sales, 0)) AS INT) AS recent_valid, CAST(coalesce(n, 0) AS INT) AS total_records
        FROM parcels p LEFT JOIN ll ON p.parcel_id = ll.parcel_id LEFT JOIN sl ON p.parcel_id = sl.parcel_id LEFT JOIN v ON p.parcel_id = v.parcel_id LEFT JOIN f ON p.parcel_id = f.parcel_id
        WHERE upper(trim(coalesce(proptype, ''))) = 'R'""",
)
def _(t):
    out = dc.detail_summary(dc.parcel_detail(t.parcels, t.land, t.improvements, t.sales))
    return out.select(
        "parcel_id", *r6("land_acres"), F.round("land_market_value", 4).alias("land_market_value"),
        c("latest_sale.sale_price").alias("latest_price"), F.size("recent_valid").alias("recent_valid"), "total_records",
    )


@query(
    "v03_sales_documents",
    f"""WITH {LISTS_SQL},
        top AS (SELECT s.sale_id, s.parcel_id, s.sale_price, p.acres FROM sales s JOIN parcels p ON s.parcel_id = p.parcel_id
                WHERE lower(trim(sale_type)) = 'valid sale' AND upper(trim(coalesce(proptype, ''))) = 'R' ORDER BY sale_date DESC NULLS LAST, sale_id DESC LIMIT 100)
        SELECT top.sale_id, top.parcel_id, round(coalesce(nullif(acres_sum, 0), acres), 6) AS land_acres, coalesce(land, '') AS land, coalesce(imps, '') AS improvements
        FROM top LEFT JOIN ll ON top.parcel_id = ll.parcel_id LEFT JOIN il ON top.parcel_id = il.parcel_id""",
)
def _(t):
    return dc.sales_documents(t.sales, t.parcels, t.land, t.improvements, limit=100).select(
        "sale_id", "parcel_id", *r6("land_acres"), _text("land_segments", "value_year", "land_type", "size_acres", "market_value").alias("land"),
        _text("improvements", "improvement_id", "type_code", "value").alias("improvements"),
    )


@query(
    "v04_vector_search",
    """WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
            d AS (SELECT vec_id, label, sqrt(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: pow(CAST(embedding[i] AS DOUBLE) - CAST(q[i] AS DOUBLE), 2)))) AS distance FROM embeddings, q)
       SELECT vec_id, label, round(distance, 6) AS distance, round(1 / (1 + distance), 6) AS similarity FROM d ORDER BY d.distance, vec_id LIMIT 25""",
)
def _(t):
    probe = t.embeddings.where("vec_id = 0").select("embedding").first()[0]
    return dc.vector_search(t.embeddings, probe, 25).select("vec_id", "label", *r6("distance", "similarity"))


@query(
    "v05_fallback_search",
    """SELECT parcel_id, total_market_value, CAST(NULL AS DOUBLE) AS similarity FROM parcels WHERE address IS NOT NULL AND upper(trim(coalesce(proptype, ''))) = 'R'
       ORDER BY total_market_value DESC NULLS LAST, parcel_id LIMIT 10""",
)
def _(t):
    return dc.fallback_search(t.parcels, 10).select("parcel_id", "total_market_value", "similarity")


@query("v06_text_embeddings")
def _(t):
    return dc.embed(t.documents.select("doc_id", "text"), "text").select("doc_id", "embedding")


@query("v06_parcel_embeddings")
def _(t):
    text = describe([(None, c("address")), ("Neighborhood:", c("hood_code")), ("Bedrooms:", c("bedrooms"))])
    return dc.embed(t.parcels.where("assessed_value IS NOT NULL").select("parcel_id", text.alias("description")), "description")


@query("v07_nested_properties", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value FROM events")
def _(t):
    props = F.from_json("props", "map<string,string>")
    return t.events.select("event_id", pick_keys(props, ("pct change", "k")).alias("value"))
