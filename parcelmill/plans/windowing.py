"""Queries for ordered work per key and ranked lists."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from parcelmill.operators import joins as jn
from parcelmill.operators import windows as wn
from parcelmill.plans.aggregating import history_docs, r6
from parcelmill.plans.filtering import LATEST
from parcelmill.plans.registry import query
from parcelmill.session import shared_folder

c = F.col


@query(
    "w02_dedupe_master",
    """WITH m AS (SELECT CAST(floor(parcel_id / 3e0) AS BIGINT) AS parcel_id, parcel_id AS row_id, proptype, total_market_value, CAST(year_built AS INT) AS final_year_built,
                  CASE WHEN parcel_id % 4 = 0 THEN NULL ELSE living_area END AS final_living_area FROM parcels)
       SELECT parcel_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY (proptype = 'R') DESC, (coalesce(final_living_area, 0) > 0) DESC,
              coalesce(total_market_value, -1) DESC, coalesce(final_year_built, -1) DESC, row_id) AS rn FROM m) WHERE rn = 1""",
)
def _(t):
    rows = t.parcels.select(
        F.floor(c("parcel_id") / 3e0).alias("parcel_id"), c("parcel_id").alias("row_id"), "proptype", "total_market_value",
        c("year_built").cast("int").alias("final_year_built"),
        F.when(c("parcel_id") % 4 != 0, c("living_area")).alias("final_living_area"), F.lit(None).cast("double").alias("total_living_area"),
        F.lit(None).cast("double").alias("living_area"),
    )
    return wn.dedupe_master(rows).select("parcel_id", "row_id")


LAND_SQL = """land1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id, land_segment_id, value_year, land_type
    ORDER BY market_value DESC NULLS LAST, size_sqft, size_acres NULLS FIRST) AS rn FROM land) WHERE rn = 1)"""
IMPR_SQL = """impr1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id, improvement_id
    ORDER BY eff_year_built DESC NULLS LAST, year_built DESC NULLS LAST, detail_id, value DESC) AS rn FROM improvements) WHERE rn = 1)"""
SALE_SQL = """sale1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id, sale_price, sale_date, recording_number
    ORDER BY sale_id DESC NULLS LAST) AS rn FROM sales) WHERE rn = 1)"""


@query("w05_dedupe_land", f"WITH {LAND_SQL} SELECT parcel_id, land_segment_id, CAST(value_year AS BIGINT) AS value_year, land_type, market_value FROM land1")
def _(t):
    return wn.dedupe_land(t.land).select("parcel_id", "land_segment_id", c("value_year").cast("bigint").alias("value_year"), "land_type", "market_value")


@query("w05_dedupe_improvement_ids", f"WITH {IMPR_SQL} SELECT parcel_id, improvement_id, detail_id FROM impr1")
def _(t):
    return wn.dedupe_improvements_by_id(t.improvements).select("parcel_id", "improvement_id", "detail_id")


@query("w05_dedupe_sales", f"WITH {SALE_SQL} SELECT parcel_id, sale_id FROM sale1")
def _(t):
    return wn.dedupe_sales(t.sales).select("parcel_id", "sale_id")


@query(
    "w08_metric_deltas",
    """SELECT hood_code, CAST(metric_year AS BIGINT) AS metric_year, round(lag(cod) OVER w, 6) AS prior_cod, round(lag(prd) OVER w, 6) AS prior_prd,
              round(sales_ratio - lag(sales_ratio) OVER w, 6) AS sales_ratio_delta FROM hood_metrics WINDOW w AS (PARTITION BY hood_code ORDER BY metric_year)""",
)
def _(t):
    return wn.snapshot_delta(t.hood_metrics).select(
        "hood_code", c("metric_year").cast("bigint").alias("metric_year"), *r6("prior_cod", "prior_prd", "sales_ratio_delta")
    )


CADENCE_SQL = """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY created_at DESC, review_id DESC) AS rn FROM reviews) WHERE rn <= 15),
    gaps AS (SELECT place_id, (epoch_us(created_at) - epoch_us(lead(created_at) OVER (PARTITION BY place_id ORDER BY created_at DESC, review_id DESC))) / 86400e6 AS gap FROM newest),
    cadence AS (SELECT place_id, count(*) AS recent, CASE WHEN count(*) >= 2 THEN greatest(avg(gap), 1.0) END AS avg_gap_days FROM gaps GROUP BY 1)"""


@query("w09_review_cadence", f"WITH {CADENCE_SQL} SELECT place_id, recent, round(avg_gap_days, 6) AS avg_gap_days FROM cadence")
def _(t):
    return wn.review_cadence(t.reviews).select("place_id", "recent", *r6("avg_gap_days"))


@query(
    "w11_value_history",
    """SELECT parcel_id, CAST(value_year AS BIGINT) AS year, round(market_total, 2) AS value FROM (
         SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY value_year DESC) AS rn FROM history) WHERE rn <= 3""",
)
def _(t):
    return wn.value_history(history_docs(t), 3).select("parcel_id", c("year").cast("bigint").alias("year"), "value")


@query(
    "w12_ratio_history",
    """SELECT upper(hood_code) AS hood_code, CAST(metric_year AS BIGINT) AS metric_year, round(sales_ratio, 6) AS sales_ratio FROM (
         SELECT *, row_number() OVER (PARTITION BY hood_code ORDER BY metric_year DESC) AS rn FROM hood_metrics) WHERE rn <= 4""",
)
def _(t):
    return wn.ratio_history(t.hood_metrics, 4).select("hood_code", c("metric_year").cast("bigint").alias("metric_year"), *r6("sales_ratio"))


_BASE = """s JOIN parcels p ON s.parcel_id = p.parcel_id WHERE lower(trim(sale_type)) = 'valid sale' AND upper(trim(coalesce(proptype, ''))) = 'R'"""


def _joined(t):
    return t.sales.join(t.parcels, "parcel_id").where("lower(trim(sale_type)) = 'valid sale' AND upper(trim(coalesce(proptype, ''))) = 'R'")


for _sort, (_column, _way) in wn.SORT_FIELDS.items():

    @query(
        f"k01_sales_by_{_sort}",
        f"SELECT s.sale_id, s.parcel_id, s.sale_price FROM sales {_BASE} ORDER BY {_column} {_way} NULLS LAST, sale_id DESC NULLS LAST LIMIT 50",
    )
    def _(t, sort=_sort):
        return wn.sales_list(_joined(t), sort, limit=50).select("sale_id", "parcel_id", "sale_price")


@query(
    "k02_parcel_search_page",
    f"""WITH {LATEST} SELECT p.parcel_id, assessed_value, last_sale_price FROM parcels p LEFT JOIN latest l ON p.parcel_id = l.parcel_id
        WHERE upper(trim(coalesce(proptype, ''))) = 'R' ORDER BY assessed_value DESC NULLS LAST, p.parcel_id LIMIT 25 OFFSET 50""",
)
def _(t):
    page = wn.parcel_search(t.parcels.where("upper(trim(coalesce(proptype, ''))) = 'R'"), page=3, size=25)
    return jn.with_latest_sale(page, t.sales).select("parcel_id", "assessed_value", "last_sale_price")


def _page_index(t):
    path = f"{shared_folder(t.spark)}/pages-{uuid.uuid4().hex}"
    wn.write_page_index(t.parcels.where("upper(trim(coalesce(proptype, ''))) = 'R'").select("parcel_id", "assessed_value"), path, ranges=16)
    return path


_PAGED = """SELECT parcel_id, assessed_value, row_number() OVER (ORDER BY assessed_value DESC NULLS LAST, parcel_id) - 1 AS before
    FROM parcels WHERE upper(trim(coalesce(proptype, ''))) = 'R'"""


@query("k02_deep_page", f"SELECT parcel_id, assessed_value FROM ({_PAGED}) WHERE before >= 12 * 25 AND before < 13 * 25")
def _(t):
    return wn.indexed_page(t.spark, _page_index(t), page=13, size=25)


@query("k02_numbered_pages", f"SELECT parcel_id, before // 25 + 1 AS page, before % 25 + 1 AS place FROM ({_PAGED})")
def _(t):
    return wn.numbered_pages(t.spark, _page_index(t), size=25).select("parcel_id", "page", c("place").cast("bigint").alias("place"))


@query(
    "k03_top_sales",
    f"""SELECT s.sale_id, s.sale_price, round((sale_price - assessed_value) / assessed_value * 100, 6) AS delta_pct FROM sales {_BASE}
        ORDER BY sale_date DESC NULLS LAST, sale_id DESC LIMIT 25""",
)
def _(t):
    return wn.top_sales(t.sales.join(t.parcels, "parcel_id")).select("sale_id", "sale_price", *r6("delta_pct"))


@query(
    "k03_newest_sale_per_parcel",
    f"""SELECT parcel_id, sale_id, delta_pct FROM (SELECT s.parcel_id, s.sale_id, round((sale_price - assessed_value) / assessed_value * 100, 6) AS delta_pct,
        row_number() OVER (PARTITION BY s.parcel_id ORDER BY sale_date DESC NULLS LAST, sale_id DESC) AS rn FROM sales {_BASE}) WHERE rn = 1""",
)
def _(t):
    return wn.newest_sale_detail(t.sales.join(t.parcels, "parcel_id")).select("parcel_id", "sale_id", *r6("delta_pct"))


NOW = dt.datetime(2024, 2, 1)


@query(
    "t02_next_fetch",
    f"""WITH {CADENCE_SQL} SELECT place_id, round(CASE WHEN avg_gap_days IS NOT NULL THEN greatest(3.0, least(45.0, avg_gap_days * 0.8)) ELSE 45.0 END, 6) AS days FROM cadence""",
)
def _(t):
    places = t.reviews.select("place_id").distinct()
    return wn.next_fetch(places, wn.review_cadence(t.reviews), NOW).select("place_id", *r6("days"))


@query(
    "t02_fetch_outcomes",
    f"""WITH {CADENCE_SQL}, f AS (SELECT place_id, avg_gap_days, place_id % 7 = 0 AS failed, place_id % 3 AS inserted, CASE WHEN place_id % 5 = 0 THEN NULL ELSE place_id * 1e0 END AS stored FROM cadence)
        SELECT place_id, round(CASE WHEN failed THEN 1.0 WHEN inserted > 0 THEN greatest(3.0, least(45.0, coalesce(avg_gap_days, 14.0) * 0.8))
               ELSE greatest(3.0, least(45.0, coalesce(nullif(stored, 0), 21.0) * 1.25)) END, 6) AS days FROM f""",
)
def _(t):
    rows = wn.review_cadence(t.reviews).select(
        "place_id", "recent", "avg_gap_days", (c("place_id") % 7 == 0).alias("failed"), (c("place_id") % 3).alias("inserted"),
        F.when(c("place_id") % 5 != 0, c("place_id") * 1e0).alias("stored_gap_days"),
    )
    return wn.fetch_outcome(rows, NOW).select("place_id", *r6("days"))


@query(
    "t03_recent_activity",
    """SELECT event_id, event_type AS label, CAST(value AS VARCHAR) AS value FROM events WHERE event_type <> '' ORDER BY ts DESC, event_id DESC LIMIT 20""",
)
def _(t):
    events = t.events.select("event_id", "ts", c("event_type").alias("label"), c("value").cast("string").alias("value"))
    return wn.recent_activity(events, 20).select("event_id", "label", "value")


@query(
    "t04_due_places",
    """WITH p AS (SELECT place_id, bool_or(source = 'view') AS active, CASE WHEN place_id % 4 = 0 THEN NULL ELSE max(created_at) + INTERVAL 1 DAY * (place_id % 6 - 3) END AS next_at FROM reviews GROUP BY place_id)
       SELECT place_id FROM p WHERE active AND (next_at IS NULL OR next_at <= TIMESTAMP '2024-01-30') ORDER BY next_at ASC NULLS FIRST, place_id LIMIT 40""",
)
def _(t):
    base = t.reviews.groupBy("place_id").agg(F.bool_or(c("source") == "view").alias("active"), F.max("created_at").alias("m"))
    nxt = F.when(c("place_id") % 4 != 0, wn.add_days(c("m"), (c("place_id") % 6 - 3).cast("double")))
    return wn.due(base.withColumn("next_fetch_at", nxt), dt.datetime(2024, 1, 30), 40).select("place_id")
