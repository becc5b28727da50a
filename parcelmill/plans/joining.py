"""Queries for the joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv
from parcelmill.operators import joins as jn
from parcelmill.plans.cleaning import sql_prefixes
from parcelmill.plans.filtering import LATEST, LATEST_VALID
from parcelmill.plans.registry import query

c = F.col

DATASET_SQL = rf"""dataset AS (
    SELECT s.sale_id, s.parcel_id, s.sale_price, s.sale_date, p.assessed_value, p.total_market_value, p.living_area, p.acres AS lot_acres,
           p.year_built, p.eff_year_built, coalesce(p.bedrooms, 0) AS bedrooms, CAST(coalesce(p.bathrooms, 0) AS DOUBLE) AS bathrooms,
           p.quality_score, p.condition_score, p.hood_code AS neighborhood_code, p.land_market_value,
           p.living_area / nullif(p.acres * 43560.0, 0) AS floor_area_ratio,
           CASE WHEN p.garage_sqft > 0 THEN 1 ELSE 0 END AS has_garage, CASE WHEN p.basement_sqft > 0 THEN 1 ELSE 0 END AS has_basement,
           CASE WHEN {" OR ".join(f"p.hood_code ILIKE '%{m}%'" for m in fv.VIEW_MARKS)} THEN 1 ELSE 0 END AS is_view,
           coalesce({sql_prefixes('p.hood_code', fv.AREAS_LONG)}, 'OTHER') AS valuation_area
    FROM sales s JOIN parcels p ON s.parcel_id = p.parcel_id
    WHERE s.sale_type = 'VALID SALE' AND s.sale_price > 10000 AND s.sale_date >= TIMESTAMP '1995-01-01' AND p.living_area > 0 AND p.acres > 0
      AND coalesce(p.proptype, '') = 'R' AND regexp_matches(trim(p.land_use_code), '^\d+$') AND TRY_CAST(trim(p.land_use_code) AS INT) IN (110, 111, 112, 113))"""


def dataset(t):
    return jn.regression_dataset(t.sales, t.parcels, "sfr", since="1995-01-01")


@query(
    "j01_model_dataset",
    f"""WITH {DATASET_SQL}
        SELECT sale_id, parcel_id, sale_price, CAST(CAST(sale_date AS DATE) AS VARCHAR) AS sale_day, living_area, lot_acres, CAST(year_built AS BIGINT) AS year_built,
               CAST(bedrooms AS BIGINT) AS bedrooms, bathrooms, has_garage, has_basement, is_view, valuation_area,
               round(floor_area_ratio, 9) AS floor_area_ratio, land_market_value FROM dataset""",
)
def _(t):
    return dataset(t).select(
        "sale_id", "parcel_id", "sale_price", c("sale_date").cast("date").cast("string").alias("sale_day"), "living_area",
        "lot_acres", c("year_built").cast("bigint").alias("year_built"), c("bedrooms").cast("bigint").alias("bedrooms"), "bathrooms",
        "has_garage", "has_basement", "is_view", "valuation_area", F.round("floor_area_ratio", 9).alias("floor_area_ratio"),
        "land_market_value",
    )


@query(
    "j03_latest_sale",
    f"""WITH {LATEST} SELECT p.parcel_id, last_sale_price, CAST(CAST(last_sale_date AS DATE) AS VARCHAR) AS last_day FROM parcels p
        LEFT JOIN latest l ON p.parcel_id = l.parcel_id""",
)
def _(t):
    return jn.with_latest_sale(t.parcels, t.sales).select(
        "parcel_id", "last_sale_price", c("last_sale_date").cast("date").cast("string").alias("last_day")
    )


@query(
    "j04_latest_valid_sale",
    f"""WITH {LATEST_VALID} SELECT parcel_id, last_sale_price, CAST(CAST(last_sale_date AS DATE) AS VARCHAR) AS last_day, last_deed_type FROM latest_valid""",
)
def _(t):
    return jn.latest_valid_sale(t.sales).select(
        "parcel_id", "last_sale_price", c("last_sale_date").cast("date").cast("string").alias("last_day"), "last_deed_type"
    )


@query(
    "j05_roll_change",
    """WITH v AS (SELECT parcel_id, roll_year, coalesce(total_market_value, assessed_value) AS value FROM rolls)
       SELECT a.parcel_id, a.value AS active_value, b.value AS prior_value,
              round(CASE WHEN b.value <> 0 THEN (a.value - b.value) * 100 / b.value END, 6) AS change_pct
       FROM v a LEFT JOIN v b ON a.parcel_id = b.parcel_id AND b.roll_year = 2024 WHERE a.roll_year = 2025""",
)
def _(t):
    return jn.roll_change(t.rolls, 2025).withColumn("change_pct", F.round("change_pct", 6))


_IMP_TEXT = """imp AS (SELECT parcel_id, detail_id, 2024 + CAST(detail_id % 2 AS INT) AS roll_year,
        CASE detail_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '¾' ELSE CAST(detail_id % 6 AS {s}) || ' br' END AS bedrooms_text,
        plumbing AS plumbing_text, CAST(detail_id % 4 AS {s}) AS rooms_text FROM {i} WHERE value > 30000),
    gaps AS (SELECT parcel_id, CASE WHEN parcel_id % 2 = 0 THEN bedrooms END AS bedrooms, CASE WHEN parcel_id % 3 = 0 THEN bathrooms END AS bathrooms FROM {p})"""


@query(
    "j06_fill_from_improvements",
    f"""WITH {_IMP_TEXT.format(s='VARCHAR', i='improvements', p='parcels')},
        first_imp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY roll_year DESC, detail_id, bedrooms_text NULLS FIRST, plumbing_text NULLS FIRST) AS rn
                      FROM imp) WHERE rn = 1),
        parsed AS (SELECT parcel_id,
            nullif(CASE WHEN bedrooms_text IS NULL THEN NULL WHEN bedrooms_text = '¾' THEN 0.75 ELSE TRY_CAST(regexp_extract(bedrooms_text, '\\d+', 0) AS DOUBLE) END, 0) AS fb,
            coalesce(nullif(CASE WHEN contains(plumbing_text, 'QB') THEN 0.75 ELSE TRY_CAST(regexp_extract(plumbing_text, '\\d+', 0) AS DOUBLE) END, 0),
                     nullif(TRY_CAST(rooms_text AS DOUBLE), 0)) AS fba FROM first_imp)
        SELECT g.parcel_id,
            CASE WHEN bedrooms IS NULL AND bathrooms IS NULL THEN fb ELSE CAST(bedrooms AS DOUBLE) END AS bedrooms,
            CASE WHEN bedrooms IS NULL AND bathrooms IS NULL THEN fba ELSE CAST(bathrooms AS DOUBLE) END AS bathrooms,
            (bedrooms IS NULL AND bathrooms IS NULL AND coalesce(fb, fba) IS NOT NULL) AS filled
        FROM gaps g LEFT JOIN parsed f ON g.parcel_id = f.parcel_id""",
)
def _(t):
    sql = _IMP_TEXT.format(s="STRING", i="{improvements}", p="{parcels}")
    imp, gaps = t.sql("WITH " + sql + " SELECT * FROM imp"), t.sql("WITH " + sql + " SELECT * FROM gaps")
    return jn.fallback_fill(gaps, imp, [2025, 2024]).select(
        "parcel_id", c("bedrooms").cast("double").alias("bedrooms"), c("bathrooms").cast("double").alias("bathrooms"), "filled"
    )


@query(
    "j07_acres_from_land",
    """WITH s AS (SELECT parcel_id, sum(size_acres) AS a, sum(size_sqft) AS q FROM land GROUP BY parcel_id),
            n AS (SELECT parcel_id, CASE WHEN coalesce(a, 0) <> 0 THEN a ELSE q / 43560.0 END AS na FROM s),
            j AS (SELECT p.parcel_id, p.acres, n.na, n.na > 0 AND (p.acres IS NULL OR abs(p.acres - n.na) >= 1e-4) AS up
                  FROM parcels p LEFT JOIN n ON p.parcel_id = n.parcel_id)
       SELECT parcel_id, round(CASE WHEN coalesce(up, false) THEN na ELSE acres END, 6) AS acres, coalesce(up, false) AS acres_updated FROM j""",
)
def _(t):
    return jn.backfill_acres(t.parcels, t.land).select("parcel_id", F.round("acres", 6).alias("acres"), "acres_updated")


@query(
    "j08_zoning_rule_lookup",
    """WITH r AS (SELECT zone_code, source, min(zone_id) AS rule_id FROM zones WHERE zone_rank > 10 GROUP BY zone_code, source)
       SELECT z.zone_id, r.rule_id FROM zones z LEFT JOIN r ON lower(z.zone_code) = lower(r.zone_code) AND lower(z.source) = lower(r.source)""",
)
def _(t):
    zones = t.zones.withColumnRenamed("source", "jurisdiction")
    rules = zones.where("zone_rank > 10").groupBy("zone_code", "jurisdiction").agg(F.min("zone_id").alias("rule_id"))
    facts = zones.select("zone_id", F.upper("zone_code").alias("zone_code"), F.upper("jurisdiction").alias("jurisdiction"))
    return jn.lookup_zoning(facts, rules).select("zone_id", "rule_id")


@query(
    "j09_parcels_with_improvements",
    """SELECT parcel_id, true AS improved FROM parcels WHERE parcel_id IN (SELECT parcel_id FROM improvements WHERE value > 90000)
       UNION ALL SELECT parcel_id, false FROM parcels WHERE parcel_id NOT IN (SELECT parcel_id FROM improvements WHERE value > 90000)""",
)
def _(t):
    big, ids = t.improvements.where("value > 90000"), t.parcels.select("parcel_id")
    return (
        jn.with_rows_in(ids, big, "parcel_id").withColumn("improved", F.lit(True))
        .unionByName(jn.without_rows_in(ids, big, "parcel_id").withColumn("improved", F.lit(False)))
    )


@query(
    "j10_history_with_hood",
    "SELECT h.parcel_id, h.value_year, h.market_total, trim(p.hood_code) AS hood_code FROM history h JOIN parcels p ON h.parcel_id = p.parcel_id WHERE trim(p.hood_code) <> ''",
)
def _(t):
    return jn.history_with_hood(t.history, t.parcels).select("parcel_id", "value_year", "market_total", "hood_code")


@query(
    "j11_coefficient_sets",
    """WITH r AS (SELECT market_group, run_id FROM (SELECT market_group, run_id, row_number() OVER (PARTITION BY market_group ORDER BY max(created_at) DESC, run_id DESC) AS rn
                  FROM coefficients GROUP BY market_group, run_id) WHERE rn = 1)
       SELECT k.market_group, k.run_id, k.term, k.beta FROM coefficients k JOIN r ON k.market_group = r.market_group AND k.run_id = r.run_id
       WHERE k.term NOT IN ('const', 'missing_quality', 'missing_condition') AND NOT starts_with(k.term, 'pt_')""",
)
def _(t):
    sets = jn.coefficient_sets(t.coefficients)
    return sets.select("market_group", "run_id", F.explode("betas").alias("term", "beta"))


@query(
    "j13_subject_snapshots",
    f"""WITH {LATEST_VALID},
        n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY roll_year DESC, roll_id DESC) AS rn FROM rolls) WHERE rn = 1)
        SELECT n.parcel_id, CAST(n.roll_year AS BIGINT) AS roll_year, coalesce(total_market_value, assessed_value) AS value, last_sale_price
        FROM n LEFT JOIN latest_valid v ON n.parcel_id = v.parcel_id""",
)
def _(t):
    return jn.subject_snapshot(t.rolls, t.sales).select(
        "parcel_id", c("roll_year").cast("bigint").alias("roll_year"), "value", "last_sale_price"
    )


@query(
    "w01_latest_roll",
    """SELECT parcel_id, CAST(roll_year AS BIGINT) AS roll_year, roll_id FROM (
         SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY roll_year DESC NULLS LAST, roll_id DESC) AS rn FROM rolls) WHERE rn = 1""",
)
def _(t):
    return jn.latest_roll(t.rolls).select("parcel_id", c("roll_year").cast("bigint").alias("roll_year"), "roll_id")
