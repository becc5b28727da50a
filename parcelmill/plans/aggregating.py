"""Queries for rollups, profiles, trends and run summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv
from parcelmill.operators import joins as jn
from parcelmill.operators import rollups as ru
from parcelmill.operators import summaries as sm
from parcelmill.plans.cleaning import _DISPLAY, sql_map, sql_prefixes
from parcelmill.plans.registry import query

c = F.col


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


CLEAN_SQL = """cleaned AS (
    SELECT parcel_id, detail_id, type_code, class_code, condition_code, plumbing,
           CASE WHEN area > 0 AND area <= 50000 THEN area END AS area,
           CASE WHEN year_built BETWEEN 1700 AND 2050 THEN year_built END AS year_built,
           CASE WHEN eff_year_built BETWEEN 1700 AND 2050 THEN eff_year_built END AS eff_year_built FROM improvements),
    deduped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id, type_code, area, year_built, eff_year_built
        ORDER BY detail_id, class_code, condition_code, plumbing NULLS FIRST) AS rn FROM cleaned) WHERE rn = 1)"""

ROLLUP_SQL = f"""{CLEAN_SQL},
    kinds AS (SELECT *, coalesce({sql_map('type_code', fv.EXACT_CODES)}, {sql_prefixes('type_code', fv.MASTER_PREFIXES)}, 'other') AS kind,
              {sql_map('class_code', fv.QUALITY_SCORES, text=False)} AS q, {sql_map('condition_code', fv.CONDITION_SCORES, text=False)} AS cs,
              coalesce(list_sum(list_transform(string_split(plumbing, ','), lambda w: {sql_map('upper(trim(w))', fv.MASTER_BATHS, '0', text=False)})), 0) AS bath
              FROM deduped),
    main1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY area DESC NULLS LAST, year_built DESC NULLS LAST, detail_id) AS pr
              FROM kinds WHERE kind = 'main_structure') WHERE pr = 1),
    sums AS (SELECT parcel_id, CAST(sum(bath) AS DOUBLE) AS total_baths, max(year_built) AS year_built_max, min(year_built) AS year_built_min,
        coalesce(sum(area) FILTER (kind IN ('main_structure', 'basement')), 0) AS total_living_area,
        coalesce(sum(area) FILTER (kind = 'garage'), 0) AS total_garage_area, coalesce(sum(area) FILTER (kind = 'deck'), 0) AS total_deck_area,
        coalesce(sum(area) FILTER (kind = 'porch'), 0) AS total_porch_area, coalesce(sum(area) FILTER (kind = 'basement'), 0) AS total_basement_area,
        coalesce(sum(area) FILTER (kind = 'shop'), 0) AS total_shop_area, count(*) FILTER (kind = 'shop') AS total_shop_count,
        count(*) FILTER (kind = 'shed') AS total_shed_count, coalesce(sum(area) FILTER (kind = 'shed'), 0) AS total_shed_area,
        bool_or(kind = 'pool') AS has_pool, count(*) FILTER (kind = 'main_structure') AS main_structure_count
        FROM kinds GROUP BY parcel_id),
    rollup_rows AS (SELECT s.*, main_structure_count > 1 AS flag_multi_structure, m.q AS quality_score, m.cs AS condition_score, m.eff_year_built AS effective_year_built
        FROM sums s LEFT JOIN main1 m ON s.parcel_id = m.parcel_id)"""


def rollup(t):
    return ru.rollup_improvements(ru.dedupe_improvements(ru.clean_improvements(t.improvements)))


@query("w03_dedupe_improvements", f"WITH {CLEAN_SQL} SELECT parcel_id, detail_id, type_code, area FROM deduped")
def _(t):
    return ru.dedupe_improvements(ru.clean_improvements(t.improvements)).select("parcel_id", "detail_id", "type_code", "area")


_ROLLUP_COLUMNS = [
    "parcel_id", "total_baths", "year_built_max", "year_built_min", "total_living_area", "total_garage_area", "total_deck_area",
    "total_porch_area", "total_basement_area", "total_shop_area", "total_shop_count", "total_shed_count", "total_shed_area", "has_pool",
]


@query("a01_improvement_rollup", f"WITH {ROLLUP_SQL} SELECT {', '.join(_ROLLUP_COLUMNS)} FROM rollup_rows")
def _(t):
    return rollup(t).select(*_ROLLUP_COLUMNS)


_PRIMARY = ["parcel_id", "quality_score", "condition_score", "effective_year_built", "main_structure_count", "flag_multi_structure"]


@query("a02_primary_structure", f"WITH {ROLLUP_SQL} SELECT {', '.join(_PRIMARY)} FROM rollup_rows")
def _(t):
    return rollup(t).select(*_PRIMARY)


@query(
    "j02_master_table",
    f"""WITH {ROLLUP_SQL} SELECT p.parcel_id, coalesce(total_living_area, living_area) AS final_living_area,
        CAST(coalesce(year_built_min, year_built) AS BIGINT) AS final_year_built, total_garage_area AS final_garage_area,
        CAST(coalesce(effective_year_built, eff_year_built) AS BIGINT) AS final_eff_year_built
        FROM parcels p LEFT JOIN rollup_rows r ON p.parcel_id = r.parcel_id WHERE p.proptype NOT IN ('P', 'C')""",
)
def _(t):
    roll = t.parcels.where(~c("proptype").isin("P", "C")).drop("quality_score", "condition_score")
    return jn.build_master(roll, rollup(t)).select(
        "parcel_id", "final_living_area", c("final_year_built").cast("bigint").alias("final_year_built"), "final_garage_area",
        c("final_eff_year_built").cast("bigint").alias("final_eff_year_built"),
    )


_BATH_SQL = f"""tok AS (SELECT detail_id, parcel_id, upper(trim(unnest(regexp_split_to_array(coalesce(plumbing, ''), '[;,]+|\\s+')))) AS k FROM improvements),
    bparts AS (SELECT parcel_id, k, regexp_extract(k, '^(\\d+)([A-Z]+)', 1) AS d, regexp_extract(k, '^(\\d+)([A-Z]+)', 2) AS b FROM tok),
    bval AS (SELECT parcel_id, {sql_map("CASE WHEN d <> '' THEN b ELSE k END", fv.ROLL_BATHS, text=False)} AS v,
             CASE WHEN d = '' THEN 1 WHEN length(d) = 1 AND b = 'QB' THEN 1 WHEN replace(d, d[1], '') = '' THEN CAST(d[1] AS INT) ELSE TRY_CAST(d AS INT) END AS n FROM bparts),
    baths AS (SELECT parcel_id, sum(CASE WHEN v = 1.0 THEN n ELSE 0 END) AS bf, sum(CASE WHEN v = 0.5 THEN n ELSE 0 END) AS bh,
              sum(CASE WHEN v = 0.75 THEN n ELSE 0 END) AS bq FROM bval GROUP BY parcel_id)"""

_ACC_SQL = f"""{_BATH_SQL},
    base AS (SELECT *, CAST(trunc(value) AS BIGINT) AS v, coalesce(nullif(area, 0), 0) AS a,
             {sql_map('type_code', fv.EXACT_CODES)} AS ex, {sql_prefixes('type_code', _DISPLAY)} AS shown FROM improvements),
    k AS (SELECT *, coalesce(ex, {sql_prefixes('type_code', fv.ROLL_PREFIXES)}, CASE shown WHEN 'garage' THEN 'garage'
             WHEN 'outbuilding' THEN 'outbuilding' WHEN 'home' THEN 'main_structure' ELSE 'misc' END) AS kind,
             CASE WHEN {" OR ".join(f"starts_with(type_code, '{p}')" for p in fv.MAIN_PREFIXES)} THEN 2 ELSE 1 END AS w,
             {sql_map('class_code', fv.QUALITY_SCORES, text=False)} AS q, {sql_map('condition_code', fv.CONDITION_SCORES, text=False)} AS cs FROM base)"""


@query(
    "a04_roll_accumulator",
    f"""WITH {_ACC_SQL}
        SELECT k.parcel_id,
          coalesce(sum(a) FILTER (kind IN ('shop', 'shed', 'outbuilding')), 0) AS total_outbuilding_area, coalesce(sum(a) FILTER (kind = 'deck'), 0) AS total_deck_area,
          coalesce(sum(a) FILTER (kind = 'garage'), 0) AS total_garage_area, coalesce(sum(a) FILTER (kind = 'basement'), 0) AS total_basement_area,
          coalesce(sum(a) FILTER (kind IN ('main_structure', 'basement')), 0) AS calculated_sqft, CAST(sum(v) AS BIGINT) AS total_improvement_value,
          count(*) FILTER (kind = 'shed') AS number_of_sheds, count(*) FILTER (kind = 'shop') AS number_of_shops,
          count(*) FILTER (kind IN ('shop', 'shed', 'outbuilding', 'garage')) AS number_of_outbuildings,
          CAST(coalesce(sum(fireplaces), 0) AS BIGINT) AS number_of_fireplaces, bool_or(kind = 'shop') AS has_shop, bool_or(kind = 'deck' AND a > 0) AS has_deck,
          CASE WHEN bool_or(kind = 'basement' AND (starts_with(type_code, 'BMF') OR starts_with(type_code, 'BMG'))) THEN true
               WHEN bool_or(kind = 'basement') THEN false END AS has_finished_basement,
          CAST(CASE WHEN any_value(bf + bh + bq) > 0 THEN any_value(bf + bh * 0.5 + bq * 0.25) END AS DOUBLE) AS bathrooms,
          CAST(CASE WHEN any_value(bf + bh + bq) > 0 THEN any_value(bf) END AS BIGINT) AS full_bathrooms
        FROM k JOIN baths ON k.parcel_id = baths.parcel_id GROUP BY k.parcel_id""",
)
def _(t):
    return ru.accumulate_parcels(t.improvements).select(
        "parcel_id", "total_outbuilding_area", "total_deck_area", "total_garage_area", "total_basement_area", "calculated_sqft",
        "total_improvement_value", "number_of_sheds", "number_of_shops", "number_of_outbuildings",
        c("number_of_fireplaces").cast("bigint").alias("number_of_fireplaces"), "has_shop", "has_deck", "has_finished_basement",
        c("bathrooms").cast("double").alias("bathrooms"), "full_bathrooms",
    )


@query(
    "a05_quality_condition",
    f"""WITH {_ACC_SQL},
        best AS (SELECT parcel_id, condition_code, cs FROM (SELECT parcel_id, condition_code, cs, row_number() OVER (PARTITION BY parcel_id ORDER BY cs DESC, w DESC, condition_code) AS rn
                 FROM k WHERE cs IS NOT NULL) WHERE rn = 1),
        qq AS (SELECT parcel_id, round(CAST(sum(q * w) AS DOUBLE) / sum(w) FILTER (q IS NOT NULL), 6) AS quality_score FROM k GROUP BY parcel_id)
        SELECT qq.parcel_id, quality_score, condition_code, cs AS condition_score FROM qq LEFT JOIN best ON qq.parcel_id = best.parcel_id""",
)
def _(t):
    return ru.accumulate_parcels(t.improvements).select("parcel_id", *r6("quality_score"), "condition_code", "condition_score")


@query(
    "a06_best_years",
    f"""WITH {_ACC_SQL},
        e AS (SELECT parcel_id, eff_year_built FROM (SELECT parcel_id, eff_year_built, row_number() OVER (PARTITION BY parcel_id ORDER BY v DESC, eff_year_built DESC) AS rn FROM k WHERE eff_year_built IS NOT NULL) WHERE rn = 1),
        y AS (SELECT parcel_id, year_built FROM (SELECT parcel_id, year_built, row_number() OVER (PARTITION BY parcel_id ORDER BY v DESC, year_built DESC) AS rn FROM k WHERE year_built IS NOT NULL) WHERE rn = 1),
        n AS (SELECT parcel_id, max(new_const_year) AS new_construction_year FROM k GROUP BY parcel_id)
        SELECT n.parcel_id, coalesce(e.eff_year_built, y.year_built) AS improvement_year_built, new_construction_year
        FROM n LEFT JOIN e ON n.parcel_id = e.parcel_id LEFT JOIN y ON n.parcel_id = y.parcel_id""",
)
def _(t):
    return ru.accumulate_parcels(t.improvements).select("parcel_id", "improvement_year_built", "new_construction_year")


@query(
    "a07_plain_quality",
    f"""WITH m AS (SELECT parcel_id, {sql_map('class_code', fv.QUALITY_SCORES, text=False)} AS q, condition_code AS cc, {sql_map('condition_code', fv.CONDITION_SCORES, text=False)} AS cs
               FROM improvements WHERE {" OR ".join(f"starts_with(type_code, '{p}')" for p in fv.MAIN_AREA_PREFIXES)}),
        b AS (SELECT parcel_id, cc, cs FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY cs DESC, cc) AS rn FROM m WHERE cs IS NOT NULL) WHERE rn = 1),
        a AS (SELECT parcel_id, round(avg(q), 6) AS quality_score FROM m GROUP BY parcel_id)
        SELECT a.parcel_id, quality_score, coalesce(cc, 'U') AS condition_code, coalesce(cs, 3) AS condition_score FROM a LEFT JOIN b ON a.parcel_id = b.parcel_id""",
)
def _(t):
    return ru.quality_condition_simple(t.improvements).select("parcel_id", *r6("quality_score"), "condition_code", "condition_score")


@query(
    "a08_bath_totals",
    f"""SELECT parcel_id, CAST(sum(coalesce(list_sum(list_transform(string_split(plumbing, ','), lambda w: {sql_map('upper(trim(w))', fv.HOME_BATHS, '0', text=False)})), 0)) AS DOUBLE) AS bathrooms
        FROM improvements WHERE ({" OR ".join(f"starts_with(type_code, '{p}')" for p in fv.HOME_PREFIXES)}) AND trim(plumbing) <> '' GROUP BY parcel_id""",
)
def _(t):
    return ru.bath_totals(t.improvements)


DETAIL_SQL = """detail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id, improvement_id, type_code
    ORDER BY eff_year_built DESC NULLS FIRST, year_built DESC NULLS FIRST, value DESC, detail_id DESC) AS rn FROM improvements) WHERE rn = 1)"""


@query("w04_dedupe_details", f"WITH {DETAIL_SQL} SELECT parcel_id, improvement_id, type_code, detail_id FROM detail")
def _(t):
    return ru.dedupe_details(t.improvements).select("parcel_id", "improvement_id", "type_code", "detail_id")


@query(
    "a09_display_rollup",
    f"""WITH {DETAIL_SQL},
        d AS (SELECT *, starts_with(type_code, 'MA') AS main, CASE WHEN TRY_CAST(substr(type_code, 3) AS DOUBLE) IS NOT NULL THEN substr(type_code, 3) ELSE '1' END AS story,
              coalesce(area, 0) AS a FROM detail),
        st AS (SELECT parcel_id, building_style FROM (SELECT parcel_id, building_style, row_number() OVER (PARTITION BY parcel_id ORDER BY improvement_id,
               eff_year_built DESC NULLS FIRST, year_built DESC NULLS FIRST, value DESC, detail_id DESC) AS rn FROM d WHERE trim(building_style) <> '') WHERE rn = 1),
        qn AS (SELECT parcel_id, class_code, count(*) AS n FROM d WHERE main GROUP BY 1, 2),
        qq AS (SELECT parcel_id, class_code FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY {sql_map('class_code', fv.QUALITY_WEIGHTS, '0', text=False)} DESC, n DESC, class_code) AS rn FROM qn) WHERE rn = 1),
        cn AS (SELECT parcel_id, condition_code, count(*) AS n FROM d WHERE main GROUP BY 1, 2),
        cc AS (SELECT parcel_id, condition_code FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY n DESC, {sql_map('condition_code', fv.CONDITION_ORDER, '-1', text=False)} DESC, condition_code) AS rn FROM cn) WHERE rn = 1),
        sy AS (SELECT parcel_id, story, sum(a) AS s FROM d WHERE main GROUP BY 1, 2 HAVING sum(a) <> 0),
        bs AS (SELECT parcel_id, string_agg(story || '=' || CAST(CAST(round(s) AS INT) AS VARCHAR), ';' ORDER BY story) AS by_story FROM sy GROUP BY 1),
        oc AS (SELECT parcel_id, type_code, sum(a) AS s, count(*) AS n FROM d WHERE NOT main GROUP BY 1, 2),
        orank AS (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY s DESC, type_code) AS rn FROM oc),
        mc AS (SELECT parcel_id, type_code, sum(a) AS s FROM d WHERE main GROUP BY 1, 2),
        mcode AS (SELECT parcel_id, type_code FROM (SELECT *, row_number() OVER (PARTITION BY parcel_id ORDER BY s DESC, type_code) AS rn FROM mc) WHERE rn = 1),
        ma AS (SELECT parcel_id, sum(s) AS main_area FROM mc GROUP BY 1),
        p AS (SELECT DISTINCT parcel_id FROM d),
        comps AS (SELECT o.parcel_id, string_agg(o.type_code || ':' || o.n || ':' || CAST(round(o.s) AS INT), ';' ORDER BY o.rn) AS components
                  FROM orank o LEFT JOIN mcode m ON o.parcel_id = m.parcel_id WHERE m.type_code IS NOT NULL OR o.rn > 1 GROUP BY 1)
        SELECT p.parcel_id, CASE building_style WHEN 'two story' THEN 'Two Story' WHEN 'RAMBLER' THEN 'Rambler' END AS style,
               class_code AS quality_code, condition_code, CAST(round(coalesce(main_area, 0)) AS INT) AS main_sqft, by_story, coalesce(components, '') AS components,
               coalesce(m.type_code, o1.type_code) AS primary_code
        FROM p LEFT JOIN st ON p.parcel_id = st.parcel_id LEFT JOIN qq ON p.parcel_id = qq.parcel_id LEFT JOIN cc ON p.parcel_id = cc.parcel_id
          LEFT JOIN bs ON p.parcel_id = bs.parcel_id LEFT JOIN ma ON p.parcel_id = ma.parcel_id LEFT JOIN comps ON p.parcel_id = comps.parcel_id
          LEFT JOIN mcode m ON p.parcel_id = m.parcel_id LEFT JOIN orank o1 ON p.parcel_id = o1.parcel_id AND o1.rn = 1""",
)
def _(t):
    out = ru.display_rollup(ru.dedupe_details(t.improvements))
    story = F.array_join(F.transform(F.sort_array(F.map_entries("by_story")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    parts = F.array_join(
        F.transform("components", lambda x: F.concat_ws(":", x["code"], x["count"].cast("string"), x["total_sqft"].cast("string"))), ";"
    )
    return out.select(
        "parcel_id", "style", "quality_code", "condition_code", "main_sqft", story.alias("by_story"), parts.alias("components"), "primary_code"
    )


for _name, _metric, _sql in (
    ("avg_assessed", "avg_assessed_value", "avg(assessed_value)"),
    ("avg_market", "avg_market_value", "avg(total_market_value)"),
    ("total_assessed", "total_assessed_value", "sum(assessed_value)"),
    ("count", "parcel_count", "CAST(count(*) AS DOUBLE)"),
):

    @query(
        f"a10_summary_{_name}",
        f"""SELECT hood_code AS group_value, round({_sql}, 6) AS metric_value, count(*) AS parcel_count FROM parcels
            WHERE upper(trim(coalesce(proptype, ''))) = 'R' GROUP BY hood_code ORDER BY {_sql} DESC NULLS LAST, hood_code LIMIT 50""",
    )
    def _(t, metric=_metric):
        rows = t.parcels.where("upper(trim(coalesce(proptype, ''))) = 'R'")
        return sm.parcel_summary(rows, "hood_code", metric).withColumn("metric_value", F.round("metric_value", 6))


def _q(col, p):
    return f"quantile_cont({col}, {p})"


_TAX = "TRY_CAST(nullif(regexp_replace(total_taxes, '[^0-9.]', '', 'g'), '') AS DOUBLE)"
_STATS = {
    "med_year": _q("CAST(year_built AS DOUBLE)", 0.5), "med_sqft": _q("living_area", 0.5), "sqft_p25": _q("living_area", 0.25),
    "sqft_p75": _q("living_area", 0.75), "med_acres": _q("acres", 0.5), "acres_p25": _q("acres", 0.25), "acres_p75": _q("acres", 0.75),
    "med_bath": _q("CAST(bathrooms AS DOUBLE)", 0.5), "med_bed": _q("CAST(bedrooms AS DOUBLE)", 0.5), "med_garage": _q("garage_sqft", 0.5),
    "med_assessed": _q("assessed_value", 0.5), "med_tax": _q(_TAX, 0.5),
}


@query(
    "a11_hood_stats",
    f"""SELECT hood_code, count(*) AS parcels, CAST(min(year_built) AS BIGINT) AS min_year, CAST(max(year_built) AS BIGINT) AS max_year,
        count(*) FILTER (2024 - year_built <= 20) AS age_0_20, count(*) FILTER (2024 - year_built BETWEEN 21 AND 40) AS age_20_40,
        count(*) FILTER (2024 - year_built BETWEEN 41 AND 60) AS age_40_60, count(*) FILTER (2024 - year_built > 60) AS age_60_plus,
        count(*) FILTER (year_built = 2022) AS built_2022, count(*) FILTER (year_built = 2023) AS built_2023, count(*) FILTER (year_built = 2024) AS built_2024,
        count(bedrooms) AS cnt_bed, count(building_style) AS cnt_style, round(count(*) FILTER (basement_sqft > 0) * 100.0 / count(*), 2) AS pct_basement,
        {', '.join(f'round({v}, 6) AS {k}' for k, v in _STATS.items())} FROM parcels GROUP BY hood_code""",
)
def _(t):
    out = sm.hood_stats(t.parcels, 2024)
    return out.select(
        "hood_code", "parcels", c("min_year").cast("bigint").alias("min_year"), c("max_year").cast("bigint").alias("max_year"), "age_0_20", "age_20_40",
        "age_40_60", "age_60_plus", "built_2022", "built_2023", "built_2024", "cnt_bed", "cnt_style", c("pct_basement").cast("double").alias("pct_basement"), *r6(*_STATS),
    )


@query(
    "a12_bedroom_distribution",
    """SELECT hood_code, CAST(bedrooms AS BIGINT) AS bedrooms, count(*) AS "count", CAST(round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY hood_code), 2) AS DOUBLE) AS percent
       FROM parcels WHERE bedrooms IS NOT NULL GROUP BY hood_code, bedrooms""",
)
def _(t):
    return sm.distribution(t.parcels, "hood_code", "bedrooms").select(
        "hood_code", c("bedrooms").cast("bigint").alias("bedrooms"), "count", c("percent").cast("double").alias("percent")
    )


_HIST_SQL = """rows_ AS (SELECT p.hood_code, CAST(year(s.sale_date) AS BIGINT) AS sale_year, s.sale_price, s.sale_price / p.living_area AS ppsf
        FROM sales s JOIN parcels p ON s.parcel_id = p.parcel_id WHERE s.sale_price > 0 AND p.living_area > 0 AND s.sale_date >= TIMESTAMP '1996-01-01'
          AND s.deed_type IN ('WARRANTY DEED', 'STATUTORY WARRANTY DEED')),
    agg AS (SELECT hood_code, sale_year, count(*) AS sales, quantile_cont(sale_price, 0.5) AS mp, quantile_cont(ppsf, 0.5) AS mf FROM rows_ GROUP BY 1, 2),
    spine AS (SELECT hood_code, CAST(y AS BIGINT) AS sale_year FROM (SELECT DISTINCT hood_code FROM agg), range(1996, 2004) AS r(y))"""


@query(
    "a13_sales_history",
    f"""WITH {_HIST_SQL} SELECT s.hood_code, s.sale_year, coalesce(sales, 0) AS sales, round(mp, 6) AS median_price, round(mf, 2) AS median_ppsf
        FROM spine s LEFT JOIN agg a ON s.hood_code = a.hood_code AND s.sale_year = a.sale_year""",
)
def _(t):
    return sm.sales_history(t.sales, t.parcels, 1996, 2003).select(
        "hood_code", c("sale_year").cast("bigint").alias("sale_year"), "sales", *r6("median_price"), "median_ppsf"
    )


@query(
    "a15_group_medians",
    """SELECT city_district, count(*) AS samples, round(quantile_cont(assessed_value, 0.5), 6) AS median_assessed_value,
       round(quantile_cont(land_market_value, 0.5), 6) AS median_land_market_value FROM parcels GROUP BY 1""",
)
def _(t):
    out = sm.group_medians(t.parcels, "city_district", ["assessed_value", "land_market_value"])
    return out.select("city_district", "samples", *r6("median_assessed_value", "median_land_market_value"))


@query(
    "a16_hood_profiles",
    f"""WITH {_HIST_SQL},
        tot AS (SELECT hood_code, sum(sales) AS n, coalesce(max(sales) FILTER (sale_year = 2000), 0) AS before_n FROM agg GROUP BY 1 HAVING sum(sales) >= 10),
        st AS (SELECT hood_code, count(*) AS parcels, quantile_cont(assessed_value, 0.5) AS ma, quantile_cont({_TAX}, 0.5) AS mt FROM parcels GROUP BY 1),
        nowp AS (SELECT hood_code, sales, mp FROM agg WHERE sale_year = 2001), bef AS (SELECT hood_code, sales, mp FROM agg WHERE sale_year = 2000)
        SELECT st.hood_code, parcels, round(before_n * 100.0 / parcels, 2) AS turnover_rate, round(mt / ma * 100, 2) AS effective_tax_rate,
               round(CASE WHEN coalesce(nowp.sales, 0) > 0 THEN nowp.mp ELSE bef.mp END, 6) AS recent_median
        FROM st JOIN tot ON st.hood_code = tot.hood_code LEFT JOIN nowp ON st.hood_code = nowp.hood_code LEFT JOIN bef ON st.hood_code = bef.hood_code""",
)
def _(t):
    stats = sm.hood_stats(t.parcels, 2001)
    history = sm.sales_history(t.sales, t.parcels, 1996, 2003)
    profiles = sm.hood_profile(
        stats, history,
        {"bedroom_counts": sm.distribution(t.parcels, "hood_code", "bedrooms"), "styles": sm.distribution(t.parcels, "hood_code", "building_style")},
        {"schools": sm.group_medians(t.parcels, "hood_code", ["acres"])}, 2001,
    )
    return profiles.select(
        "hood_code", c("profile.parcels").alias("parcels"), c("profile.turnover_rate").cast("double").alias("turnover_rate"),
        c("profile.effective_tax_rate").alias("effective_tax_rate"), F.round("profile.sales_summary.median_price", 6).alias("recent_median"),
    )


def history_docs(t):
    """Yearly records per parcel as text maps, the shape a history page yields."""
    money = lambda x: F.concat(F.lit("$"), F.format_string("%.2f", c(x)))
    record = F.create_map(
        F.lit("VALUE YEAR"), c("value_year").cast("string"), F.lit("MARKET TOTAL"), money("market_total"),
        F.lit("LAND MARKET"), F.when(c("value_year") % 5 == 0, F.lit("$.00")).otherwise(money("land_market")),
    )
    return t.history.groupBy("parcel_id").agg(F.collect_list(record).alias("rows"))


TREND_SQL = """rec AS (SELECT p.hood_code, CAST(h.value_year AS BIGINT) AS value_year, CAST(floor(round(market_total, 2) + 0.5) AS BIGINT) AS total,
        CASE WHEN h.value_year % 5 = 0 THEN NULL ELSE CAST(floor(round(land_market, 2) + 0.5) AS BIGINT) END AS land
        FROM history h JOIN parcels p ON h.parcel_id = p.parcel_id WHERE trim(p.hood_code) <> ''),
    med AS (SELECT hood_code, value_year, coalesce(CAST(floor(quantile_cont(CAST(nullif(total, 0) AS DOUBLE), 0.5)) AS BIGINT), 0) AS median_total,
            coalesce(CAST(floor(quantile_cont(CAST(nullif(land, 0) AS DOUBLE), 0.5)) AS BIGINT), 0) AS median_land, 0 AS median_building FROM rec GROUP BY 1, 2),
    yy AS (SELECT *, lag(median_total) OVER w AS pt, lag(median_land) OVER w AS pl FROM med WINDOW w AS (PARTITION BY hood_code ORDER BY value_year)),
    ch AS (SELECT *, round(CASE WHEN pt <> 0 THEN (median_total - pt) * 100.0 / pt END, 2) AS yoy_median_total,
           round(CASE WHEN pl <> 0 THEN (median_land - pl) * 100.0 / pl END, 2) AS yoy_median_land FROM yy),
    trend AS (SELECT *, CASE WHEN count(yoy_median_total) OVER h >= 2 THEN greatest(0.0, 100.0 - 1.5 * stddev_pop(yoy_median_total) OVER h) END AS stability_score,
           CASE WHEN yoy_median_total > 10 THEN 'boom' WHEN yoy_median_total < -10 THEN 'bust' ELSE 'steady' END AS boom_bust_flag
           FROM ch WINDOW h AS (PARTITION BY hood_code))"""


def trends(t):
    records = sm.explode_history(history_docs(t))
    return sm.hood_trends(jn.history_with_hood(records, t.parcels))


@query(
    "a17_history_medians",
    f"WITH {TREND_SQL} SELECT hood_code, value_year, median_total, median_land, CAST(0 AS BIGINT) AS median_building FROM med",
)
def _(t):
    records = jn.history_with_hood(sm.explode_history(history_docs(t)), t.parcels)
    return sm.history_medians(records).select(
        "hood_code", c("value_year").cast("bigint").alias("value_year"), "median_total", "median_land", "median_building"
    )


@query(
    "w06_yearly_change",
    f"WITH {TREND_SQL} SELECT hood_code, value_year, yoy_median_total, yoy_median_land FROM trend",
)
def _(t):
    return trends(t).select("hood_code", c("value_year").cast("bigint").alias("value_year"), c("yoy_median_total").cast("double").alias("yoy_median_total"), c("yoy_median_land").cast("double").alias("yoy_median_land"))


@query(
    "w07_stability",
    f"WITH {TREND_SQL} SELECT hood_code, value_year, round(stability_score, 6) AS stability_score, boom_bust_flag FROM trend",
)
def _(t):
    return trends(t).select("hood_code", c("value_year").cast("bigint").alias("value_year"), *r6("stability_score"), "boom_bust_flag")


@query(
    "a18_trend_index",
    f"""WITH {TREND_SQL} SELECT hood_code, min(value_year) AS first_year, max(value_year) AS last_year, count(*) AS n_years,
        round(avg(stability_score), 6) AS avg_stability FROM trend GROUP BY 1""",
)
def _(t):
    return sm.trend_index(trends(t)).select(
        "hood_code", c("first_year").cast("bigint").alias("first_year"), c("last_year").cast("bigint").alias("last_year"), "n_years", *r6("avg_stability")
    )


@query(
    "w13_trend_series",
    f"""WITH {TREND_SQL} SELECT hood_code, string_agg(value_year || ':' || median_total || ':' || median_land, ';' ORDER BY value_year) AS series FROM trend GROUP BY 1""",
)
def _(t):
    line = lambda e: F.concat_ws(":", e["value_year"].cast("string"), e["median_total"].cast("string"), e["median_land"].cast("string"))
    return sm.trend_series(trends(t)).select("hood_code", F.array_join(F.transform("series", line), ";").alias("series"))


@query(
    "a19_price_summary",
    """WITH m AS (SELECT parcel_id, CAST(round(sale_price * 100) AS BIGINT) AS p FROM sales),
            g AS (SELECT parcel_id, count(p) AS n, CAST(sum(p) AS BIGINT) AS s, quantile_cont(CAST(p AS DOUBLE), 0.5) AS md, min(p) AS lo, max(p) AS hi FROM m GROUP BY 1)
       SELECT parcel_id, n AS "count", (s // n + CASE WHEN 2 * (s % n) > n OR (2 * (s % n) = n AND (s // n) % 2 = 1) THEN 1 ELSE 0 END) / 100.0 AS average,
              round_even(md, 0) / 100.0 AS median, lo / 100.0 AS low, hi / 100.0 AS high FROM g""",
)
def _(t):
    out = sm.comp_summary(t.sales, "parcel_id")
    return out.select("parcel_id", "count", *[c(x).cast("double").alias(x) for x in ("average", "median", "low", "high")])


_CODES = ["building_style", "hood_prefix", "proptype", "city_district", "land_use_code"]


@query(
    "a20_scan_codes",
    "WITH v AS ("
    + " UNION ".join(f"SELECT DISTINCT '{x}' AS col, trim({x}) AS value FROM parcels WHERE trim({x}) <> ''" for x in _CODES)
    + """), r AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY value) AS rn FROM v)
       SELECT col AS "column", count(*) AS distinct_count, string_agg(value, ';' ORDER BY value) FILTER (rn <= 4) AS sample_values FROM r GROUP BY col""",
)
def _(t):
    return sm.scan_codes(t.parcels, _CODES, limit=4).withColumn("sample_values", F.array_join("sample_values", ";"))


@query(
    "a21_run_metrics",
    """SELECT run_id, CAST(sum(n) AS BIGINT) AS total_observations, count(*) AS segments, round(sum(coalesce(cod, 0) * n) / sum(n), 3) AS cod,
              round(sum(coalesce(prd, 0) * n) / sum(n), 3) AS prd, round(sum(coalesce(prb, 0) * n) / sum(n), 3) AS prb, round(sum(coalesce(r2, 0) * n) / sum(n), 3) AS r2,
              round(sqrt(sum(residual_sum_sq) / sum(n)), 4) AS rmse, string_agg(DISTINCT market_group, ';' ORDER BY market_group) AS market_groups
       FROM segment_stats GROUP BY run_id""",
)
def _(t):
    return sm.global_metrics(t.segment_stats).withColumn("market_groups", F.array_join("market_groups", ";"))


_DRIVERS = """SELECT p_name AS predictor, l_discount * 10 AS importance, CASE WHEN l_linenumber % 3 = 0 THEN 'up' WHEN l_linenumber % 3 = 1 THEN 'down' ELSE 'other' END AS direction,
              CASE WHEN l_linenumber = 7 THEN NULL ELSE lower(p_type) || '_terms' END AS {g} FROM {l} JOIN {p} ON l_partkey = p_partkey"""


@query(
    "a22_driver_rollup",
    f"""WITH d AS ({_DRIVERS.format(g='grp', l='lineitem', p='part')}),
        s AS (SELECT predictor, sum(importance) AS imp, count(*) FILTER (direction = 'up') AS ups, count(*) FILTER (direction = 'down') AS downs FROM d GROUP BY 1),
        g AS (SELECT predictor, grp FROM (SELECT predictor, grp, row_number() OVER (PARTITION BY predictor ORDER BY count(grp) DESC, grp DESC NULLS LAST) AS rn FROM d GROUP BY 1, 2) WHERE rn = 1)
        SELECT s.predictor, CASE WHEN ups > downs THEN 'lower' WHEN downs > ups THEN 'higher' ELSE 'mixed' END AS direction,
               upper(grp[1]) || replace(grp[2:], '_terms', ' Terms') AS group_label,
               CASE WHEN imp > 0 THEN round(imp * 100 / (SELECT sum(imp) FROM s), 1) END AS importance_pct FROM s JOIN g ON s.predictor = g.predictor""",
)
def _(t):
    return sm.driver_rollup(t.sql(_DRIVERS.format(g="`group`", l="{lineitem}", p="{part}")))


@query(
    "a23_quality_scores",
    """SELECT run_id, market_group, value_tier, round((greatest(0, least(1, 1 - CASE WHEN cod > 1 THEN cod / 100 ELSE cod END)) + greatest(0, least(1, 1 - abs(prd - 1)))
              + CASE WHEN prb IS NULL THEN 0 ELSE greatest(0, least(1, 1 - abs(prb))) END) / (2 + CASE WHEN prb IS NULL THEN 0 ELSE 1 END) * 100, 1) AS score FROM segment_stats""",
)
def _(t):
    return t.segment_stats.select("run_id", "market_group", "value_tier", sm.quality_score(c("cod"), c("prd"), c("prb")).alias("score"))


@query(
    "a24_crawl_totals",
    """SELECT event_type, count(*) FILTER (outcome = 'success') AS success_count, count(*) FILTER (outcome = 'skip') AS skip_count,
              count(*) FILTER (outcome = 'error') AS error_count, count(*) AS api_calls, round(sum(value * 3e-2), 4) AS est_cost_usd FROM visits GROUP BY 1""",
)
def _(t):
    return sm.crawl_totals(t.visits, "event_type", "outcome", c("value") * 3e-2).withColumn("est_cost_usd", F.round("est_cost_usd", 4))


def _charts(t):
    return t.orders.groupBy("o_custkey").agg(F.collect_list(F.struct(c("o_totalprice").alias("sale_price"))).alias("chart"))


@query("a25_median_chart_price", "SELECT round(quantile_cont(o_totalprice, 0.5), 6) AS median_value FROM orders")
def _(t):
    return sm.median_from_stats(_charts(t), "chart", "sale_price").select(*r6("median_value"))


@query(
    "a26_portal_figures",
    """WITH g AS (SELECT count(DISTINCT market_group) AS hood_count, round(sum(coalesce(cod, 0) * n) / sum(n), 3) AS cod, round(sum(coalesce(prd, 0) * n) / sum(n), 3) AS prd,
               round(sum(coalesce(prb, 0) * n) / sum(n), 3) AS prb FROM segment_stats WHERE run_id = 'RUN1')
       SELECT (SELECT count(*) FROM rolls WHERE roll_year = 2025) AS total_parcels, CAST(hood_count AS INT) AS hood_count,
              round((greatest(0, least(1, 1 - CASE WHEN cod > 1 THEN cod / 100 ELSE cod END)) + greatest(0, least(1, 1 - abs(prd - 1))) + greatest(0, least(1, 1 - abs(prb)))) / 3 * 100, 1) AS data_quality,
              (SELECT round(quantile_cont(o_totalprice, 0.5), 6) FROM orders) AS median_value FROM g""",
)
def _(t):
    metrics = sm.global_metrics(t.segment_stats.where("run_id = 'RUN1'"))
    return sm.portal_figures(t.rolls, metrics, _charts(t), 2025).withColumn("median_value", F.round("median_value", 6))
