"""Queries for comparable selection, adjustments, appeals and fairness.

Every residential parcel is a subject.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from parcelmill.functions import codes as cd
from parcelmill.functions import fixed_values as fv
from parcelmill.operators import adjust as ad
from parcelmill.operators import appeals as ap
from parcelmill.operators import comps as cm
from parcelmill.operators import joins as jn
from parcelmill.plans.aggregating import r6
from parcelmill.plans.cleaning import sql_list, sql_prefixes
from parcelmill.plans.filtering import LATEST_VALID
from parcelmill.plans.registry import query

c = F.col
AS_OF = dt.date(2001, 8, 1)
# Coefficients of one fitted market group.
BETAS = {
    "log_area": 0.12, "log_lot": 0.05, "log_age": -0.03, "t": 0.01, "area_time": -0.002, "quality_score": 0.02, "condition_score": 0.015,
    "has_garage": 0.01, "has_basement": 0.035, "is_view": 0.025, "const": 11.0, "pt_1.0": 0.25,
}


def homes(t):
    """Parcels with positions in metres, market area and current value."""
    return t.parcels.withColumns(
        {
            "x": c("x") * 1000, "y": c("y") * 1000, "value": F.coalesce("total_market_value", "assessed_value"),
            "valuation_area": F.coalesce(cd.market_group(c("hood_code")), c("city_district")),
        }
    )


def candidates(t, n=16, radius=3000.0, pick=None):
    rows = homes(t)
    return cm.comp_candidates(cm.subject_facts(rows), cm.comp_pool(rows, t.sales, AS_OF), n, radius, pick)


def escalated(t):
    return candidates(t, 16, 4828.0, lambda rows: cm.escalate_radius(rows, 7))


CAND_SQL = f"""{LATEST_VALID},
    home AS (SELECT *, x * 1000 AS mx, y * 1000 AS my, nullif(upper(trim(land_use_code)), '') AS lu, coalesce(total_market_value, assessed_value) AS value,
             coalesce({sql_prefixes('hood_code', fv.AREAS_SHORT, "'OTHER'")}, city_district) AS area FROM parcels WHERE upper(trim(coalesce(proptype, ''))) = 'R'),
    pool AS (SELECT h.*, v.last_sale_price AS price, CAST(v.last_sale_date AS DATE) AS sdate FROM home h JOIN latest_valid v ON h.parcel_id = v.parcel_id
             WHERE bedrooms IS NOT NULL AND bathrooms IS NOT NULL AND year_built IS NOT NULL AND living_area IS NOT NULL AND lower(trim(address)) NOT IN ({sql_list(fv.BLANK_ADDRESSES)})
               AND v.last_sale_date >= TIMESTAMP '2001-08-01' - INTERVAL 540 DAY),
    pair AS (SELECT s.parcel_id AS subject_id, k.parcel_id AS comp_id, sqrt(pow(s.mx - k.mx, 2) + pow(s.my - k.my, 2)) AS distance,
             CASE WHEN s.hood_code = k.hood_code THEN 0 WHEN s.city_district = k.city_district THEN 1 ELSE 2 END AS tier
             FROM home s JOIN pool k ON s.parcel_id <> k.parcel_id AND (s.lu IS NULL OR s.lu = k.lu)),
    cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY tier, distance, comp_id) AS rn FROM pair WHERE distance <= 3000) WHERE rn <= 16)"""


@query("c01_comp_candidates", f"WITH {CAND_SQL} SELECT subject_id, comp_id, CAST(tier AS INT) AS tier, round(distance, 4) AS distance FROM cand")
def _(t):
    return candidates(t).select("subject_id", "comp_id", "tier", F.round("distance", 4).alias("distance"))


def _exp(a: str, scale: str) -> str:
    return f"exp(-abs(s.{a} - k.{a}) / {scale})"


_AGE = "exp(-abs(greatest(2025 - s.eff_year_built, 0) - greatest(2025 - k.eff_year_built, 0)) / 10.0)"
_PARTS = {
    "0.25": f"CASE WHEN s.living_area > 0 THEN {_exp('living_area', 'greatest(s.living_area * 0.2, 300.0)')} END",
    "0.15": _exp("bathrooms", "0.75"),
    "0.10": _exp("bedrooms", "1.0"),
    "0.150": f"CASE WHEN s.acres > 0 THEN {_exp('acres', 'greatest(s.acres * 0.25, 0.1)')} END",
    "0.100": f"CASE WHEN s.eff_year_built IS NOT NULL AND k.eff_year_built IS NOT NULL THEN {_AGE} END",
    "0.05": "CASE WHEN (s.garage_sqft > 0) = (k.garage_sqft > 0) THEN 1.0 ELSE 0.5 END",
    "0.050": "CASE WHEN (s.basement_sqft > 0) = (k.basement_sqft > 0) THEN 1.0 ELSE 0.6 END",
    "0.075": "CASE WHEN s.quality_score IS NULL OR k.quality_score IS NULL THEN NULL WHEN s.quality_score = k.quality_score THEN 1.0 ELSE 0.6 END",
    "0.0750": "CASE WHEN s.condition_score IS NULL OR k.condition_score IS NULL THEN NULL WHEN s.condition_score = k.condition_score THEN 1.0 ELSE 0.6 END",
}
_MONTHS = "abs(date_diff('day', k.sdate, DATE '2001-01-01')) / 30.4375"
SCORE_SQL = f"""{CAND_SQL},
    sc AS (SELECT a.subject_id, a.comp_id, a.tier, a.distance, k.price, k.sdate,
        CASE WHEN s.area <> k.area THEN 0 ELSE greatest(0, least(1, 1 - least(a.distance, 3000) / 3000.0 + CASE WHEN s.hood_code = k.hood_code THEN 0.2 WHEN s.city_district = k.city_district THEN 0.05 ELSE 0 END)) END AS location_score,
        CASE WHEN {_MONTHS} <= 3 THEN 1.0 WHEN {_MONTHS} <= 6 THEN 0.9 WHEN {_MONTHS} <= 12 THEN 0.7 WHEN {_MONTHS} <= 18 THEN 0.5 WHEN {_MONTHS} <= 24 THEN 0.3 ELSE 0.0 END AS time_score,
        ({' + '.join(f'coalesce({w} * ({e}), 0)' for w, e in _PARTS.items())}) / ({' + '.join(f'CASE WHEN ({e}) IS NULL THEN 0 ELSE {w} END' for w, e in _PARTS.items())}) AS physical_score
        FROM cand a JOIN home s ON a.subject_id = s.parcel_id JOIN pool k ON a.comp_id = k.parcel_id),
    scored AS (SELECT *, 0.40 * location_score + 0.30 * time_score + 0.30 * physical_score AS total_score FROM sc)"""


def scored(t):
    return cm.with_scores(candidates(t), 3000.0, F.lit(dt.date(2001, 1, 1)))


@query(
    "c02_pair_scores",
    f"WITH {SCORE_SQL} SELECT subject_id, comp_id, round(location_score, 6) AS location_score, CAST(time_score AS DOUBLE) AS time_score, round(physical_score, 6) AS physical_score, round(total_score, 6) AS total_score FROM scored",
)
def _(t):
    return scored(t).select("subject_id", "comp_id", *r6("location_score"), "time_score", *r6("physical_score", "total_score"))


@query(
    "c06_coefficient_weights",
    """WITH r AS (SELECT market_group, run_id FROM (SELECT market_group, run_id, row_number() OVER (PARTITION BY market_group ORDER BY max(created_at) DESC, run_id DESC) AS rn FROM coefficients GROUP BY 1, 2) WHERE rn = 1),
            k AS (SELECT k.* FROM coefficients k JOIN r ON k.market_group = r.market_group AND k.run_id = r.run_id WHERE term IN ('log_area', 'log_lot', 'log_age', 'quality_score', 'condition_score', 'has_garage', 'has_basement', 'is_view'))
       SELECT market_group, round(sum(abs(beta)) FILTER (term = 'log_area') / sum(abs(beta)), 6) AS area, round(sum(abs(beta)) FILTER (term = 'is_view') / sum(abs(beta)), 6) AS view FROM k GROUP BY 1""",
)
def _(t):
    w = cm.beta_weights(c("betas"))
    return jn.coefficient_sets(t.coefficients).select("market_group", F.round(w["area"], 6).alias("area"), F.round(w["view"], 6).alias("view"))


@query(
    "c07_difference_flags",
    f"""WITH {CAND_SQL} SELECT a.subject_id, a.comp_id, abs(s.living_area - k.living_area) >= 150 AS living_area, coalesce(abs(s.bedrooms - k.bedrooms) >= 1, false) AS bedrooms,
        abs(s.garage_sqft - k.garage_sqft) >= 50 AS garage_sqft, abs(s.year_built - k.year_built) >= 10 AS year_built FROM cand a JOIN home s ON a.subject_id = s.parcel_id JOIN pool k ON a.comp_id = k.parcel_id""",
)
def _(t):
    rows = candidates(t).withColumn("flags", cm.difference_flags())
    return rows.select("subject_id", "comp_id", *[c(f"flags.{x}").alias(x) for x in ("living_area", "bedrooms", "garage_sqft", "year_built")])


@query(
    "c08_match_percentages",
    f"""WITH {SCORE_SQL}, p AS (SELECT sc.*, least(s.living_area, k.living_area) / greatest(s.living_area, k.living_area) AS size_r, least(s.acres, k.acres) / greatest(s.acres, k.acres) AS land_r,
          {_PARTS['0.075']} AS qm, {_PARTS['0.0750']} AS cond_m FROM scored sc JOIN home s ON sc.subject_id = s.parcel_id JOIN pool k ON sc.comp_id = k.parcel_id),
        q AS (SELECT *, (coalesce(qm, 0) + coalesce(cond_m, 0)) / nullif((qm IS NOT NULL)::INT + (cond_m IS NOT NULL)::INT, 0) AS qc FROM p)
        SELECT subject_id, comp_id, CAST(round_even(size_r * 100, 0) AS INT) AS match_size, CAST(round_even(location_score * 100, 0) AS INT) AS match_proximity, CAST(round_even(qc * 100, 0) AS INT) AS match_quality_condition FROM q""",
)
def _(t):
    return cm.match_scores(scored(t)).select("subject_id", "comp_id", "match_size", "match_proximity", "match_quality_condition")


@query(
    "c09_selected_comps",
    f"""WITH {SCORE_SQL} SELECT subject_id, comp_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY round(total_score, 9) DESC, round(location_score, 9) DESC,
        time_score DESC, round(physical_score, 9) DESC, sdate DESC, round(distance, 6), comp_id) AS rank FROM scored) WHERE rank <= 5""",
)
def _(t):
    # Rounded, as sums in another order differ in the last digit.
    rows = scored(t).withColumns({x: F.round(x, 9) for x in ("total_score", "location_score", "physical_score")}).withColumn("distance", F.round("distance", 6))
    return cm.select_comps(rows, 5).select("subject_id", "comp_id", "rank")


for _field, _dir, _sql in (
    ("sale_price", "asc", "price ASC"), ("sale_price", "desc", "price DESC"), ("distance", "asc", "distance ASC"), ("sale_date", "desc", "sdate DESC"),
):

    @query(
        f"k04_comps_by_{_field}_{_dir}",
        f"WITH {SCORE_SQL} SELECT subject_id, comp_id, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY {_sql}, comp_id) AS rank FROM scored) WHERE rank <= 3",
    )
    def _(t, field=_field, way=_dir):
        return cm.select_comps(scored(t), 3, field, way).select("subject_id", "comp_id", "rank")


_RING = """f{i} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY tier, distance, comp_id) AS rn FROM pair WHERE distance <= {r}) WHERE rn <= 16),
    g{i} AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY subject_id ORDER BY distance, comp_id) AS rn FROM f{i}) WHERE rn <= 8),
    h{i} AS (SELECT *, count(*) FILTER (distance <= 1609.34) OVER (PARTITION BY subject_id) AS near FROM g{i}),
    ring{i} AS (SELECT * FROM (SELECT * EXCLUDE (rn), row_number() OVER (PARTITION BY subject_id ORDER BY distance, comp_id) AS rn FROM h{i} WHERE near < 3 OR distance <= 1609.34) WHERE rn <= 7)"""
RING_SQL = f"""{CAND_SQL}, {_RING.format(i=0, r=3218)}, {_RING.format(i=1, r=4828)},
    allr AS (SELECT subject_id, comp_id, 0 AS ring, rn FROM ring0 UNION ALL SELECT subject_id, comp_id, 1, rn FROM ring1),
    firstr AS (SELECT subject_id, comp_id, min(ring * 1000 + rn) AS o FROM allr GROUP BY 1, 2),
    chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY o, comp_id) AS rank FROM firstr) WHERE rank <= 7)"""


@query("k06_radius_escalation", f"WITH {RING_SQL} SELECT subject_id, comp_id, CAST(o // 1000 AS INT) AS ring, CAST(rank AS INT) AS rank FROM chosen")
def _(t):
    return escalated(t).select("subject_id", "comp_id", "ring", "rank")


@query("k07_one_mile_preference", f"WITH {RING_SQL} SELECT subject_id, comp_id, CAST(rn AS INT) AS rank FROM ring0")
def _(t):
    return candidates(t, 16, 4828.0, lambda rows: cm.citizen_comps(rows, 7, 3218.0)).select("subject_id", "comp_id", "rank")


def adjust_pairs(t):
    """Selected pairs with the columns the adjustments read."""
    rows = scored(t)
    named = {}
    for p in "sc":
        named |= {
            f"{p}_gla": c(f"{p}_living_area"), f"{p}_lot_acres": c(f"{p}_acres"), f"{p}_age": 2025 - c(f"{p}_eff_year_built"),
            f"{p}_has_garage": (c(f"{p}_garage_sqft") > 0).cast("int"), f"{p}_has_basement": (c(f"{p}_basement_sqft") > 0).cast("int"),
            f"{p}_is_view": cd.is_view(c(f"{p}_hood_code")),
        }
    betas = F.create_map(*[F.lit(x) for kv in BETAS.items() for x in kv])
    return rows.withColumns(named).withColumns(
        {"betas": betas, "s_sale_date": F.lit(None).cast("date"), "subject_pred_price": c("s_value"), "valuation_date": F.lit(dt.date(2001, 1, 1))}
    )


def _delta(a: str) -> str:
    return f"({a.replace('@', 's.')}) - ({a.replace('@', 'k.')})"


_VIEW = " OR ".join(f"@hood_code ILIKE '%{m}%'" for m in fv.VIEW_MARKS)
_ADJ = {
    "area": (0.12, "ln(@living_area)"), "lot": (0.05, "ln(1 + @acres)"), "age": (-0.03, "ln(1 + greatest(2025 - @eff_year_built, 0)) + 0 * @eff_year_built"), "quality": (0.02, "@quality_score"),
    "condition": (0.015, "@condition_score"), "garage": (0.01, "CASE WHEN @garage_sqft > 0 THEN 1 ELSE 0 END"), "basement": (0.035, "CASE WHEN @basement_sqft > 0 THEN 1 ELSE 0 END"),
    "view": (0.025, f"CASE WHEN {_VIEW} THEN 1 ELSE 0 END"),
}
_ADJ_SQL = {k: f"coalesce(s.value * (exp({b} * ({_delta(e)})) - 1), 0)" for k, (b, e) in _ADJ.items()}
_ADJ_SQL["time"] = "k.price * (exp((0.01 - 0.002 * ln(k.living_area)) * greatest(least(date_diff('day', k.sdate, DATE '2001-01-01') / 30.4375, 60), -60)) - 1)"
ADJUST_SQL = f"""{CAND_SQL}, adj AS (SELECT a.subject_id, a.comp_id, k.price, {', '.join(f'{e} AS a_{k}' for k, e in _ADJ_SQL.items())}
    FROM cand a JOIN home s ON a.subject_id = s.parcel_id JOIN pool k ON a.comp_id = k.parcel_id)"""
_TOTAL = " + ".join(f"a_{k}" for k in _ADJ_SQL)


@query(
    "c11_factor_adjustments",
    f"WITH {ADJUST_SQL} SELECT subject_id, comp_id, {', '.join(f'round(a_{k}, 2) AS adj_{k}' for k in _ADJ_SQL)} FROM adj",
)
def _(t):
    return ad.adjusted_comps(adjust_pairs(t)).select("subject_id", "comp_id", *[f"adj_{k}" for k in _ADJ_SQL])


@query("c13_adjusted_values", f"WITH {ADJUST_SQL} SELECT subject_id, comp_id, round({_TOTAL}, 2) AS total_adjustment, round(price + {_TOTAL}, 2) AS adjusted_value FROM adj")
def _(t):
    return ad.adjusted_comps(adjust_pairs(t)).select("subject_id", "comp_id", "total_adjustment", "adjusted_value")


@query("c13_missing_terms", f"WITH {CAND_SQL} SELECT subject_id, count(*) AS pairs, 'condition_score;is_view' AS missing_terms FROM cand GROUP BY 1")
def _(t):
    rows = adjust_pairs(t).withColumn("betas", F.map_filter("betas", lambda k, v: ~k.isin("is_view", "condition_score")))
    out = ad.adjusted_comps(rows).where(c("total_adjustment").isNull())
    return out.groupBy("subject_id", F.array_join("missing_terms", ";").alias("missing_terms")).agg(F.count(F.lit(1)).alias("pairs"))


@query(
    "c14_predicted_prices",
    f"""SELECT parcel_id, round(exp(11.0 + 0.12 * ln(living_area) + 0.05 * ln(1 + acres) - 0.03 * coalesce(ln(1 + greatest(2025 - eff_year_built, 0)) + 0 * eff_year_built, 0) + 0.02 * coalesce(quality_score, 0)
         + 0.015 * coalesce(condition_score, 0) + 0.01 * CASE WHEN garage_sqft > 0 THEN 1 ELSE 0 END + 0.035 * CASE WHEN basement_sqft > 0 THEN 1 ELSE 0 END + 0.025 * CASE WHEN {_VIEW.replace('@', '')} THEN 1 ELSE 0 END
         + (0.01 - 0.002 * ln(living_area)) * date_diff('day', DATE '2015-01-01', DATE '2024-01-15') / 30.4375 + CASE WHEN parcel_id % 2 = 1 THEN 0.25 ELSE 0 END), 2) AS predicted_price FROM parcels""",
)
def _(t):
    betas = F.create_map(*[F.lit(x) for kv in BETAS.items() for x in kv])
    rows = t.parcels.select(
        "parcel_id", c("living_area").alias("gla"), c("acres").alias("lot_acres"), (2025 - c("eff_year_built")).alias("age"), "quality_score", "condition_score",
        (c("garage_sqft") > 0).cast("int").alias("has_garage"), (c("basement_sqft") > 0).cast("int").alias("has_basement"), cd.is_view(c("hood_code")).alias("is_view"),
        F.lit(dt.date(2024, 1, 15)).alias("sale_date"), (c("parcel_id") % 2).alias("property_type"), betas.alias("betas"),
    )
    return ad.predict_price(rows).select("parcel_id", F.round("predicted_price", 2).alias("predicted_price"))


@query(
    "c15_valuation_dates",
    """SELECT parcel_id, roll_year, CAST(CASE WHEN parcel_id % 4 = 0 THEN DATE '2024-07-01' WHEN parcel_id % 4 = 1 THEN DATE '2025-09-09' ELSE make_date(roll_year, 1, 1) END AS VARCHAR) AS day FROM rolls""",
)
def _(t):
    explicit = F.when(c("parcel_id") % 4 == 0, F.lit(dt.date(2024, 7, 1)))
    year = F.when(c("parcel_id") % 4 == 1, 1900).otherwise(c("roll_year"))
    return t.rolls.select("parcel_id", "roll_year", ad.valuation_date(explicit, year, dt.date(2025, 9, 9)).cast("string").alias("day"))


@query(
    "c16_over_assessment",
    f"""WITH {RING_SQL}, m AS (SELECT c.subject_id, quantile_cont(k.price, 0.5) AS med, count(*) AS n FROM chosen c JOIN pool k ON c.comp_id = k.parcel_id GROUP BY 1)
        SELECT m.subject_id, n AS comp_count, round((h.value - med) / med * 100, 6) AS over_pct FROM m JOIN home h ON m.subject_id = h.parcel_id""",
)
def _(t):
    out = escalated(t).groupBy("subject_id", "s_value").agg(F.median("c_sale_price").alias("med"), F.count(F.lit(1)).alias("comp_count"))
    return out.select("subject_id", "comp_count", F.round(ap.over_assessment(c("s_value"), c("med")), 6).alias("over_pct"))


_SCORE_CASES = """50 + CASE WHEN over >= 20 THEN 25 WHEN over >= 12 THEN 18 WHEN over >= 7 THEN 10 WHEN over <= 0 THEN -20 WHEN over IS NOT NULL THEN 2 ELSE 0 END
    + CASE WHEN n >= 5 THEN 10 WHEN n >= 3 THEN 5 ELSE -15 END + CASE WHEN gap >= 8 THEN 12 WHEN gap >= 4 THEN 6 WHEN gap <= 0 THEN -10 ELSE 0 END
    + CASE rel WHEN 'LOW' THEN 6 WHEN 'HIGH' THEN -4 ELSE 0 END + CASE WHEN cod >= 18 THEN 6 WHEN cod <= 8 THEN -2 ELSE 0 END"""


@query(
    "c17_appeal_scores",
    f"""WITH z AS (SELECT sale_id, (sale_price % 4000) / 100 - 8 AS over, sale_id % 7 AS n, CASE WHEN sale_id % 3 = 0 THEN NULL ELSE sale_price % 13 - 2 END AS gap,
               CASE sale_id % 4 WHEN 0 THEN 'LOW' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS rel, CASE WHEN sale_id % 5 = 0 THEN NULL ELSE sale_price % 25 END AS cod FROM sales),
        y AS (SELECT *, CAST(greatest(0, least(100, {_SCORE_CASES})) AS INT) AS score FROM z)
        SELECT sale_id, score, CASE WHEN score >= 80 THEN 'Very Strong' WHEN score >= 65 THEN 'Strong' WHEN score >= 50 THEN 'Moderate' ELSE 'Weak' END AS rating,
               CAST(1 + 1 + CASE WHEN gap >= 4 OR gap <= 0 THEN 1 ELSE 0 END + CASE WHEN rel IN ('LOW', 'HIGH') THEN 1 ELSE 0 END AS INT) AS reasons FROM y""",
)
def _(t):
    p = c("sale_price")
    out = ap.appeal_score(
        (p % 4000) / 100 - 8, c("sale_id") % 7, F.when(c("sale_id") % 3 != 0, p % 13 - 2),
        F.when(c("sale_id") % 4 == 0, "LOW").when(c("sale_id") % 4 == 1, "HIGH").otherwise("MEDIUM"), F.when(c("sale_id") % 5 != 0, p % 25),
    )
    return t.sales.select("sale_id", out["score"].alias("score"), out["rating"].alias("rating"), F.size(out["reasons"]).alias("reasons"))


@query(
    "c18_soft_stops",
    """SELECT sale_id, (sale_price % 40 < 7 OR sale_id % 6 < 3 OR sale_price % 9 - 3 <= 0 OR sale_id % 100 < 45) AS soft_stop,
              CAST((sale_price % 40 < 7)::INT + (sale_id % 6 < 3)::INT + (sale_price % 9 - 3 <= 0)::INT + (sale_id % 100 < 45)::INT AS INT) AS reasons FROM sales""",
)
def _(t):
    p = c("sale_price")
    out = ap.soft_stop(p % 40, c("sale_id") % 6, p % 9 - 3, c("sale_id") % 100)
    return t.sales.select("sale_id", out["soft_stop"].alias("soft_stop"), F.size(out["soft_reasons"]).alias("reasons"))


@query(
    "c19_roll_screening",
    f"""WITH {RING_SQL}, m AS (SELECT c.subject_id, quantile_cont(k.price, 0.5) AS med, count(*) AS n FROM chosen c JOIN pool k ON c.comp_id = k.parcel_id GROUP BY 1),
        hm AS (SELECT hood_code, avg(sale_price) / 12000 AS cod, CASE WHEN count(*) % 2 = 0 THEN 'LOW' ELSE 'HIGH' END AS rel, 3e0 AS avg_change_pct FROM sales s JOIN parcels p ON s.parcel_id = p.parcel_id GROUP BY 1),
        rc AS (SELECT a.parcel_id, (coalesce(a.total_market_value, a.assessed_value) - coalesce(b.total_market_value, b.assessed_value)) * 100 / coalesce(b.total_market_value, b.assessed_value) AS change_pct
               FROM rolls a JOIN rolls b ON a.parcel_id = b.parcel_id AND b.roll_year = 2024 WHERE a.roll_year = 2025),
        z AS (SELECT h.parcel_id AS subject_id, coalesce(m.n, 0) AS n, (h.value - med) / med * 100 AS over, change_pct - avg_change_pct AS gap, rel, cod FROM home h LEFT JOIN m ON h.parcel_id = m.subject_id
              LEFT JOIN hm ON h.hood_code = hm.hood_code LEFT JOIN rc ON h.parcel_id = rc.parcel_id),
        y AS (SELECT *, CAST(greatest(0, least(100, {_SCORE_CASES})) AS INT) AS score FROM z)
        SELECT subject_id, n AS comp_count, score, coalesce(over < 7, false) OR n < 3 OR coalesce(gap <= 0, false) OR score < 45 AS soft_stop FROM y""",
)
def _(t):
    metrics = t.sales.join(t.parcels, "parcel_id").groupBy("hood_code").agg(
        (F.avg("sale_price") / 12000).alias("cod"), F.when(F.count(F.lit(1)) % 2 == 0, "LOW").otherwise("HIGH").alias("reliability"), F.lit(3e0).alias("avg_change_pct")
    )
    out = ap.screen_roll(homes(t), t.sales, metrics, AS_OF, 7, change=jn.roll_change(t.rolls, 2025))
    return out.select("subject_id", "comp_count", "score", "soft_stop")


@query(
    "c20_hood_snapshots",
    """WITH d AS (SELECT *, lag(sales_ratio) OVER w AS psr, row_number() OVER (PARTITION BY hood_code ORDER BY metric_year DESC) AS rn FROM hood_metrics WINDOW w AS (PARTITION BY hood_code ORDER BY metric_year))
       SELECT hood_code, CAST(metric_year AS BIGINT) AS metric_year, round(greatest(0, least(100, (sales_ratio / 100 - 0.8) / 0.4 * 100)), 1) AS sales_ratio_pos, round(greatest(0, least(100, cod / 40 * 100)), 1) AS cod_pos,
              CASE WHEN upper(reliability) IN ('HIGH', 'LOW') THEN upper(reliability) WHEN sample_size >= 30 AND cod < 10 THEN 'HIGH' WHEN sample_size >= 15 AND cod < 15 THEN 'MEDIUM' ELSE 'LOW' END AS reliability,
              round(sales_ratio - psr, 6) AS sales_ratio_delta FROM d WHERE rn = 1""",
)
def _(t):
    return ap.hood_snapshot(t.hood_metrics).select(
        "hood_code", c("metric_year").cast("bigint").alias("metric_year"), "sales_ratio_pos", "cod_pos", "reliability", *r6("sales_ratio_delta")
    )


@query(
    "c21_fairness_labels",
    """SELECT hood_code, CAST(metric_year AS BIGINT) AS metric_year, CASE WHEN sales_ratio BETWEEN 90 AND 110 THEN 'Within IAAO range' ELSE 'Outside IAAO range' END AS level_status,
              CASE WHEN cod < 10 THEN 'Excellent uniformity' WHEN cod < 15 THEN 'Acceptable uniformity' ELSE 'Patchy uniformity' END AS cod_status,
              CASE WHEN prd BETWEEN 0.98 AND 1.03 THEN 'Balanced by value' WHEN prd > 1.03 THEN 'Regressive pattern' ELSE 'Progressive pattern' END AS prd_status FROM hood_metrics""",
)
def _(t):
    return ap.fairness_status(t.hood_metrics).select("hood_code", c("metric_year").cast("bigint").alias("metric_year"), "level_status", "cod_status", "prd_status")


@query(
    "c22_saved_packages",
    f"""WITH {SCORE_SQL} SELECT subject_id, comp_id AS parcel_id, CAST(rank AS INT) AS rank, CAST(CAST(price AS DECIMAL(15, 2)) AS DOUBLE) AS raw_sale_price FROM (
        SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY distance, comp_id) AS rank FROM scored) WHERE rank <= 6""",
)
def _(t):
    out = ap.save_package(cm.select_comps(scored(t), 6, "distance", "asc"), "A1")
    return out.select("subject_id", "parcel_id", "rank", c("raw_sale_price").cast("double").alias("raw_sale_price"))


@query(
    "c23_storyboards",
    f"""WITH {ADJUST_SQL} SELECT a.subject_id, count(*) AS comps, round(avg(k.living_area), 6) AS avg_gla, round(sum(round(a_area, 2) + round(a_lot, 2)), 2) AS total_size, round(sum(round(a_time, 2)), 2) AS total_time
        FROM adj a JOIN pool k ON a.comp_id = k.parcel_id GROUP BY 1""",
)
def _(t):
    return ad.storyboard(ad.adjusted_comps(adjust_pairs(t))).select("subject_id", "comps", *r6("avg_gla"), "total_size", "total_time")


@query(
    "c24_comparison_grid",
    f"""WITH {ADJUST_SQL} SELECT a.subject_id, a.comp_id, round(a_area, 2) AS area_amount, CASE WHEN s.living_area = k.living_area THEN 'Living area difference: No difference detected.' ELSE 'Living area difference: '
          || CASE WHEN s.living_area > k.living_area THEN '+' ELSE '-' END || format('{{:,}}', CAST(abs(s.living_area - k.living_area) AS BIGINT)) || ' sqft (' || CASE WHEN s.living_area > k.living_area THEN 'Subject higher' ELSE 'Comparable higher' END || ').' END AS area_text
        FROM adj a JOIN home s ON a.subject_id = s.parcel_id JOIN pool k ON a.comp_id = k.parcel_id""",
)
def _(t):
    grid = ad.comparison_grid(ad.adjusted_comps(adjust_pairs(t))).withColumn("area", c("adjustment_list")[0])
    return grid.select("subject_id", "comp_id", c("area.amount").alias("area_amount"), c("area.delta_text").alias("area_text"))
