"""Queries for ratio studies, features, bins, calibration and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv
from parcelmill.operators import calibrate as cb
from parcelmill.operators import features as ft
from parcelmill.operators import moments as mo
from parcelmill.operators import ratio as ra
from parcelmill.plans.aggregating import r6
from parcelmill.plans.joining import DATASET_SQL, dataset
from parcelmill.plans.registry import query

c = F.col


def samples(t):
    """Sales of residential parcels with assessed value and hood."""
    return t.sales.where("upper(trim(sale_type)) = 'VALID SALE'").join(t.parcels.where("proptype = 'R'"), "parcel_id")


SAMPLE_SQL = """sample AS (SELECT s.sale_id, s.sale_price, p.assessed_value, p.hood_code, p.assessed_value / s.sale_price AS ratio FROM sales s JOIN parcels p ON s.parcel_id = p.parcel_id
    WHERE upper(trim(s.sale_type)) = 'VALID SALE' AND p.proptype = 'R' AND s.sale_price > 0 AND p.assessed_value > 0 AND p.assessed_value / s.sale_price BETWEEN 0.25 AND 2.5)"""


@query(
    "r01_ratio_study",
    f"""WITH {SAMPLE_SQL}, m AS (SELECT hood_code, quantile_cont(ratio, 0.5) AS med FROM sample GROUP BY 1)
        SELECT s.hood_code, round(avg(ratio) * 100, 6) AS sales_ratio, round(any_value(med), 6) AS median_ratio, round(avg(abs(ratio - med)) / any_value(med) * 100, 6) AS cod,
               round(avg(ratio) / (sum(assessed_value) / sum(sale_price)), 6) AS prd, count(*) AS sample_size,
               CASE WHEN count(*) >= 30 THEN 'High' WHEN count(*) >= 10 THEN 'Moderate' ELSE 'Low' END AS reliability
        FROM sample s JOIN m ON s.hood_code = m.hood_code GROUP BY 1 HAVING count(*) >= 5""",
)
def _(t):
    out = ra.ratio_study(samples(t), "hood_code")
    return out.select("hood_code", *r6("sales_ratio", "median_ratio", "cod", "prd"), "sample_size", "reliability")


def _with_ratio(t):
    rows = samples(t).where("sale_price > 0").withColumn("ratio", c("assessed_value") / c("sale_price")).where(c("ratio").between(0.25, 2.5))
    return rows.withColumn("v_proxy", (c("assessed_value") + c("sale_price")) / 2)


@query(
    "r02_price_bias",
    f"""WITH {SAMPLE_SQL}, m AS (SELECT hood_code, quantile_cont(ratio, 0.5) AS mr, quantile_cont(sale_price, 0.5) AS mp, quantile_cont(sale_price, 0.1) AS lo, quantile_cont(sale_price, 0.9) AS hi FROM sample GROUP BY 1)
        SELECT s.hood_code, CASE WHEN count(*) >= 12 AND count(*) FILTER (sale_price BETWEEN lo AND hi) >= 6 THEN round(regr_slope(CASE WHEN sale_price BETWEEN lo AND hi THEN ratio / mr - 1 END,
               CASE WHEN sale_price BETWEEN lo AND hi THEN log2(sale_price / mp) END), 3) END AS prb, count(*) AS n, count(*) FILTER (sale_price BETWEEN lo AND hi) AS n_used
        FROM sample s JOIN m ON s.hood_code = m.hood_code GROUP BY 1""",
)
def _(t):
    return ra.prb(_with_ratio(t), ["hood_code"], "sales")


@query(
    "r03_bias_variants",
    f"""WITH {SAMPLE_SQL}, v AS (SELECT *, (assessed_value + sale_price) / 2 AS x FROM sample),
        m AS (SELECT hood_code, quantile_cont(ratio, 0.5) AS mr, quantile_cont(x, 0.5) AS mx, quantile_cont(x, 0.1) AS l1, quantile_cont(x, 0.9) AS h1, quantile_cont(x, 0.05) AS l2, quantile_cont(x, 0.95) AS h2,
              quantile_cont(cbrt(x), 0.5) AS mc FROM v GROUP BY 1),
        lin AS (SELECT v.hood_code, regr_slope(ratio / mr - 1, x / mx - 1) AS prb, count(*) AS n FROM v JOIN m ON v.hood_code = m.hood_code WHERE x BETWEEN l1 AND h1 GROUP BY 1),
        k AS (SELECT v.*, mr FROM v JOIN m ON v.hood_code = m.hood_code WHERE x BETWEEN l2 AND h2 AND ratio BETWEEN 0.5 AND 2.0), km AS (SELECT hood_code, quantile_cont(x, 0.5) AS mk FROM k GROUP BY 1),
        lg AS (SELECT k.hood_code, regr_slope((ratio - mr) / mr, log2(x / mk)) AS prb, count(*) AS n FROM k JOIN km ON k.hood_code = km.hood_code GROUP BY 1),
        cu AS (SELECT v.hood_code, regr_slope(ratio - mr, cbrt(x) - mc) AS prb, count(*) AS n FROM v JOIN m ON v.hood_code = m.hood_code GROUP BY 1)
        SELECT 'linear' AS kind, hood_code, round(prb, 6) AS prb, n AS n_used FROM lin UNION ALL SELECT 'log2', hood_code, CASE WHEN n > 30 THEN round(prb, 6) END, n FROM lg
        UNION ALL SELECT 'cuberoot', hood_code, CASE WHEN n >= 50 THEN round(prb, 6) END, n FROM cu""",
)
def _(t):
    rows = _with_ratio(t)
    parts = [ra.prb(rows, ["hood_code"], k).select(F.lit(k).alias("kind"), "hood_code", *r6("prb"), "n_used") for k in ("linear", "log2", "cuberoot")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "r04_model_fit_stats",
    f"""WITH {SAMPLE_SQL}, v AS (SELECT *, (assessed_value + sale_price) / 2 AS x, row_number() OVER (PARTITION BY hood_code ORDER BY (assessed_value + sale_price) / 2) AS rn, count(*) OVER (PARTITION BY hood_code) AS n FROM sample),
        m AS (SELECT hood_code, quantile_cont(ratio, 0.5) AS med FROM v GROUP BY 1)
        SELECT v.hood_code, count(*) AS n, round(any_value(med), 6) AS median_ratio, round(quantile_cont(abs(ratio - med) / med, 0.5) * 100, 6) AS cod,
               round(avg(ratio) FILTER (rn > n // 2) / avg(ratio) FILTER (rn <= n // 2), 6) AS prd,
               round(avg(ratio) FILTER (ratio >= med) / avg(ratio) FILTER (ratio < med), 6) AS prd_by_ratio
        FROM v JOIN m ON v.hood_code = m.hood_code GROUP BY 1""",
)
def _(t):
    rows = _with_ratio(t)
    a = ra.model_fit_stats(rows, ["hood_code"], "proxy")
    b = ra.model_fit_stats(rows, ["hood_code"], "ratio").select("hood_code", c("prd").alias("prd_by_ratio"))
    return a.join(b, "hood_code").select("hood_code", "n", *r6("median_ratio", "cod", "prd", "prd_by_ratio"))


@query(
    "r05_inverted_ratio_stats",
    f"""WITH {SAMPLE_SQL}, v AS (SELECT hood_code, 1 / (sale_price / assessed_value) AS r, sale_price AS p FROM sample), m AS (SELECT hood_code, quantile_cont(r, 0.5) AS med FROM v GROUP BY 1)
        SELECT v.hood_code, count(*) AS n, round(any_value(med), 6) AS median_ratio, round(avg(abs(r - med)) / any_value(med) * 100, 6) AS cod, round(avg(r) / (sum(r * p) / sum(p)), 6) AS prd
        FROM v JOIN m ON v.hood_code = m.hood_code GROUP BY 1""",
)
def _(t):
    rows = _with_ratio(t).withColumn("model_ratio", c("sale_price") / c("assessed_value"))
    return ra.iaao_stats(rows, ["hood_code"], "model_ratio").select("hood_code", "n", *r6("median_ratio", "cod", "prd"))


FEATURE_SQL = f"""{DATASET_SQL},
    aged AS (SELECT *, CAST(greatest(2025 - year_built, 0) AS DOUBLE) AS age, ln(greatest(living_area, 1)) AS log_area,
             date_diff('day', DATE '1995-01-01', CAST(sale_date AS DATE)) / 30.4375 AS t FROM dataset),
    g AS (SELECT avg(log_area) AS ma, avg(t) AS mt, quantile_cont(CAST(quality_score AS DOUBLE), 0.5) AS mq, quantile_cont(CAST(condition_score AS DOUBLE), 0.5) AS mc FROM aged),
    feat AS (SELECT sale_id, parcel_id, sale_price, living_area, lot_acres, valuation_area, is_view, has_garage, has_basement, ln(sale_price) AS log_price, log_area, t, ln(1 + lot_acres) AS log_lot, ln(1 + age) AS log_age,
             pow(log_area - ma, 2) AS log_area_sq, pow(t - mt, 2) AS t_sq, ln(1 + floor_area_ratio) AS log_far, ln(1 + greatest(coalesce(2025 - eff_year_built, age), 0)) AS log_eff_age,
             (bathrooms + 0.5) / greatest(bedrooms, 1) AS baths_per_bed, CASE WHEN coalesce(total_market_value, 0) = 0 THEN 0 ELSE greatest(0, least(1, land_market_value / total_market_value)) END AS land_share,
             coalesce(CAST(quality_score AS DOUBLE), mq) AS quality_score, coalesce(CAST(condition_score AS DOUBLE), mc) AS condition_score,
             CASE WHEN quality_score IS NULL THEN 1 ELSE 0 END AS missing_quality, CASE WHEN condition_score IS NULL THEN 1 ELSE 0 END AS missing_condition,
             CASE WHEN total_market_value IS NOT NULL THEN ln(1 + greatest(total_market_value, 0)) END AS log_total_mv FROM aged, g)"""


def feature_rows(t):
    return ft.features(dataset(t), anchor="1995-01-01")


_FEATS = ["log_area", "t", "log_lot", "log_age", "log_area_sq", "t_sq", "log_far", "log_eff_age", "baths_per_bed", "land_share", "quality_score", "condition_score", "log_total_mv"]


@query(
    "r06_features",
    f"""WITH {FEATURE_SQL} SELECT sale_id, missing_quality, missing_condition, {', '.join(f'round({x}, 6) AS {x}' for x in _FEATS)},
        round(log_area * t, 6) AS area_time, round(land_share * t, 6) AS land_time, round(log_area * quality_score, 6) AS area_quality FROM feat""",
)
def _(t):
    return feature_rows(t).select("sale_id", "missing_quality", "missing_condition", *r6(*_FEATS, "area_time", "land_time", "area_quality"))


@query(
    "r07_terrain_features",
    """SELECT ix, iy, round(ln(1 + greatest(z, 0)), 6) AS elev_log, round(ln(1 + z / 3), 6) AS slope_log, round(sin(radians(z * 3)), 6) AS aspect_sin, round(cos(radians(z * 3)), 6) AS aspect_cos,
              round(z / 3 * z / 3, 6) AS slope_sq, round(CASE WHEN ix % 5 = 0 THEN NULL ELSE ln(1 + ix * 1e1) END, 6) AS dist_major_road_log, 0e0 AS far FROM terrain""",
)
def _(t):
    rows = t.terrain.withColumns(
        {"elevation": c("z"), "slope": c("z") / 3, "aspect": c("z") * 3, "dist_major_road": F.when(c("ix") % 5 != 0, c("ix") * 1e1)}
    )
    return ft.geo_features(rows).select(
        "ix", "iy", *r6("elev_log", "slope_log", "aspect_sin", "aspect_cos", "slope_sq", "dist_major_road_log"), c("far").cast("double").alias("far")
    )


@query(
    "r08_interactions",
    f"""WITH {FEATURE_SQL} SELECT sale_id, round(log_lot * is_view, 6) AS lot_view, round(log_area * log_age * quality_score, 6) AS area_age_quality, CAST(has_garage * has_basement AS DOUBLE) AS garage_basement FROM feat""",
)
def _(t):
    rows, _report = ft.interactions(feature_rows(t), ["lot_view", "area_age_quality", "garage_basement", "unknown"])
    return rows.select("sale_id", *r6("lot_view", "area_age_quality"), "garage_basement")


@query(
    "r10_group_trim",
    f"""WITH {DATASET_SQL}, q AS (SELECT valuation_area, quantile_cont(sale_price, 0.05) AS pl, quantile_cont(sale_price, 0.95) AS ph, quantile_cont(living_area, 0.02) AS al, quantile_cont(living_area, 0.98) AS ah FROM dataset GROUP BY 1)
        SELECT sale_id FROM dataset d JOIN q ON d.valuation_area = q.valuation_area WHERE sale_price BETWEEN pl AND ph AND living_area BETWEEN al AND ah""",
)
def _(t):
    return ft.trim(dataset(t), ["valuation_area"], {"sale_price": (0.05, 0.95), "living_area": (0.02, 0.98)}).select("sale_id")


@query(
    "r11_quantile_bins",
    f"""WITH {DATASET_SQL}, q AS (SELECT valuation_area, list_transform(range(1, 5), lambda i: i / 5.0) AS ps, quantile_cont(sale_price, [0.2, 0.4, 0.6, 0.8]) AS e, quantile_cont(sale_price, [0.33, 0.66]) AS e3,
              list_distinct(quantile_cont(CAST(bedrooms AS DOUBLE), [0, 0.25, 0.5, 0.75, 1])) AS eb FROM dataset GROUP BY 1)
        SELECT sale_id, CAST(len(list_filter(e, lambda x: x < sale_price)) AS INT) AS bin, (['LOW', 'MID', 'HIGH'])[len(list_filter(e3, lambda x: x < sale_price)) + 1] AS value_tier,
               CAST(len(list_filter(list_sort(eb)[2:len(eb) - 1], lambda x: x < bedrooms)) AS INT) AS bed_bin FROM dataset d JOIN q ON d.valuation_area = q.valuation_area""",
)
def _(t):
    rows = ft.qcut(dataset(t), "sale_price", [0, 0.2, 0.4, 0.6, 0.8, 1.0], ["valuation_area"])
    rows = ft.qcut(ft.quick_tiers(rows, ["valuation_area"]), "bedrooms", [0, 0.25, 0.5, 0.75, 1.0], ["valuation_area"], "bed_bin")
    return rows.select("sale_id", "bin", "value_tier", "bed_bin")


@query(
    "r11_price_tier_dummies",
    f"""WITH {DATASET_SQL}, q AS (SELECT quantile_cont(sale_price, [0.2, 0.4, 0.6, 0.8]) AS e FROM dataset), b AS (SELECT sale_id, len(list_filter(e, lambda x: x < sale_price)) AS k FROM dataset, q)
        SELECT sale_id, CAST(CASE WHEN k = 1 THEN 1 ELSE 0 END AS DOUBLE) AS pt_1, CAST(CASE WHEN k = 2 THEN 1 ELSE 0 END AS DOUBLE) AS pt_2, CAST(CASE WHEN k = 4 THEN 1 ELSE 0 END AS DOUBLE) AS pt_4 FROM b""",
)
def _(t):
    return ft.price_tier_dummies(dataset(t)).select("sale_id", c("`pt_1.0`").alias("pt_1"), c("`pt_2.0`").alias("pt_2"), c("`pt_4.0`").alias("pt_4"))


@query(
    "r13_tier_terms",
    f"""WITH {FEATURE_SQL}, q AS (SELECT valuation_area, quantile_cont(sale_price, [0.33, 0.66]) AS e3 FROM feat GROUP BY 1),
        b AS (SELECT f.*, len(list_filter(e3, lambda x: x < sale_price)) AS k FROM feat f JOIN q ON f.valuation_area = q.valuation_area)
        SELECT sale_id, round(CASE WHEN k = 0 THEN t ELSE 0 END, 6) AS t_T1, round(CASE WHEN k = 1 THEN log_area ELSE 0 END, 6) AS log_area_T2, round(CASE WHEN k = 2 THEN quality_score ELSE 0 END, 6) AS quality_score_T3 FROM b""",
)
def _(t):
    rows = ft.quick_tiers(feature_rows(t), ["valuation_area"])
    named = F.element_at(F.create_map(*[F.lit(x) for x in ("LOW", "T1_LOW", "MID", "T2_MID", "HIGH", "T3_HIGH")]), c("value_tier"))
    out, _plans = ft.tier_terms(rows.withColumn("value_tier", named), list(fv.CORE_TERMS))
    return out.select("sale_id", *r6("t_T1", "log_area_T2", "quality_score_T3"))


G = ["valuation_area"]


def valued(t):
    """Rows valued by a one-term model per market area."""
    rows = feature_rows(t)
    fit = mo.ols(mo.moments(rows, G, ["log_area"], "log_price"))
    return cb.retransform(mo.predict(rows, fit, G, ["log_area"], "log_price"), G)


VALUE_SQL = f"""{FEATURE_SQL},
    co AS (SELECT valuation_area, regr_slope(log_price, log_area) AS b, regr_intercept(log_price, log_area) AS a FROM feat GROUP BY 1),
    pr AS (SELECT f.*, a + b * log_area AS pred_ln, log_price - (a + b * log_area) AS residual FROM feat f JOIN co ON f.valuation_area = co.valuation_area),
    sm AS (SELECT valuation_area, avg(exp(residual)) AS smear FROM pr GROUP BY 1),
    vals AS (SELECT pr.*, exp(pred_ln) * smear AS vhat, sale_price / (exp(pred_ln) * smear) AS ratio, (sale_price + exp(pred_ln) * smear) / 2 AS v_proxy FROM pr JOIN sm ON pr.valuation_area = sm.valuation_area)"""

CALIB_SQL = f"""{VALUE_SQL},
    be AS (SELECT valuation_area, quantile_cont(v_proxy, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e, quantile_cont(ratio, 0.5) AS tm, count(*) AS n FROM vals GROUP BY 1),
    bd AS (SELECT v.*, len(list_filter(e, lambda x: x < v_proxy)) AS band, tm, n FROM vals v JOIN be ON v.valuation_area = be.valuation_area),
    bm AS (SELECT valuation_area, band, quantile_cont(ratio, 0.5) AS bm FROM bd GROUP BY 1, 2),
    cal AS (SELECT bd.*, CASE WHEN n >= 100 THEN tm / bm ELSE 1 END AS calib_factor, ratio * CASE WHEN n >= 100 THEN tm / bm ELSE 1 END AS ratio_adj
            FROM bd JOIN bm ON bd.valuation_area = bm.valuation_area AND bd.band = bm.band),
    pq AS (SELECT valuation_area, quantile_cont(v_proxy, 0.1) AS lo, quantile_cont(v_proxy, 0.9) AS hi, quantile_cont(v_proxy, 0.5) AS mv FROM cal GROUP BY 1),
    ps AS (SELECT c.valuation_area, regr_slope(ln(ratio_adj), v_proxy / mv - 1) AS b2, count(*) AS k FROM cal c JOIN pq ON c.valuation_area = pq.valuation_area WHERE v_proxy BETWEEN lo AND hi AND ratio_adj > 0 GROUP BY 1),
    fin AS (SELECT c.*, CASE WHEN k >= 60 THEN exp(-b2 * (v_proxy / mv - 1)) ELSE 1 END AS prb_factor, ratio_adj * CASE WHEN k >= 60 THEN exp(-b2 * (v_proxy / mv - 1)) ELSE 1 END AS ratio_final, b2
            FROM cal c JOIN pq ON c.valuation_area = pq.valuation_area JOIN ps ON c.valuation_area = ps.valuation_area)"""


@query("r19_smeared_values", f"WITH {VALUE_SQL} SELECT sale_id, round(vhat, 2) AS vhat, round(ratio, 6) AS ratio, round(residual, 6) AS residual FROM vals")
def _(t):
    return valued(t).select("sale_id", F.round("vhat", 2).alias("vhat"), *r6("ratio", "residual"))


@query("r20_band_calibration", f"WITH {CALIB_SQL} SELECT sale_id, CAST(band AS INT) AS band, round(calib_factor, 6) AS calib_factor, round(ratio_adj, 6) AS ratio_adj FROM cal")
def _(t):
    return cb.band_calibration(valued(t), G).select("sale_id", "band", *r6("calib_factor", "ratio_adj"))


@query(
    "r20_calibration_bands",
    f"""WITH {CALIB_SQL} SELECT valuation_area, CAST(band AS INT) AS band, round(min(v_proxy), 4) AS value_min, round(max(v_proxy), 4) AS value_max, round(max(calib_factor), 6) AS factor, count(*) AS count
        FROM cal WHERE band IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    bands = cb.calibration_bands(cb.band_calibration(valued(t), G), G)
    return bands.select("valuation_area", "band", *[F.round(x, 4).alias(x) for x in ("value_min", "value_max")], *r6("factor"), "count")


def final(t):
    return cb.prb_flatten(cb.band_calibration(valued(t), G), G)


@query("r21_bias_flattening", f"WITH {CALIB_SQL} SELECT sale_id, round(prb_factor, 6) AS prb_factor, round(ratio_final, 6) AS ratio_final FROM fin")
def _(t):
    return final(t).select("sale_id", *r6("prb_factor", "ratio_final"))


_DRIVERS = ["log_area", "log_lot", "quality_score", "t", "is_view"]


@query(
    "r22_bias_drivers",
    f"""WITH {CALIB_SQL}, m AS (SELECT valuation_area, quantile_cont(ratio_final, 0.5) AS mr FROM fin GROUP BY 1),
        l AS ({" UNION ALL ".join(f"SELECT f.valuation_area, '{x}' AS predictor, CAST({x} AS DOUBLE) AS x, ratio_final / mr - 1 AS y, v_proxy AS v FROM fin f JOIN m ON f.valuation_area = m.valuation_area" for x in _DRIVERS)}),
        s AS (SELECT valuation_area, predictor, count(*) AS n, count(DISTINCT x) AS d, regr_slope(y, x) * (stddev_samp(x) + 1e-9) AS slope, corr(x, v) AS skew FROM l GROUP BY 1, 2)
        SELECT valuation_area, predictor, round(slope, 4) AS slope, round(skew, 4) AS val_skew, round(abs(slope) * (abs(skew) + 0.05), 4) AS score FROM s WHERE n >= 60 AND d >= 3""",
)
def _(t):
    return cb.prb_drivers(final(t), G, _DRIVERS)


@query(
    "r23_segment_diagnostics",
    f"""WITH {CALIB_SQL}, mo AS (SELECT valuation_area, avg(ratio) AS mu FROM fin GROUP BY 1),
        cm AS (SELECT f.valuation_area, count(*) AS n, avg(pow(ratio - mu, 2)) AS m2, avg(pow(ratio - mu, 3)) AS m3, avg(pow(ratio - mu, 4)) AS m4, quantile_cont(ratio, 0.1) AS p10, quantile_cont(ratio, 0.5) AS p50, quantile_cont(ratio, 0.9) AS p90
               FROM fin f JOIN mo ON f.valuation_area = mo.valuation_area GROUP BY 1),
        rn AS (SELECT *, row_number() OVER (PARTITION BY valuation_area ORDER BY v_proxy) AS rk, count(*) OVER (PARTITION BY valuation_area) AS nn FROM fin),
        md AS (SELECT valuation_area, quantile_cont(ratio_final, 0.5) AS med FROM fin GROUP BY 1),
        ft AS (SELECT r.valuation_area, any_value(med) AS med, quantile_cont(abs(ratio_final - med) / med, 0.5) * 100 AS cod, avg(ratio_final) FILTER (rk > nn // 2) / avg(ratio_final) FILTER (rk <= nn // 2) AS prd FROM rn r JOIN md ON r.valuation_area = md.valuation_area GROUP BY 1),
        pb AS (SELECT f.valuation_area, regr_slope(ratio_final / med - 1, v_proxy / mv - 1) AS prb FROM fin f JOIN pq ON f.valuation_area = pq.valuation_area JOIN md ON f.valuation_area = md.valuation_area WHERE v_proxy BETWEEN lo AND hi GROUP BY 1),
        wo AS (SELECT valuation_area, string_agg(CAST(sale_id AS VARCHAR), ';' ORDER BY k) AS worst FROM (SELECT valuation_area, sale_id, row_number() OVER (PARTITION BY valuation_area ORDER BY abs(residual) DESC, sale_id) AS k FROM fin) WHERE k <= 3 GROUP BY 1)
        SELECT cm.valuation_area, n, round(cod, 2) AS cod, round(prd, 3) AS prd, round(prb, 3) AS prb, round(med, 3) AS median_ratio,
               round(m3 / pow(m2, 1.5) * sqrt(n * (n - 1.0)) / (n - 2.0), 6) AS skew, round((n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * (m4 / (m2 * m2) - 3) + 6), 6) AS kurt,
               round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90, worst,
               concat_ws(';', CASE WHEN n < 50 THEN 'Limited sample size' END, CASE WHEN round(cod, 2) > 15 THEN 'COD above IAAO target' END, CASE WHEN NOT round(prd, 3) BETWEEN 0.98 AND 1.03 THEN 'PRD outside target' END,
                         CASE WHEN abs(round(prb, 3)) > 0.05 THEN 'PRB drift' END, CASE WHEN round(med, 3) < 0.9 OR round(med, 3) > 1.1 THEN 'Median ratio off target' END) AS flags
        FROM cm JOIN ft ON cm.valuation_area = ft.valuation_area JOIN pb ON cm.valuation_area = pb.valuation_area JOIN wo ON cm.valuation_area = wo.valuation_area""",
)
def _(t):
    out = cb.segment_diagnostics(final(t), G)
    worst = F.array_join(F.transform("outliers", lambda o: o["sale_id"].cast("string")), ";")
    return out.select(
        "valuation_area", "n", "cod", "prd", "prb", "median_ratio", *r6("skew", "kurt", "p10", "p50", "p90"), worst.alias("worst"), F.array_join("flags", ";").alias("flags")
    )


@query(
    "r24_time_trend",
    f"WITH {CALIB_SQL} SELECT valuation_area, CAST(regr_count(ratio_final, t) AS BIGINT) AS n, round(regr_slope(ratio_final, t), 8) AS slope, round(regr_r2(ratio_final, t), 8) AS r2 FROM fin GROUP BY 1",
)
def _(t):
    out = cb.time_trend(final(t), G)
    return out.select("valuation_area", "n", F.round("slope", 8).alias("slope"), F.round("r2", 8).alias("r2"))


@query("r24_time_trend_p_values")
def _(t):
    return cb.time_trend(final(t), G).select("valuation_area", "p_value")


@query(
    "r25_chart_sample",
    f"""WITH {DATASET_SQL} SELECT sale_id FROM (SELECT sale_id, row_number() OVER (PARTITION BY valuation_area ORDER BY md5(CAST(sale_id AS VARCHAR)), sale_id) AS rn FROM dataset) WHERE rn <= 5000""",
)
def _(t):
    return cb.chart_sample(dataset(t), G).select("sale_id")
