"""Queries for segmented models, tuning, publication and run comparison."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv
from parcelmill.operators import features as ft
from parcelmill.operators import models as md
from parcelmill.operators import moments as mo
from parcelmill.plans.aggregating import r6
from parcelmill.plans.joining import dataset
from parcelmill.plans.ratios import FEATURE_SQL, G, feature_rows
from parcelmill.plans.registry import query

c = F.col


_REPORTED = ("log_area", "log_lot", "log_age", "quality_score", "t")


@query(
    "r09_predictor_report",
    f"""WITH {FEATURE_SQL}, v AS (UNPIVOT (SELECT """ + ", ".join(f"CAST({x} AS DOUBLE) AS {x}" for x in _REPORTED) + """ FROM feat) ON """ + ", ".join(_REPORTED) + """ INTO NAME term VALUE value),
        n AS (SELECT count(*) AS rows FROM feat)
        SELECT term, round(count(value) / any_value(rows), 6) AS present, count(DISTINCT value) AS distinct_values, round(var_samp(value), 6) AS variance FROM v, n GROUP BY term""",
)
def _(t):
    return ft.term_report(feature_rows(t), _REPORTED).select("term", *r6("present"), "distinct_values", *r6("variance"))


@query(
    "r12_price_tiers",
)
def _(t):
    tiered = md.price_tiers(feature_rows(t), "valuation_area", ["log_area", "log_age", "log_lot", "quality_score", "t"], min_group=350)
    return tiered.groupBy("valuation_area", "value_tier").agg(F.count(F.lit(1)).alias("sales"), F.round(F.avg("sale_price"), 2).alias("avg_price"))


@query("r12_tier_bands")
def _(t):
    tiered = md.price_tiers(feature_rows(t), "valuation_area", ["log_area", "log_age", "quality_score"], min_group=350)
    return md.tier_bands(tiered, "valuation_area")


@query(
    "r14_ols_one_term",
    f"""WITH {FEATURE_SQL} SELECT valuation_area, count(*) AS n, round(regr_intercept(log_price, log_area), 6) AS const, round(regr_slope(log_price, log_area), 6) AS log_area, round(regr_r2(log_price, log_area), 6) AS r2 FROM feat GROUP BY 1""",
)
def _(t):
    fit = mo.ols(mo.moments(feature_rows(t), G, ["log_area"], "log_price"))
    return fit.groupBy("valuation_area").agg(
        F.max("n").alias("n"), *[F.round(F.max(F.when(c("term") == x, c("beta"))), 6).alias(x) for x in ("const", "log_area")], F.round(F.max("r2"), 6).alias("r2")
    )


_TWO = """b AS (SELECT valuation_area, count(*) AS n, var_pop(log_area) AS s11, var_pop(log_lot) AS s22, covar_pop(log_area, log_lot) AS s12, covar_pop(log_price, log_area) AS y1,
    covar_pop(log_price, log_lot) AS y2, avg(log_price) AS my, avg(log_area) AS m1, avg(log_lot) AS m2 FROM feat GROUP BY 1)"""


@query(
    "r14_ols_two_terms",
    f"""WITH {FEATURE_SQL}, {_TWO}, s AS (SELECT *, (y1 * s22 - y2 * s12) / (s11 * s22 - s12 * s12) AS b1, (y2 * s11 - y1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM b)
        SELECT valuation_area, round(my - b1 * m1 - b2 * m2, 6) AS const, round(b1, 6) AS log_area, round(b2, 6) AS log_lot FROM s""",
)
def _(t):
    fit = mo.ols(mo.moments(feature_rows(t), G, ["log_area", "log_lot"], "log_price"))
    return fit.groupBy("valuation_area").agg(*[F.round(F.max(F.when(c("term") == x, c("beta"))), 6).alias(x) for x in ("const", "log_area", "log_lot")])


_TERMS = ["log_area", "log_age", "log_lot", "quality_score", "condition_score", "t", "has_garage", "is_view"]


@query(
    "r15_robust_errors_one_term",
    f"""WITH {FEATURE_SQL}, r AS (SELECT valuation_area AS g, log_area AS x, log_price AS y FROM feat WHERE log_area IS NOT NULL AND log_price IS NOT NULL),
        m AS (SELECT g, avg(x) AS mx FROM r GROUP BY 1), z AS (SELECT r.g, x - mx AS x, y, mx FROM r JOIN m ON r.g IS NOT DISTINCT FROM m.g),
        s AS (SELECT g, count(*) AS n, any_value(mx) AS mx, sum(x * x) AS sxx, avg(y) AS my, sum(x * y) AS sxy FROM z GROUP BY 1),
        w AS (SELECT z.g, z.x, pow((y - my - sxy / sxx * z.x) / (1 - 1e0 / n - z.x * z.x / sxx), 2) AS w FROM z JOIN s ON z.g IS NOT DISTINCT FROM s.g),
        k AS (SELECT g, sum(w) AS w0, sum(w * x) AS w1, sum(w * x * x) AS w2 FROM w GROUP BY 1),
        v AS (SELECT s.g, w0 / (n * n) AS v00, w1 / (n * sxx) AS v01, w2 / (sxx * sxx) AS v11, mx FROM s JOIN k ON s.g IS NOT DISTINCT FROM k.g)
        SELECT g AS valuation_area, 'log_area' AS term, round(sqrt(v11), 6) AS beta_se FROM v
        UNION ALL SELECT g, 'const', round(sqrt(v00 - 2 * mx * v01 + mx * mx * v11), 6) FROM v""",
)
def _(t):
    rows = feature_rows(t)
    return mo.hc3(rows, mo.moments(rows, G, ["log_area"], "log_price")).select("valuation_area", "term", *r6("beta_se"))


@query("r15_robust_errors")
def _(t):
    rows = feature_rows(t)
    return mo.hc3(rows, mo.moments(rows, G, _TERMS, "log_price"))


@query("r16_stepwise_terms")
def _(t):
    rows = feature_rows(t)
    mom = mo.moments(rows, G, [*fv.CORE_TERMS, "log_lot", "land_share", "has_garage", "has_basement", "is_view", "log_far", "baths_per_bed"], "log_price", required=fv.CORE_TERMS)
    return mo.stepwise(mom, fv.CORE_TERMS, ["log_lot", "land_share", "has_garage", "has_basement", "is_view", "log_far", "baths_per_bed"])


@query(
    "r17_vif_two_terms",
    f"""WITH {FEATURE_SQL}, r AS (SELECT valuation_area, 1 / (1 - pow(corr(log_area, log_lot), 2)) AS v FROM feat GROUP BY 1)
        SELECT valuation_area, term, round(v, 6) AS vif FROM r, (SELECT unnest(['log_area', 'log_lot']) AS term)""",
)
def _(t):
    return mo.vif(mo.moments(feature_rows(t), G, ["log_area", "log_lot"], "log_price")).select("valuation_area", "term", *r6("vif"))


@query("r17_vif_pruning")
def _(t):
    mom = mo.moments(feature_rows(t), G, _TERMS, "log_price", standardize=False)
    return mo.vif_prune(mom, _TERMS, protected=("log_area", "t"))


@query("r18_family_rules")
def _(t):
    terms = ["log_area", "log_lot", "land_share", "log_land_value", "t", "area_time", "area_quality", "area_condition"]
    return mo.apply_family_rules(mo.ols(mo.moments(feature_rows(t), G, terms, "log_price")), G)


@query("r14_segment_models")
def _(t):
    return md.run_model(dataset(t), anchor="1995-01-01", min_group=350)["coefficients"]


@query("r23_segment_model_diagnostics")
def _(t):
    from parcelmill.operators.calibrate import segment_diagnostics

    return segment_diagnostics(md.run_model(dataset(t), anchor="1995-01-01", min_group=350)["values"], ["valuation_area", "value_tier"])


def _agent_rows(t):
    return dataset(t).withColumn("lot_size", c("lot_acres")).withColumn("quality_score", F.coalesce("quality_score", F.lit(3)))


@query("r26_ridge_fit")
def _(t):
    fit, _scored = md.fit_setting(_agent_rows(t), {"poly_degree": 2, "ridge_alpha": 0.1})
    return fit.select("term", "beta", "n")


@query("r29_tuned_settings")
def _(t):
    grid = [{}, {"poly_degree": 2, "ridge_alpha": 0.1}, {"include_interactions": True, "interaction_weight": 1.2}]
    return md.tune(_agent_rows(t), grid)


@query(
    "r27_published_coefficients",
    f"""WITH {FEATURE_SQL}, k AS (SELECT valuation_area, regr_intercept(log_price, log_area) AS a, regr_slope(log_price, log_area) AS b FROM feat GROUP BY 1)
        SELECT valuation_area, 'const' AS term, round(a, 6) AS beta, 'R1' AS run_id FROM k UNION ALL SELECT valuation_area, 'log_area', round(b, 6), 'R1' FROM k""",
)
def _(t):
    fit = mo.ols(mo.moments(feature_rows(t), G, ["log_area"], "log_price"))
    at = dt.datetime(2025, 1, 1)
    rows = md.publish(fit, "R1", at).unionByName(md.publish(fit, "R2", at, mode="experiment"))
    return rows.select("valuation_area", "term", *r6("beta"), "run_id")


@query(
    "r28_run_comparison",
    """WITH a AS (SELECT * FROM segment_stats WHERE run_id = 'RUN1'), b AS (SELECT * FROM segment_stats WHERE run_id = 'RUN2')
       SELECT coalesce(a.market_group, b.market_group) AS market_group, coalesce(a.value_tier, b.value_tier) AS value_tier, round(b.cod - a.cod, 6) AS cod_delta, round(b.prd - a.prd, 6) AS prd_delta, b.n - a.n AS n_delta
       FROM a FULL JOIN b ON a.market_group = b.market_group AND a.value_tier = b.value_tier""",
)
def _(t):
    return md.compare_runs(t.segment_stats, "RUN1", "RUN2").select("market_group", "value_tier", *r6("cod_delta", "prd_delta"), "n_delta")


@query(
    "r28_run_list",
    "SELECT p_partkey AS run_id FROM part WHERE p_type = 'PROMO' AND contains(lower(p_name), 'ring') AND p_size % 2 = 0 ORDER BY p_retailprice DESC, p_partkey LIMIT 200",
)
def _(t):
    runs = t.part.select(
        c("p_partkey").alias("run_id"), c("p_type").alias("status"), (c("p_size") % 2 == 0).alias("starred"), c("p_name").alias("name"), c("p_retailprice").alias("created_at")
    )
    return md.run_list(runs, "PROMO", True, "Ring").select("run_id")


@query(
    "r30_coefficient_report",
    """WITH s AS (SELECT run_id, market_group, CAST(sum(n) AS BIGINT) AS n, round(avg(cod), 6) AS cod FROM segment_stats GROUP BY 1, 2),
            k AS (SELECT run_id, CASE market_group WHEN 'BURLINGTON' THEN 'PROMO' WHEN 'CONCRETE' THEN 'SMALL' ELSE market_group END AS market_group, term, beta FROM coefficients)
       SELECT k.run_id, k.market_group, k.term, k.beta, s.n, s.cod FROM k LEFT JOIN s ON k.run_id = s.run_id AND k.market_group = s.market_group""",
)
def _(t):
    stats = t.segment_stats.groupBy("run_id", "market_group").agg(F.sum("n").alias("n"), F.round(F.avg("cod"), 6).alias("cod"))
    group = F.when(c("market_group") == "BURLINGTON", "PROMO").when(c("market_group") == "CONCRETE", "SMALL").otherwise(c("market_group"))
    return md.coefficient_report(t.coefficients.withColumn("market_group", group), stats).select("run_id", "market_group", "term", "beta", "n", "cod")


