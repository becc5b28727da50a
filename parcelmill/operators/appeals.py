"""Appeal screening and neighborhood fairness."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv
from parcelmill.operators import comps as cm
from parcelmill.operators.windows import first_by, snapshot_delta

c = F.col
say = fv.APPEAL_REASONS


def over_assessment(assessed: Column, median_price: Column) -> Column:
    """Percent by which the assessed value exceeds the median comparable price."""
    return F.when((assessed != 0) & (median_price != 0), (assessed - median_price) / median_price * 100)


def appeal_score(over: Column, comps: Column, neighbor_gap: Column, reliability: Column, cod: Column) -> dict[str, Column]:
    """Score 0-100, its rating and the first four reasons."""
    comps = F.coalesce(comps, F.lit(0))
    points = (
        F.lit(50)
        + F.when(over >= 20, 25).when(over >= 12, 18).when(over >= 7, 10).when(over <= 0, -20).when(over.isNotNull(), 2).otherwise(0)
        + F.when(comps >= 5, 10).when(comps >= 3, 5).otherwise(-15)
        + F.when(neighbor_gap >= 8, 12).when(neighbor_gap >= 4, 6).when(neighbor_gap <= 0, -10).otherwise(0)
        + F.when(reliability == "LOW", 6).when(reliability == "HIGH", -4).otherwise(0)
        + F.when(cod >= 18, 6).when(cod <= 8, -2).otherwise(0)
    )
    score = F.greatest(F.lit(0), F.least(F.lit(100), points))
    reasons = F.array_compact(
        F.array(
            F.when(over >= 20, say["over_20"])
            .when(over >= 12, say["over_12"])
            .when(over >= 7, say["over_7"])
            .when(over <= 0, say["not_over"])
            .when(over.isNotNull(), say["slightly_over"]),
            F.when(comps >= 5, say["comps_5"])
            .when(comps >= 3, say["comps_3"])
            .otherwise(say["comps_few"]),
            F.when(neighbor_gap >= 8, say["gap_8"])
            .when(neighbor_gap >= 4, say["gap_4"])
            .when(neighbor_gap <= 0, say["gap_none"]),
            F.when(reliability == "LOW", say["unreliable"]).when(
                reliability == "HIGH", say["reliable"]
            ),
        )
    )
    rating = F.when(score >= 80, "Very Strong").when(score >= 65, "Strong").when(score >= 50, "Moderate").otherwise("Weak")
    return {"score": score, "rating": rating, "reasons": F.slice(reasons, 1, 4)}


def soft_stop(over: Column, comps: Column, neighbor_gap: Column, score: Column) -> dict[str, Column]:
    """Reasons that speak against an appeal, and whether there is any."""
    reasons = F.array_compact(
        F.array(
            F.when(over < 7, say["stop_over"]),
            F.when(F.coalesce(comps, F.lit(0)) < 3, say["stop_comps"]),
            F.when(neighbor_gap <= 0, say["stop_gap"]),
            F.when(score < 45, say["stop_score"]),
        )
    )
    return {"soft_stop": F.size(reasons) > 0, "soft_reasons": reasons}


def screen_roll(
    parcels: DataFrame, sales: DataFrame, metrics: DataFrame, as_of: dt.date, limit: int = 7, days: int | None = 540,
    change: DataFrame | None = None,
) -> DataFrame:
    """Appeal score of every residential parcel of a roll.

    `metrics` holds one snapshot per hood (reliability, cod, avg_change_pct);
    `change` optionally each parcel's own change in percent.
    """
    subjects = cm.subject_facts(parcels)
    pool = cm.comp_pool(parcels, sales, as_of, days)
    chosen = cm.comp_candidates(subjects, pool, max(limit, 8) * 2, 4828.0, lambda rows: cm.escalate_radius(rows, limit))
    # At most `limit` prices per subject enter this median.
    prices = chosen.groupBy("subject_id").agg(F.median("c_sale_price").alias("median_price"), F.count(F.lit(1)).alias("comp_count"))
    rows = subjects.select(c("parcel_id").alias("subject_id"), "hood_code", "value").join(prices, "subject_id", "left")
    rows = rows.join(metrics.select("hood_code", "reliability", "cod", "avg_change_pct"), "hood_code", "left")
    if change is not None:
        rows = rows.join(change.select(c("parcel_id").alias("subject_id"), "change_pct"), "subject_id", "left")
    else:
        rows = rows.withColumn("change_pct", F.lit(None).cast("double"))
    rows = rows.withColumns(
        {
            "comp_count": F.coalesce("comp_count", F.lit(0)),
            "over_pct": over_assessment(c("value"), c("median_price")),
            "neighbor_gap": c("change_pct") - c("avg_change_pct"),
        }
    )
    rows = rows.withColumns(appeal_score(c("over_pct"), c("comp_count"), c("neighbor_gap"), c("reliability"), c("cod")))
    return rows.withColumns(soft_stop(c("over_pct"), c("comp_count"), c("neighbor_gap"), c("score")))


def hood_snapshot(metrics: DataFrame, year: int | None = None, key: str = "hood_code") -> DataFrame:
    """Metrics of each hood in a year (or its newest), gauge positions and reliability bucket."""
    with_prior = snapshot_delta(metrics, key)
    rows = with_prior.where(c("metric_year") == year) if year else first_by(with_prior, [key], [c("metric_year").desc()])

    def gauge(x: Column) -> Column:
        return F.when(x.isNotNull(), F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), x)), 1))

    text = F.upper(F.trim(F.coalesce(c("reliability"), F.lit(""))))
    known = F.when(text.isin("HIGH", "MEDIUM", "LOW"), text)
    guessed = F.when(
        (c("sample_size") > 0) & c("cod").isNotNull(),
        F.when((c("sample_size") >= 30) & (c("cod") < 10), "HIGH").when((c("sample_size") >= 15) & (c("cod") < 15), "MEDIUM").otherwise("LOW"),
    )
    return rows.withColumns(
        {
            "sales_ratio_pos": gauge((c("sales_ratio") / 100.0 - 0.8) / 0.4 * 100),
            "prd_pos": gauge((c("prd") - 0.90) / 0.20 * 100),
            "cod_pos": gauge(c("cod") / 40 * 100),
            "reliability": F.coalesce(known, guessed, F.nullif(text, F.lit("")), F.lit("UNKNOWN")),
        }
    )


def fairness_status(df: DataFrame) -> DataFrame:
    """Level, uniformity and vertical equity labels of a neighborhood."""
    level = (
        F.when(c("sales_ratio").isNull(), "Level unknown").when(c("sales_ratio").between(90, 110), "Within IAAO range").otherwise("Outside IAAO range")
    )
    uniformity = (
        F.when(c("cod").isNull(), "Uniformity unknown").when(c("cod") < 10, "Excellent uniformity").when(c("cod") < 15, "Acceptable uniformity")
        .otherwise("Patchy uniformity")
    )
    equity = (
        F.when(c("prd").isNull(), "Vertical equity unknown").when(c("prd").between(0.98, 1.03), "Balanced by value")
        .when(c("prd") > 1.03, "Regressive pattern").otherwise("Progressive pattern")
    )
    return df.withColumns({"level_status": level, "cod_status": uniformity, "prd_status": equity})


def save_package(chosen: DataFrame, analysis_id: str) -> DataFrame:
    """Selected comparables as stored rows: rank and decimal prices."""
    money = c("c_sale_price").cast("decimal(15,2)")
    return chosen.select(
        F.lit(analysis_id).alias("analysis_id"), "subject_id", c("comp_id").alias("parcel_id"), F.lit(True).alias("included"), "rank",
        money.alias("raw_sale_price"), money.alias("adjusted_sale_price"), F.lit(0).cast("decimal(6,2)").alias("gross_percentage_adjustment"),
    )
