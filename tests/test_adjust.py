import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from parcelmill.operators import adjust as ad
from parcelmill.plans.comparables import BETAS

S = dict(gla=2100, lot_acres=0.3, age=18, quality_score=3.5, condition_score=3.0, has_garage=1, has_basement=0, is_view=1, sale_date=dt.date(2024, 1, 15))
C = dict(gla=1900, lot_acres=0.2, age=25, quality_score=3.0, condition_score=3.2, has_garage=0, has_basement=1, is_view=0, sale_date=dt.date(2023, 7, 15))
PRICE, SALE, VALUATION = 600000.0, 540000.0, dt.date(2024, 1, 15)


def frame(spark, betas=BETAS):
    df = spark.createDataFrame([("C1",)], "comp_id string").withColumns(
        {f"s_{k}": F.lit(v) for k, v in S.items()} | {f"c_{k}": F.lit(v) for k, v in C.items()}
    )
    m = F.create_map(*[F.lit(x) for kv in betas.items() for x in kv])
    return df.withColumns({"betas": m, "subject_pred_price": F.lit(PRICE), "c_sale_price": F.lit(SALE), "valuation_date": F.lit(VALUATION), "subject_id": F.lit("S")})


def test_closed_formulas(spark):
    row = ad.adjusted_comps(frame(spark)).first()
    deltas = {
        "area": 0.12 * (math.log(2100) - math.log(1900)), "lot": 0.05 * (math.log1p(0.3) - math.log1p(0.2)), "age": -0.03 * (math.log1p(18) - math.log1p(25)),
        "quality": 0.02 * 0.5, "condition": 0.015 * -0.2, "garage": 0.01, "basement": -0.035, "view": 0.025,
    }
    amounts = {k: PRICE * (math.exp(v) - 1) for k, v in deltas.items()}
    months = (VALUATION - C["sale_date"]).days / 30.4375
    amounts["time"] = SALE * (math.exp((0.01 - 0.002 * math.log(1900)) * months) - 1)
    for k, v in amounts.items():
        assert row[f"adj_{k}"] == pytest.approx(v, abs=0.006)
    assert row["total_adjustment"] == pytest.approx(sum(amounts.values()), abs=0.01)
    assert row["adjusted_value"] == pytest.approx(SALE + sum(amounts.values()), abs=0.01)


def test_missing_terms_and_grid(spark):
    short = {k: v for k, v in BETAS.items() if k != "log_lot"}
    row = ad.adjusted_comps(frame(spark, short)).first()
    assert row["missing_terms"] == ["log_lot"] and row["adjusted_value"] is None
    grid = ad.comparison_grid(ad.adjusted_comps(frame(spark))).first()["adjustment_list"]
    assert grid[0]["delta_text"] == "Living area difference: +200 sqft (Subject higher)."
    assert grid[7]["delta_text"].startswith("View: Subject has this feature")


def test_predicted_price(spark):
    row = ad.predict_price(frame(spark), prefix="s_").first()
    t = (S["sale_date"] - dt.date(2015, 1, 1)).days / 30.4375
    want = (
        11 + 0.12 * math.log(2100) + 0.05 * math.log1p(0.3) - 0.03 * math.log1p(18) + 0.02 * 3.5 + 0.015 * 3 + 0.01 + 0.025
        + 0.01 * t - 0.002 * math.log(2100) * t
    )
    assert row["predicted_price"] == pytest.approx(math.exp(want), rel=1e-9)


def test_unknown_sale_date_gives_no_time_adjustment(spark):
    assert ad.adjusted_comps(frame(spark).withColumn("c_sale_date", F.lit(None).cast("date"))).first()["adj_time"] == 0.0
