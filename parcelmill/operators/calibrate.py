"""From fitted log prices to values, ratios, calibration and diagnostics."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from parcelmill.operators.features import qcut
from parcelmill.operators.quantiles import attach, group_quantiles, metric_quantiles
from parcelmill.operators.ratio import model_fit_stats, prb
from parcelmill.session import cut_lineage, stored

c = F.col


def retransform(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Values from log predictions with the group's smearing factor, ratio and value proxy."""
    group = list(group)
    smear = df.groupBy(*group).agg(F.avg(F.exp("residual")).alias("smear"))
    out = attach(df, smear, group, "inner").withColumn("vhat", F.exp("pred_ln") * c("smear"))
    return out.withColumns({"ratio": c("sale_price") / c("vhat"), "v_proxy": (c("sale_price") + c("vhat")) / 2.0})


def band_calibration(df: DataFrame, group: Sequence[str], bands: int = 10, value: str = "v_proxy") -> DataFrame:
    """Ratio times overall median / band median, for groups of 100 rows and 5 values or more.

    The input is written once because five passes read it, as a table: a checkpoint keeps all
    constraints Spark has inferred so far, and with them plans take ever longer to make.
    """
    group = list(group)
    df = stored(df, "band_rows")
    sizes = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("k")).groupBy(*group).agg(
        F.sum("k").alias("__n"), F.count(F.lit(1)).alias("__d")
    )
    cut = qcut(df, value, [i / bands for i in range(bands + 1)], group, "band")
    by_band = cut_lineage(group_quantiles(cut, [*group, "band"], "ratio", {"__bm": 0.5}))
    target = cut_lineage(group_quantiles(df, group, "ratio", {"__tm": 0.5}))
    rows = attach(attach(attach(cut, by_band, [*group, "band"]), target, group), sizes, group)
    enough = (c("__n") >= 100) & (c("__d") >= 5)
    factor = F.when(enough, c("__tm") / c("__bm")).otherwise(F.lit(1.0))
    return rows.withColumn("calib_factor", factor).withColumn("ratio_adj", c("ratio") * c("calib_factor")).drop(
        "__bm", "__tm", "__n", "__d"
    )


def calibration_bands(calibrated: DataFrame, group: Sequence[str], value: str = "v_proxy") -> DataFrame:
    """Value range and factor of every band of `band_calibration`."""
    return calibrated.where(c("band").isNotNull()).groupBy(*group, "band").agg(
        F.min(value).alias("value_min"), F.max(value).alias("value_max"), F.max("calib_factor").alias("factor"), F.count(F.lit(1)).alias("count")
    )


def prb_flatten(df: DataFrame, group: Sequence[str], value: str = "v_proxy", ratio: str = "ratio_adj") -> DataFrame:
    """Remove the trend of ln(ratio) on relative value, where 60 rows or more support it."""
    group = list(group)
    df = stored(df, "prb_rows")
    marks = cut_lineage(metric_quantiles(df, group, {"__lo": (value, 0.1), "__hi": (value, 0.9), "__m": (value, 0.5)}))
    rows = attach(df, marks, group)
    dev = c(value) / c("__m") - 1.0
    used = (c(ratio) > 0) & c(value).between(c("__lo"), c("__hi"))
    slope = rows.groupBy(*group).agg(
        F.regr_slope(F.when(used, F.log(c(ratio))), F.when(used, dev)).alias("__b"), F.count_if(used).alias("__k")
    )
    out = attach(rows, slope, group)
    ok = (c("__k") >= 60) & c("__b").isNotNull()
    factor = F.when(ok, F.exp(-c("__b") * dev)).otherwise(F.lit(1.0))
    return out.withColumns({"prb_factor": factor, "ratio_final": c(ratio) * factor, "slope_before": F.when(ok, c("__b"))}).drop(
        "__lo", "__hi", "__m", "__b", "__k"
    )


def prb_drivers(df: DataFrame, group: Sequence[str], terms: Sequence[str], ratio: str = "ratio_final", value: str = "v_proxy") -> DataFrame:
    """Terms ranked by how much they move the ratio together with value."""
    group = list(group)
    df = cut_lineage(df.select(*group, *dict.fromkeys([ratio, value, *terms])))
    rows = attach(df, group_quantiles(df, group, ratio, {"__m": 0.5}), group, "inner")
    pairs = F.array(*[F.struct(F.lit(x).alias("predictor"), c(x).cast("double").alias("x")) for x in terms])
    long = rows.select(*group, (c(ratio) / c("__m") - 1.0).alias("y"), c(value).alias("v"), F.inline(pairs)).where("x IS NOT NULL")
    keys = [*group, "predictor"]
    spans = long.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    stats = attach(long, spans, keys, "inner").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if((c("x") > c("lo")) & (c("x") < c("hi"))).alias("between"),
        F.regr_slope("y", "x").alias("b"), F.stddev_samp("x").alias("sd"), F.corr("x", "v").alias("val_skew"),
    )
    # Three distinct values exist exactly when some value lies strictly between the extremes.
    scored = stats.where((c("n") >= 60) & (c("between") > 0)).withColumn("slope", c("b") * (c("sd") + 1e-9))
    score = F.abs(c("slope")) * (F.abs(c("val_skew")) + 0.05)
    return scored.where(c("slope").isNotNull()).select(
        *group, "predictor", F.round("slope", 4).alias("slope"), F.round("val_skew", 4).alias("val_skew"), F.round(score, 4).alias("score")
    )


def unbiased_moments(x: str) -> tuple[Column, Column]:
    """Sample skewness and excess kurtosis with the small-sample corrections."""
    n = F.count(x)
    g1, g2 = F.skewness(x), F.kurtosis(x)
    skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1.0)) / (n - 2.0))
    kurt = F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0))
    return skew, kurt


def segment_diagnostics(df: DataFrame, group: Sequence[str], ratio: str = "ratio_final", value: str = "v_proxy") -> DataFrame:
    """Fit measures, ratio spread, warning flags and the three largest residuals per segment.

    The rows are written as a table, free of the constraints that a model run's plan has gathered,
    and every part before they are joined: planning time grows far faster than their number.
    """
    group = list(group)
    df = stored(df.select(*group, *dict.fromkeys(["sale_id", "sale_price", "residual", "ratio", ratio, value])), "diagnostics_rows")
    skew, kurt = unbiased_moments("ratio")
    shape = cut_lineage(df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"), skew.alias("skew"), kurt.alias("kurt")))
    marks = metric_quantiles(df, group, {"p10": ("ratio", 0.1), "p50": ("ratio", 0.5), "p90": ("ratio", 0.9)})
    fit = model_fit_stats(df, group, "proxy", ratio, value)
    bias = prb(df, group, "linear", ratio, value=value).select(*group, "prb")
    order = W.partitionBy(*group).orderBy(F.abs(c("residual")).desc(), c("sale_id"))
    worst = df.withColumn("rn", F.row_number().over(order)).where(c("rn") <= 3)
    worst = worst.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct("rn", "sale_id", "sale_price", "residual", c(ratio).alias("ratio")))).alias("outliers")
    )
    out = shape
    for part in (marks, fit, bias, worst):
        out = attach(out, cut_lineage(part.drop("n")), group)
    cod, prd, b, med = F.round("cod", 2), F.round("prd", 3), F.round("prb", 3), F.round("median_ratio", 3)
    flags = F.array_compact(
        F.array(
            F.when(c("rows") < 50, F.lit("Limited sample size")),
            F.when(cod > 15, F.lit("COD above IAAO target")),
            F.when(~prd.between(0.98, 1.03), F.lit("PRD outside target")),
            F.when(F.abs(b) > 0.05, F.lit("PRB drift")),
            F.when((med < 0.9) | (med > 1.1), F.lit("Median ratio off target")),
        )
    )
    return out.select(
        *group, c("rows").alias("n"), cod.alias("cod"), prd.alias("prd"), b.alias("prb"), med.alias("median_ratio"),
        "skew", "kurt", "p10", "p50", "p90", flags.alias("flags"), "outliers",
    )


def _student_tail(t: float, df: float) -> float:
    """Two-sided p-value of Student's t from the regularized incomplete beta function."""
    import math

    if df <= 0 or t != t:
        return float("nan")
    x = df / (df + t * t)
    a, b = df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))

    def fraction(x: float, a: float, b: float) -> float:
        tiny = 1e-300
        cc, d = 1.0, 1.0 - (a + b) * x / (a + 1)
        d = 1.0 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 400):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 + num * d
                d = 1.0 / (d if abs(d) > tiny else tiny)
                cc = 1.0 + num / (cc if abs(cc) > tiny else tiny)
                h *= d * cc
            if abs(d * cc - 1.0) < 1e-14:
                break
        return h

    if x < (a + 1) / (a + b + 2):
        return front * fraction(x, a, b) / a
    return 1.0 - front * fraction(1 - x, b, a) / b


@F.pandas_udf(DoubleType())
def _p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([_student_tail(float(a), float(b)) if a == a else None for a, b in zip(t, df)])


def time_trend(df: DataFrame, group: Sequence[str], ratio: str = "ratio_final", t: str = "t") -> DataFrame:
    """Slope, p-value and R-squared of the ratio on time (more than 3 rows)."""
    y, x = c(ratio), c(t)
    out = df.groupBy(*group).agg(
        F.regr_count(y, x).alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2")
    ).where(c("n") > 3)
    stat = F.when(c("r2") < 1, F.sqrt(c("r2") * (c("n") - 2) / (1 - c("r2"))))
    return out.withColumn("p_value", _p_value(stat, (c("n") - 2).cast("double")))


def chart_sample(df: DataFrame, group: Sequence[str], key: str = "sale_id", limit: int = 5000) -> DataFrame:
    """Repeatable sample per segment: the `limit` rows with the smallest key hashes.

    A segment of n rows is first cut to hashes that leave `limit` rows and six standard
    deviations more, so that no task sorts a whole segment. Should that leave a segment
    short, which chance does once in a billion, its bound is lifted.
    """
    keys = list(group)
    mark = F.pmod(F.conv(F.substring(F.md5(c(key).cast("string")), 1, 12), 16, 10).cast("long"), F.lit(1 << 48)) / float(1 << 48)
    part = F.least(F.lit(1.0), (F.lit(limit) + 6 * math.sqrt(limit) + 36) / c("__n"))
    marked = df.withColumn("__mark", mark)
    sized = attach(marked, df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), keys).withColumn("__part", part)
    left = sized.where(c("__mark") <= c("__part"))
    enough = left.groupBy(*keys).agg((F.count(F.lit(1)) < F.least(F.first("__n"), F.lit(limit))).alias("__short"))
    df = attach(sized, enough, keys).where((c("__mark") <= c("__part")) | c("__short")).select(*df.columns)
    w = W.partitionBy(*group).orderBy(F.md5(c(key).cast("string")), c(key))
    return df.withColumn("__rn", F.row_number().over(w)).where(c("__rn") <= limit).drop("__rn")
