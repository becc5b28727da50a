"""Ratio studies: level, uniformity and price-related measures per group.

Rows are reduced to distinct (group, ratio) lines with counts and sums before any
statistic, so a group that owns a large part of the sales stays spread out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.operators.quantiles import attach, group_quantiles, metric_quantiles
from parcelmill.session import cut_lineage

c = F.col


def reliability(n: Column) -> Column:
    return F.when(n >= 30, "High").when(n >= 10, "Moderate").otherwise("Low")


def ratio_study(
    df: DataFrame, group: str, value: str = "assessed_value", price: str = "sale_price", min_n: int = 5,
    low: float = 0.25, high: float = 2.5,
) -> DataFrame:
    """Mean, median, COD and PRD of value / price per group, with sample size and reliability."""
    rows = df.where((c(price) > 0) & (c(value) > 0)).select(
        group, (c(value) / c(price)).alias("r"), c(value).alias("v"), c(price).alias("p")
    ).where(c("r").between(low, high))
    lines = rows.groupBy(group, "r").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.sum("p").alias("p"))
    middle = group_quantiles(lines, [group], "r", {"med": 0.5}, weight="n")
    stats = attach(lines, middle, [group], "inner").groupBy(group).agg(
        F.sum("n").alias("sample_size"),
        (F.sum(c("r") * c("n")) / F.sum("n")).alias("mean_ratio"),
        F.max("med").alias("median_ratio"),
        (F.sum(F.abs(c("r") - c("med")) * c("n")) / F.sum("n")).alias("dev"),
        (F.sum("v") / F.sum("p")).alias("weighted"),
    )
    return stats.where(c("sample_size") >= min_n).select(
        group,
        (c("mean_ratio") * 100).alias("sales_ratio"),
        "median_ratio",
        (c("dev") / c("median_ratio") * 100).alias("cod"),
        (c("mean_ratio") / c("weighted")).alias("prd"),
        "sample_size",
        reliability(c("sample_size")).alias("reliability"),
    )


def prb(
    df: DataFrame, group: Sequence[str], kind: str = "sales", ratio: str = "ratio", price: str = "sale_price", value: str = "v_proxy"
) -> DataFrame:
    """Price-related bias per group: slope of the ratio on relative value.

    sales: log2 of price, 10-90 % price window (12 samples, 6 inside).
    linear: relative value deviation, 10-90 % value window.
    log2: log2 of value, 5-95 % window and ratios within 0.5-2 (more than 30 rows).
    cuberoot: cube root of the value, no window (50 rows).
    """
    group = list(group)
    x = price if kind == "sales" else value
    rows = cut_lineage(df.where((c(ratio) > 0) & (c(x) > 0)).select(*group, c(ratio).alias("r"), c(x).cast("double").alias("x")))
    if kind == "sales":
        wanted = {"mr": ("r", 0.5), "mx": ("x", 0.5), "lo": ("x", 0.1), "hi": ("x", 0.9)}
        marked = attach(rows, metric_quantiles(rows, group, wanted), group, "inner")
        inside = c("x").between(c("lo"), c("hi"))
        out = marked.groupBy(*group).agg(
            F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("n_used"),
            F.regr_slope(F.when(inside, c("r") / c("mr") - 1), F.when(inside, F.log2(c("x") / c("mx")))).alias("slope"),
        )
        return out.select(*group, F.when((c("n") >= 12) & (c("n_used") >= 6), F.round("slope", 3)).alias("prb"), "n", "n_used")
    if kind == "linear":
        wanted = {"mr": ("r", 0.5), "mx": ("x", 0.5), "lo": ("x", 0.1), "hi": ("x", 0.9)}
        marked = attach(rows, cut_lineage(metric_quantiles(rows, group, wanted)), group, "inner").where(c("x").between(c("lo"), c("hi")))
        out = marked.groupBy(*group).agg(F.regr_slope(c("r") / c("mr") - 1, c("x") / c("mx") - 1).alias("prb"), F.count(F.lit(1)).alias("n_used"))
        return out.select(*group, "prb", "n_used")
    if kind == "log2":
        wanted = {"mr": ("r", 0.5), "lo": ("x", 0.05), "hi": ("x", 0.95)}
        marked = attach(rows, metric_quantiles(rows, group, wanted), group, "inner")
        kept = cut_lineage(marked.where(c("x").between(c("lo"), c("hi")) & c("r").between(0.5, 2.0)))
        centered = attach(kept, group_quantiles(kept, group, "x", {"mx": 0.5}), group, "inner")
        out = centered.groupBy(*group).agg(
            F.regr_slope((c("r") - c("mr")) / c("mr"), F.log2(c("x") / c("mx"))).alias("slope"), F.count(F.lit(1)).alias("n_used")
        )
        return out.select(*group, F.when(c("n_used") > 30, c("slope")).alias("prb"), "n_used")
    if kind == "cuberoot":
        rows = rows.withColumn("x", F.cbrt("x"))
        marked = attach(rows, metric_quantiles(rows, group, {"mr": ("r", 0.5), "mx": ("x", 0.5)}), group, "inner")
        out = marked.groupBy(*group).agg(
            F.regr_slope(c("r") - c("mr"), c("x") - c("mx")).alias("slope"), F.count(F.lit(1)).alias("n_used"), F.stddev_samp("x").alias("sd")
        )
        return out.select(*group, F.when((c("n_used") >= 50) & (c("sd") >= 1e-9), c("slope")).alias("prb"), "n_used")
    raise ValueError(f"unknown kind {kind}")


def model_fit_stats(df: DataFrame, group: Sequence[str], kind: str = "proxy", ratio: str = "ratio", value: str = "v_proxy") -> DataFrame:
    """COD from the median deviation and PRD as upper-half over lower-half mean ratio.

    proxy: halves by value order (equal values share their mean ratio);
    ratio: halves below and from the median ratio.
    """
    group = list(group)
    columns = [*group, "r", *(["x"] if kind == "proxy" else [])]
    rows = df.where(c(ratio).isNotNull()).select(*group, c(ratio).alias("r"), *([c(value).alias("x")] if kind == "proxy" else []))
    # The reduced lines are written once; every later pass reads them. So are quantiles, as plans that join several take long to plan.
    lines = cut_lineage(rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("k")))
    if kind == "ratio":
        middle = cut_lineage(group_quantiles(lines, group, "r", {"med": 0.5}, weight="k"))
    else:
        # Value at position n/2 (from 0) bounds the lower half.
        edge = cut_lineage(group_quantiles(lines, group, "x", {"edge": 0.5}, weight="k", discrete=True))
        middle = cut_lineage(group_quantiles(lines, group, "r", {"med": 0.5}, weight="k"))
        middle = cut_lineage(attach(middle, edge, group, "inner"))
    marked = attach(lines, middle, group, "inner").withColumn("dev", F.abs(c("r") - c("med")) / c("med"))
    spread = cut_lineage(group_quantiles(marked, group, "dev", {"mad": 0.5}, weight="k"))
    if kind == "ratio":
        upper, lower = c("r") >= c("med"), c("r") < c("med")

        def mean(side: Column) -> Column:
            return F.sum(F.when(side, c("r") * c("k"))) / F.sum(F.when(side, c("k")))

        halves = marked.groupBy(*group).agg(
            F.max("med").alias("median_ratio"), F.sum("k").alias("n"), (mean(upper) / mean(lower)).alias("prd")
        )
    else:
        below, at = c("x") < c("edge"), c("x") == c("edge")
        weighted = c("r") * c("k")
        sums = marked.groupBy(*group).agg(
            F.sum("k").alias("n"), F.max("med").alias("median_ratio"),
            F.coalesce(F.sum(F.when(below, c("k"))), F.lit(0)).alias("kb"), F.coalesce(F.sum(F.when(below, weighted)), F.lit(0.0)).alias("sb"),
            F.sum(F.when(at, c("k"))).alias("ka"), F.sum(F.when(at, weighted)).alias("sa"), F.sum(weighted).alias("st"),
        )
        half = F.floor(c("n") / 2)
        low_sum = c("sb") + (half - c("kb")) * c("sa") / c("ka")
        halves = sums.select(
            *group, "median_ratio", "n", (((c("st") - low_sum) / (c("n") - half)) / (low_sum / half)).alias("prd")
        )
    return attach(halves, spread, group, "inner").select(*group, "n", "median_ratio", (c("mad") * 100).alias("cod"), "prd")


def iaao_stats(df: DataFrame, group: Sequence[str], ratio: str = "ratio", price: str = "sale_price") -> DataFrame:
    """Standard COD and PRD of the inverted (value / price) ratio of modeled values."""
    group = list(group)
    rows = df.where(c(ratio) > 0).select(*group, (1.0 / c(ratio)).alias("r"), c(price).alias("p"))
    marked = attach(rows, group_quantiles(rows, group, "r", {"med": 0.5}), group, "inner")
    out = marked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.max("med").alias("median_ratio"), F.avg(F.abs(c("r") - c("med"))).alias("dev"),
        (F.avg("r") / (F.sum(c("r") * c("p")) / F.sum("p"))).alias("prd"),
    )
    return out.select(*group, "n", "median_ratio", (c("dev") / c("median_ratio") * 100).alias("cod"), "prd")


def clipped_fit(df: DataFrame, group: Sequence[str], value: str, prediction: str) -> DataFrame:
    """COD (mean deviation) and half-mean PRD of value / prediction held to 0.1-5."""
    group = list(group)
    r = F.greatest(F.lit(0.1), F.least(F.lit(5.0), c(value) / c(prediction)))
    rows = df.where((c(value) / c(prediction)).isNotNull()).select(*group, r.alias("r"))
    marked = attach(rows, group_quantiles(rows, group, "r", {"med": 0.5}), group, "inner")
    out = marked.groupBy(*group).agg(
        F.max("med").alias("median_ratio"), (F.avg(F.abs(c("r") - c("med")) / c("med")) * 100).alias("cod"),
        (F.avg(F.when(c("r") >= c("med"), c("r"))) / F.avg(F.when(c("r") < c("med"), c("r")))).alias("prd"),
    )
    return out
