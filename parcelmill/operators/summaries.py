"""Neighborhood profiles, trends and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv
from parcelmill.functions.cleaning import money_int, tax_amount, title_words
from parcelmill.functions.measures import percent_change
from parcelmill.operators.quantiles import group_quantiles, metric_quantiles

c = F.col


def _metric(name: str) -> Column:
    if name == "avg_assessed_value":
        return F.avg("assessed_value")
    if name == "avg_market_value":
        return F.avg("total_market_value")
    if name == "total_assessed_value":
        return F.sum("assessed_value")
    if name == "parcel_count":
        return F.count(F.lit(1)).cast("double")
    raise ValueError(f"unknown metric {name}")


def parcel_summary(df: DataFrame, by: str, metric: str, limit: int = 50) -> DataFrame:
    """The `limit` first groups by one metric, best first (ties by group)."""
    out = df.groupBy(c(by).alias("group_value")).agg(
        _metric(metric).alias("metric_value"), F.count(F.lit(1)).alias("parcel_count")
    )
    return out.orderBy(c("metric_value").desc_nulls_last(), c("group_value")).limit(limit)


def hood_stats(df: DataFrame, now_year: int, group: str = "hood_code") -> DataFrame:
    """Structure, age, size and tax statistics per neighborhood."""
    age = F.lit(now_year) - c("year_built")
    rows = df.withColumn("tax", tax_amount(c("total_taxes")))
    counts = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("parcels"),
        F.min("year_built").alias("min_year"),
        F.max("year_built").alias("max_year"),
        F.count_if(age <= 20).alias("age_0_20"),
        F.count_if(age.between(21, 40)).alias("age_20_40"),
        F.count_if(age.between(41, 60)).alias("age_40_60"),
        F.count_if(age > 60).alias("age_60_plus"),
        *[F.count_if(c("year_built") == now_year - back).alias(f"built_{now_year - back}") for back in (2, 1, 0)],
        F.count("living_area").alias("cnt_sqft"),
        F.count("acres").alias("cnt_acres"),
        F.count("bathrooms").alias("cnt_bath"),
        F.count("bedrooms").alias("cnt_bed"),
        F.count("garage_sqft").alias("cnt_garage"),
        F.count("building_style").alias("cnt_style"),
        F.round(F.count_if(c("basement_sqft") > 0) * 100.0 / F.count(F.lit(1)), 2).alias("pct_basement"),
    )
    middles = metric_quantiles(
        rows,
        [group],
        {
            "med_year": ("year_built", 0.5),
            "med_sqft": ("living_area", 0.5), "sqft_p25": ("living_area", 0.25), "sqft_p75": ("living_area", 0.75),
            "med_acres": ("acres", 0.5), "acres_p25": ("acres", 0.25), "acres_p75": ("acres", 0.75),
            "med_bath": ("bathrooms", 0.5), "med_bed": ("bedrooms", 0.5), "med_garage": ("garage_sqft", 0.5),
            "med_assessed": ("assessed_value", 0.5), "med_tax": ("tax", 0.5),
        },
    )
    return counts.join(middles, group, "left")


def distribution(df: DataFrame, group: str, column: str) -> DataFrame:
    """Count and percent of each value within its group."""
    counts = df.where(c(column).isNotNull()).groupBy(group, column).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(W.partitionBy(group))
    return counts.withColumn("percent", F.round(c("count") * 100.0 / total, 2))


def sales_history(
    sales: DataFrame,
    parcels: DataFrame,
    first_year: int,
    last_year: int,
    group: str = "hood_code",
    deeds: Sequence[str] = ("WARRANTY DEED", "STATUTORY WARRANTY DEED"),
) -> DataFrame:
    """Yearly sale count and medians per neighborhood; years without sales appear with 0."""
    kept = sales.where((c("sale_price") > 0) & (F.year("sale_date") >= first_year) & c("deed_type").isin(*deeds))
    homes = parcels.where(c("living_area") > 0).select("parcel_id", group, "living_area")
    rows = kept.join(homes, "parcel_id").select(
        group, F.year("sale_date").alias("sale_year"), "sale_price", (c("sale_price") / c("living_area")).alias("ppsf")
    )
    keys = [group, "sale_year"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("sales"))
    middles = metric_quantiles(rows, keys, {"median_price": ("sale_price", 0.5), "median_ppsf": ("ppsf", 0.5)})
    spine = counts.select(group).distinct().select(
        group, F.explode(F.sequence(F.lit(first_year), F.lit(last_year))).alias("sale_year")
    )
    full = spine.join(counts, keys, "left").join(middles, keys, "left")
    late = counts.where(c("sale_year") > last_year).join(middles, keys, "left")
    return full.unionByName(late).select(
        *keys, F.coalesce("sales", F.lit(0)).alias("sales"), "median_price", F.round("median_ppsf", 2).alias("median_ppsf")
    )


def share_by(df: DataFrame, group: str, category: str) -> DataFrame:
    """Percent of each category within the group's matched rows."""
    return distribution(df, group, category).select(group, category, "percent")


def group_medians(df: DataFrame, group: str, columns: Sequence[str]) -> DataFrame:
    middles = metric_quantiles(df, [group], {f"median_{x}": (x, 0.5) for x in columns})
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("samples")).join(middles, group, "left")


def hood_profile(
    stats: DataFrame,
    history: DataFrame,
    distributions: dict[str, DataFrame],
    extras: dict[str, DataFrame],
    this_year: int,
    group: str = "hood_code",
    min_sales: int = 10,
) -> DataFrame:
    """One nested profile per neighborhood with enough recorded sales.

    Lists hold one entry per year or per distinct value, never per parcel.
    """
    entry = F.struct("sale_year", "sales", "median_price", "median_ppsf")
    years = history.groupBy(group).agg(
        F.sum("sales").alias("total_sales"),
        F.max(F.when(c("sale_year") == this_year, entry)).alias("now"),
        F.max(F.when(c("sale_year") == this_year - 1, entry)).alias("before"),
        F.sort_array(F.collect_list(entry)).alias("sales_history"),
    )
    out = stats.join(years.where(c("total_sales") >= min_sales), group)
    for name, df in distributions.items():
        value = [x for x in df.columns if x not in (group, "count", "percent")][0]
        items = F.sort_array(F.collect_list(F.struct(c(value).alias("value"), "count", "percent")))
        out = out.join(df.groupBy(group).agg(items.alias(name)), group, "left")
    for name, df in extras.items():
        fields = [x for x in df.columns if x != group]
        out = out.join(df.select(group, F.struct(*fields).alias(name)), group, "left")
    recent = F.when(F.coalesce(c("now.sales"), F.lit(0)) > 0, c("now")).otherwise(c("before"))
    turnover = F.round(F.coalesce(c("before.sales"), F.lit(0)) * 100.0 / c("parcels"), 2)
    rate = F.round(F.when((c("med_assessed") != 0) & (c("med_tax") != 0), c("med_tax") / c("med_assessed") * 100), 2)
    keep = [x for x in out.columns if x not in ("now", "before", group, "total_sales")]
    return out.select(
        group,
        F.struct(
            *keep, turnover.alias("turnover_rate"), rate.alias("effective_tax_rate"),
            F.struct(recent["median_price"].alias("median_price"), recent["median_ppsf"].alias("median_ppsf"),
                     recent["sales"].alias("sales")).alias("sales_summary"),
        ).alias("profile"),
    )


def explode_history(docs: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Yearly records of `array<map<string,string>>` rows, years from 1990 on."""
    rec = docs.select(key, F.explode("rows").alias("r"))

    def field(name: str) -> Column:
        return F.try_element_at(c("r"), F.lit(name))

    year = F.coalesce(F.nullif(field("VALUE YEAR"), F.lit("")), field("TAX YEAR")).try_cast("int")
    return rec.select(
        key, year.alias("value_year"),
        *[money_int(field(n)).alias(a) for n, a in
          (("MARKET TOTAL", "total"), ("LAND MARKET", "land"), ("BUILDING", "building"), ("TAX", "tax"))],
    ).where(c("value_year") >= 1990)


def history_medians(records: DataFrame, group: str = "hood_code") -> DataFrame:
    """Yearly medians per neighborhood; 0 means missing and empty years give 0."""
    keys = [group, "value_year"]
    columns = ("total", "land", "building", "tax")
    cleaned = records.select(*keys, *[F.when(c(x) != 0, c(x)).alias(x) for x in columns])
    middles = metric_quantiles(cleaned, keys, {f"median_{x}": (x, 0.5) for x in columns})
    whole = [F.coalesce(F.floor(f"median_{x}"), F.lit(0)).cast("bigint").alias(f"median_{x}") for x in columns]
    return cleaned.select(*keys).distinct().join(middles, keys, "left").select(*keys, *whole)


def yoy(df: DataFrame, group: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Change in percent against the previous observed year, 2 digits."""
    w = W.partitionBy(group).orderBy(order)
    return df.select("*", *[F.round(percent_change(c(x), F.lag(x).over(w)), 2).alias(f"yoy_{x}") for x in columns])


def stability(df: DataFrame, group: str, change: str) -> DataFrame:
    """Stability score of the group's yearly changes and a flag per year."""
    whole = W.partitionBy(group)
    spread = F.stddev_pop(change).over(whole)
    score = F.when(F.count(change).over(whole) >= 2, F.greatest(F.lit(0.0), 100.0 - spread * 1.5))
    flag = F.when(c(change) > 10, "boom").when(c(change) < -10, "bust").otherwise("steady")
    return df.select("*", score.alias("stability_score"), flag.alias("boom_bust_flag"))


def hood_trends(records: DataFrame, group: str = "hood_code") -> DataFrame:
    medians = history_medians(records, group)
    columns = [x for x in medians.columns if x.startswith("median_")]
    return stability(yoy(medians, group, "value_year", columns), group, "yoy_median_total")


def trend_index(trends: DataFrame, group: str = "hood_code") -> DataFrame:
    return trends.groupBy(group).agg(
        F.min("value_year").alias("first_year"),
        F.max("value_year").alias("last_year"),
        F.count(F.lit(1)).alias("n_years"),
        F.avg("stability_score").alias("avg_stability"),
    )


def trend_series(trends: DataFrame, group: str = "hood_code") -> DataFrame:
    """Ordered yearly series per neighborhood with tax as percent of value."""
    share = F.when(
        (c("median_total") != 0) & (c("median_tax") != 0), F.round(c("median_tax") / c("median_total") * 100, 2)
    )
    point = F.struct("value_year", "median_total", "median_land", "median_tax", "yoy_median_total", share.alias("tax_percent"))
    return trends.groupBy(group).agg(
        F.sort_array(F.collect_list(point)).alias("series"), F.round(F.avg("stability_score"), 1).alias("avg_stability")
    )


def comp_summary(df: DataFrame, group: str, price: str = "sale_price") -> DataFrame:
    """Count, average, median, low and high price per group, in cents precision."""
    money = df.withColumn("__p", c(price).cast("decimal(15,2)"))
    middle = group_quantiles(money, [group], "__p", {"median": 0.5})
    facts = money.groupBy(group).agg(
        F.count("__p").alias("count"), F.bround(F.sum("__p") / F.count("__p"), 2).cast("decimal(15,2)").alias("average"),
        F.min("__p").alias("low"), F.max("__p").alias("high"),
    )
    half_even = F.bround(c("median").cast("decimal(18,4)"), 2).cast("decimal(15,2)")
    return facts.join(middle, group).withColumn("median", half_even)


def scan_codes(df: DataFrame, columns: Sequence[str], limit: int = 100) -> DataFrame:
    """Distinct trimmed values per column: their number and the first `limit` in order."""
    pairs = F.array(*[F.struct(F.lit(x).alias("column"), F.trim(c(x).cast("string")).alias("value")) for x in columns])
    values = df.select(F.inline(pairs)).where(c("value") != "").distinct()
    counts = values.groupBy("column").agg(F.count(F.lit(1)).alias("distinct_count"))
    ranked = values.withColumn("rn", F.row_number().over(W.partitionBy("column").orderBy("value"))).where(c("rn") <= limit)
    samples = ranked.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("sample_values"))
    return counts.join(samples, "column")


def global_metrics(stats: DataFrame, run: str = "run_id") -> DataFrame:
    """Row-weighted means over the segments of a run, pooled error and group list."""
    total = F.sum("n")

    def mean(name: str) -> Column:
        return F.round(F.sum(F.coalesce(c(name), F.lit(0.0)) * c("n")) / total, 3).alias(name)

    return stats.groupBy(run).agg(
        total.alias("total_observations"),
        F.count(F.lit(1)).alias("segments"),
        *[mean(x) for x in ("cod", "prd", "prb", "r2")],
        F.round(F.sqrt(F.sum(F.coalesce("residual_sum_sq", F.lit(0.0))) / total), 4).alias("rmse"),
        F.sort_array(F.collect_set("market_group")).alias("market_groups"),
    )


def driver_group(c_: Column) -> Column:
    out = None
    for name, terms in fv.DRIVER_GROUPS.items():
        out = F.when(c_.isin(*terms), name) if out is None else out.when(c_.isin(*terms), name)
    return out.otherwise("Other")


def driver_rollup(drivers: DataFrame) -> DataFrame:
    """Importance share, majority direction and usual group of each value driver.

    `drivers` has one row per segment and driver: predictor, importance,
    direction (up/down) and group.
    """
    by_group = drivers.groupBy("predictor", "group").agg(F.count("group").alias("n")).groupBy("predictor").agg(
        F.max_by(c("group"), F.struct("n", "group")).alias("group")
    )
    sums = drivers.groupBy("predictor").agg(
        F.sum(F.coalesce("importance", F.lit(0.0))).alias("importance"),
        F.count_if(F.lower("direction") == "up").alias("ups"),
        F.count_if(F.lower("direction") == "down").alias("downs"),
    )
    total = sums.agg(F.sum("importance")).scalar()
    direction = F.when(c("ups") > c("downs"), "lower").when(c("downs") > c("ups"), "higher").otherwise("mixed")
    label = title_words(F.replace(c("group"), F.lit("_"), F.lit(" ")))
    return sums.join(by_group, "predictor").select(
        "predictor",
        direction.alias("direction"),
        F.coalesce(label, F.lit("General")).alias("group_label"),
        F.when(c("importance") > 0, F.round(c("importance") * 100 / total, 1)).alias("importance_pct"),
    )


def quality_score(cod: Column, prd: Column, prb: Column) -> Column:
    """Percent score of run accuracy from whichever of the three measures exist."""

    def clamp(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    parts = F.array_compact(
        F.array(
            clamp(1.0 - F.when(cod > 1, cod / 100.0).otherwise(cod)) + F.when(cod.isNull(), F.lit(None).cast("double")).otherwise(F.lit(0.0)),
            F.when(prd.isNotNull(), clamp(1.0 - F.abs(prd - 1.0))),
            F.when(prb.isNotNull(), clamp(1.0 - F.abs(prb))),
        )
    )
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(parts) > 0, F.round(total / F.size(parts) * 100, 1))


def crawl_totals(df: DataFrame, task: str, outcome: str, cost: Column) -> DataFrame:
    return df.groupBy(task).agg(
        F.count_if(c(outcome) == "success").alias("success_count"),
        F.count_if(c(outcome) == "skip").alias("skip_count"),
        F.count_if(c(outcome) == "error").alias("error_count"),
        F.count(F.lit(1)).alias("api_calls"),
        F.sum(cost).alias("est_cost_usd"),
    )


def median_from_stats(points: DataFrame, array: str, price: str) -> DataFrame:
    """Median over the points of all segments' chart arrays."""
    prices = points.select(F.explode(array).alias("p")).select(c(f"p.{price}").cast("double").alias("v"))
    return group_quantiles(prices, [], "v", {"median_value": 0.5})


def portal_figures(roll: DataFrame, metrics: DataFrame, points: DataFrame, roll_year: int) -> DataFrame:
    """One row: parcel count, market groups, data quality and median price."""
    parcels = roll.where(c("roll_year") == roll_year).agg(F.count(F.lit(1)).alias("total_parcels"))
    scored = metrics.select(
        F.size(F.array_distinct("market_groups")).alias("hood_count"),
        quality_score(c("cod"), c("prd"), c("prb")).alias("data_quality"),
    )
    middle = median_from_stats(points, "chart", "sale_price")
    rows = parcels.unionByName(scored, allowMissingColumns=True).unionByName(middle, allowMissingColumns=True)
    return rows.agg(*[F.max(x).alias(x) for x in rows.columns])
