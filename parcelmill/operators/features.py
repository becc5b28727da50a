"""Model features, interactions, trims, bins and tiers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv
from parcelmill.operators.quantiles import attach, group_quantiles, metric_quantiles
from parcelmill.session import cut_lineage

c = F.col


def _floor0(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def months_since(date: Column, anchor: str = fv.ANCHOR_DATE) -> Column:
    return F.datediff(date.cast("date"), F.lit(anchor).cast("date")) / fv.DAYS_PER_MONTH


def with_age(df: DataFrame, reference_year: int = fv.REFERENCE_YEAR) -> DataFrame:
    if "age" not in df.columns:
        df = df.withColumn("age", F.lit(reference_year) - c("year_built"))
    return df.withColumn("age", F.when(c("age").isNotNull(), F.greatest(c("age"), F.lit(0))).cast("double"))


def features(df: DataFrame, anchor: str = fv.ANCHOR_DATE, reference_year: int = fv.REFERENCE_YEAR) -> DataFrame:
    """All model terms of the sales dataset.

    Global means and medians come from one small row read as a scalar subquery.
    """
    rows = with_age(df, reference_year).where(
        c("sale_price").isNotNull() & c("living_area").isNotNull() & c("age").isNotNull() & c("sale_date").isNotNull()
    )
    log_area = F.log(F.greatest(c("living_area"), F.lit(1.0)))
    t = months_since(c("sale_date"), anchor)
    means = rows.agg(
        F.avg(log_area).alias("mean_log_area"), F.avg(t).alias("mean_t"),
        # Scores take a handful of values, so their exact medians need only tiny maps.
        F.percentile("quality_score", 0.5).alias("med_quality"), F.percentile("condition_score", 0.5).alias("med_condition"),
    )
    for name in ("elev", "slope", "aspect", "dist_major_road"):
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
    rows = attach(rows, means, [])
    base = rows.select(
        "*",
        log_area.alias("log_area"),
        F.log1p(_floor0(c("lot_acres"))).alias("log_lot"),
        F.log1p(c("age")).alias("log_age"),
        F.log1p(_floor0(c("floor_area_ratio"))).alias("log_far"),
        F.coalesce((F.lit(reference_year) - c("eff_year_built")).cast("double"), c("age")).alias("eff_age"),
        ((c("bathrooms") + 0.5) / F.greatest(c("bedrooms"), F.lit(1))).alias("baths_per_bed"),
        t.alias("t"),
        F.log1p(_floor0(c("land_market_value"))).alias("log_land_value"),
        F.log1p(_floor0(c("total_market_value"))).alias("log_total_mv"),
        F.coalesce(
            F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(c("land_market_value"), F.nullif(c("total_market_value"), F.lit(0.0))))),
            F.lit(0.0),
        ).alias("land_share_raw"),
        c("quality_score").isNull().cast("int").alias("missing_quality"),
        c("condition_score").isNull().cast("int").alias("missing_condition"),
    )
    land_share = F.when(c("total_market_value").isNull() | (c("total_market_value") == 0), F.lit(0.0)).otherwise(c("land_share_raw"))
    base = base.withColumns(
        {
            "log_area_sq": F.pow(c("log_area") - c("mean_log_area"), 2),
            "log_eff_age": F.log1p(_floor0(c("eff_age"))),
            "t_sq": F.pow(c("t") - c("mean_t"), 2),
            "land_share": land_share,
            "quality_score": F.coalesce(c("quality_score").cast("double"), c("med_quality")),
            "condition_score": F.coalesce(c("condition_score").cast("double"), c("med_condition")),
            "is_view": F.coalesce(c("is_view"), F.lit(0)),
            "elev": F.coalesce(c("elev"), F.lit(0.0)),
            "slope_pct": F.coalesce(c("slope"), F.lit(0.0)),
            "dist_major_road": F.coalesce(c("dist_major_road"), F.lit(0.0)),
            "log_price": F.log("sale_price"),
        }
    ).drop("mean_log_area", "mean_t", "med_quality", "med_condition", "land_share_raw")
    base = base.withColumns({"log_elev": F.log1p("elev"), "log_major_road": F.log1p("dist_major_road"), "log_total_mv_sq": F.pow("log_total_mv", F.lit(2))})
    west = F.coalesce(c("aspect").between(225, 315).cast("int"), F.lit(0))
    return base.withColumns(
        {
            "view_elev": c("is_view") * c("log_elev"),
            "view_level": (c("is_view") == 1).cast("int") + west,
            "land_time": c("land_share") * c("t"),
            "area_time": c("log_area") * c("t"),
            "value_time": c("log_total_mv") * c("t"),
            "age_quality": c("log_age") * c("quality_score"),
            "area_lot": c("log_area") * c("log_lot"),
            "area_quality": c("log_area") * c("quality_score"),
            "area_condition": c("log_area") * c("condition_score"),
            "area_elev": c("log_area") * c("log_elev"),
            "slope_area": c("slope_pct") * c("log_area"),
            "t_mv": c("t") * c("log_total_mv"),
            "t_sq_mv": c("t_sq") * c("log_total_mv"),
        }
    )


def geo_features(df: DataFrame) -> DataFrame:
    """Terrain, flood, road and shape terms; absent columns count as unknown."""
    for name in ("elevation", "slope", "aspect", "flood_distance", "dist_floodway", "dist_major_road", "parcel_compactness", "floor_area_ratio"):
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast("double"))
    zero = {x: F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in ("elevation", "slope", "aspect")}
    df = df.withColumns(zero)
    return df.withColumns(
        {
            "elev_log": F.log1p(_floor0(c("elevation"))),
            "slope_log": F.log1p(_floor0(c("slope"))),
            "slope_sq": c("slope") * c("slope"),
            "aspect_sin": F.sin(F.radians("aspect")),
            "aspect_cos": F.cos(F.radians("aspect")),
            "flood_distance_log": F.log1p(_floor0(c("flood_distance"))),
            "dist_floodway_log": F.log1p(_floor0(c("dist_floodway"))),
            "dist_major_road_log": F.log1p(_floor0(c("dist_major_road"))),
            "compactness_log": F.log1p(_floor0(c("parcel_compactness"))),
            "far": F.coalesce("floor_area_ratio", F.lit(0.0)),
        }
    )


def interactions(df: DataFrame, names: Sequence[str], terms: Mapping[str, Sequence[str]] = fv.INTERACTION_TERMS) -> tuple[DataFrame, dict]:
    """Products of columns by name, with what was created and what was skipped and why."""
    created: list[str] = []
    skipped: list[tuple[str, str]] = []
    for name in names:
        parts = terms.get(name)
        if not parts:
            skipped.append((name, "not_configured"))
            continue
        missing = [p for p in parts if p not in df.columns]
        if missing:
            skipped.append((name, "missing: " + ", ".join(missing)))
            continue
        df = df.withColumn(name, reduce(lambda a, b: a * b, [c(p).cast("double") for p in parts]))
        created.append(name)
    return df, {"created": created, "skipped": skipped}


def term_report(df: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Per term: share of rows that have it, number of distinct values and variance, from one pass."""
    count = F.count(F.lit(1)).cast("double")
    facts = [
        F.struct(F.lit(x).alias("term"), (F.count(c(x)) / count).alias("present"), F.countDistinct(c(x)).alias("distinct_values"), F.var_samp(c(x).cast("double")).alias("variance"))
        for x in terms
    ]
    return df.agg(F.array(*facts).alias("facts")).select(F.inline("facts"))


def predictors(columns: Sequence[str], profile: str = "baseline", bundle: str | None = "standard") -> dict[str, list[str]]:
    """Forced and candidate terms of a profile, without repeats; absent ones are reported."""
    if profile not in fv.PROFILE_EXTRAS:
        profile = "baseline"
    core = list(dict.fromkeys(fv.CORE_TERMS))
    extra = fv.INTERACTION_BUNDLES.get(bundle or "", ())
    pool = list(dict.fromkeys([*fv.CANDIDATE_TERMS, *fv.PROFILE_EXTRAS[profile], *extra]))
    return {
        "core": [x for x in core if x in columns],
        "candidates": [x for x in pool if x in columns and x not in core],
        "missing": [x for x in [*core, *pool] if x not in columns],
    }


def trim(df: DataFrame, group: Sequence[str], bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows whose columns lie between their group's quantiles (inclusive)."""
    group = list(group)
    wanted = {}
    for x, (lo, hi) in bounds.items():
        wanted[f"__lo_{x}"] = (x, lo)
        wanted[f"__hi_{x}"] = (x, hi)
    marked = attach(df, cut_lineage(metric_quantiles(df, group, wanted)), group, "inner")
    inside = [c(x).between(c(f"__lo_{x}"), c(f"__hi_{x}")) for x in bounds]
    return marked.where(reduce(lambda a, b: a & b, inside)).drop(*wanted)


def tier_trim(df: DataFrame, group: Sequence[str], tier: str = "value_tier") -> DataFrame:
    """Price and area trim with the bounds of each row's tier."""
    group = [*group, tier]
    probs = sorted({p for rule in fv.TIER_TRIMS.values() for pair in rule.values() for p in pair})
    wanted = {f"__{x}{i}": (col, p) for x, col in (("p", "sale_price"), ("a", "living_area")) for i, p in enumerate(probs)}
    marked = attach(df, cut_lineage(metric_quantiles(df, group, wanted)), group, "inner")

    def bound(x: str, rule: str, side: int) -> Column:
        out = None
        for name, trims in fv.TIER_TRIMS.items():
            value = c(f"__{x}{probs.index(trims[rule][side])}")
            out = F.when(c(tier) == name, value) if out is None else out.when(c(tier) == name, value)
        return out.otherwise(c(f"__{x}{probs.index(fv.TIER_TRIMS['ALL'][rule][side])}"))

    keep = c("sale_price").between(bound("p", "price", 0), bound("p", "price", 1)) & c("living_area").between(
        bound("a", "area", 0), bound("a", "area", 1)
    )
    return marked.where(keep).drop(*wanted)


def qcut(df: DataFrame, column: str, probs: Sequence[float], group: Sequence[str] = (), name: str = "bin") -> DataFrame:
    """Right-closed quantile bins per group; repeated edges are dropped."""
    group = list(group)
    inner = {f"__e{i}": p for i, p in enumerate(probs)}
    edges = cut_lineage(group_quantiles(df, group, column, inner))
    packed = edges.select(*group, F.array_distinct(F.array(*inner)).alias("__edges"))
    marked = attach(df, packed, group)
    inside = F.slice(c("__edges"), F.lit(2), F.greatest(F.size("__edges") - 2, F.lit(0)))
    index = F.size(F.filter(inside, lambda e: e < c(column).cast("double")))
    return marked.withColumn(name, F.when(c(column).isNotNull() & c("__edges").isNotNull(), index)).drop("__edges")


def price_tier_dummies(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Five price tiers as 0/1 columns, the first left out."""
    cut = qcut(df, "sale_price", [0, 0.2, 0.4, 0.6, 0.8, 1.0], group, "price_tier")
    return cut.withColumns({f"pt_{k}.0": (c("price_tier") == k).cast("double") for k in (1, 2, 3, 4)})


def quick_tiers(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """LOW / MID / HIGH by price thirds within the group."""
    cut = qcut(df, "sale_price", [0, 0.33, 0.66, 1.0], group, "__t")
    return cut.withColumn("value_tier", F.element_at(F.array(*[F.lit(x) for x in ("LOW", "MID", "HIGH")]), c("__t") + 1)).drop("__t")


def tier_terms(df: DataFrame, terms: Sequence[str], tiers: Sequence[str] = ("T1", "T2", "T3"), tier: str = "value_tier") -> tuple[DataFrame, dict[str, list[str]]]:
    """Slope terms per tier: `<term>_Tk` equals the term inside tier k.

    Returns the rows and, per tier name, the forced terms with the base term replaced.
    """
    names = {"T1": "T1_LOW", "T2": "T2_MID", "T3": "T3_HIGH"}
    new = {}
    plans = {"ALL": list(terms)}
    for k in tiers:
        forced = list(terms)
        for x in fv.TIER_SLOPE_TERMS:
            if x in df.columns:
                new[f"{x}_{k}"] = F.when(c(tier) == names[k], c(x)).otherwise(F.lit(0.0)).cast("double")
                if x in forced:
                    forced.remove(x)
                forced.append(f"{x}_{k}")
        plans[names[k]] = forced
    return df.withColumns(new), plans
