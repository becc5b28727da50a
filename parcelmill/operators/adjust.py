"""Coefficient-based adjustments of comparable prices and price prediction."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv
from parcelmill.functions.measures import currency

c = F.col
TIME_CAP_MONTHS = 60.0
FACTORS = ("area", "lot", "age", "quality", "condition", "garage", "basement", "view")
LABELS = fv.FACTOR_LABELS
STORY_GROUPS = {"size": ("area", "lot"), "quality": ("quality",), "condition": ("condition",), "time": ("time",), "location": ("view",)}


def beta(betas: Column, term: str) -> Column:
    return F.try_element_at(betas, F.lit(term))


def flag(x: Column) -> Column:
    return F.when(x.isNotNull(), F.when(x.cast("double") >= 1, 1.0).otherwise(0.0))


def adj_features(prefix: str) -> Column:
    """Feature struct from columns with a prefix; impossible values become unknown."""

    def col(x: str) -> Column:
        return c(f"{prefix}{x}").cast("double")

    gla = F.when(col("gla") > 0, col("gla"))
    lot = F.when(col("lot_acres") >= 0, col("lot_acres"))
    age = F.when(col("age") >= 0, col("age"))
    return F.struct(
        gla.alias("gla"), F.log(gla).alias("log_area"), lot.alias("lot_acres"), F.log1p(lot).alias("log_lot"), age.alias("age"),
        F.log1p(age).alias("log_age"), col("quality_score").alias("quality_score"), col("condition_score").alias("condition_score"),
        flag(c(f"{prefix}has_garage")).alias("has_garage"), flag(c(f"{prefix}has_basement")).alias("has_basement"),
        flag(c(f"{prefix}is_view")).alias("is_view"), c(f"{prefix}sale_date").cast("date").alias("sale_date"),
    )


_FACTOR_TERM = {
    "area": ("log_area", "log_area", "gla"), "lot": ("log_lot", "log_lot", "lot_acres"), "age": ("log_age", "log_age", "age"),
    "quality": ("quality_score", "quality_score", "quality_score"), "condition": ("condition_score", "condition_score", "condition_score"),
    "garage": ("has_garage", "has_garage", "has_garage"), "basement": ("has_basement", "has_basement", "has_basement"),
    "view": ("is_view", "is_view", "is_view"),
}


def factor_adjustment(b: Column, delta: Column, price: Column) -> Column:
    """Dollar amount of a log-price coefficient over a difference; unknown gives 0."""
    return F.coalesce(price * (F.exp(b * delta) - 1.0), F.lit(0.0))


def time_index(day: Column, anchor: str = fv.ANCHOR_DATE) -> Column:
    return F.datediff(day, F.lit(anchor).cast("date")) / fv.DAYS_PER_MONTH


def time_adjustment(b_t: Column, b_area_time: Column, log_area: Column, months: Column, price: Column, shrink: float = 1.0) -> Column:
    """Trend of a sale price over at most five years, area-time term included when known."""
    capped = F.when(months.isNotNull(), F.greatest(F.least(months, F.lit(TIME_CAP_MONTHS)), F.lit(-TIME_CAP_MONTHS)))
    effective = (b_t + F.coalesce(b_area_time * log_area, F.lit(0.0))) * shrink
    return F.coalesce(F.when(price > 0, price * (F.exp(effective * capped) - 1.0)), F.lit(0.0))


def adjusted_comps(
    pairs: DataFrame, price: str = "subject_pred_price", sale_price: str = "c_sale_price", valuation: str = "valuation_date",
    betas: str = "betas", shrink: float = 1.0,
) -> DataFrame:
    """Per-factor amounts, total and adjusted value of each pair.

    Subject columns start with s_, comparable columns with c_. Pairs whose
    coefficients lack a required term get `missing_terms` and no amounts; pairs
    without a positive sale or subject price are left out.
    """
    rows = pairs.where((c(sale_price) > 0) & (c(price) > 0)).withColumn("__s", adj_features("s_")).withColumn("__c", adj_features("c_"))
    known = F.coalesce(F.map_keys(c(betas)), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*[F.lit(t) for t in sorted(fv.REQUIRED_TERMS)]), known)
    amounts, details = {}, []
    for name, (term, log_field, shown) in _FACTOR_TERM.items():
        amounts[name] = factor_adjustment(beta(c(betas), term), c(f"__s.{log_field}") - c(f"__c.{log_field}"), c(price))
        details.append(F.struct((c(f"__s.{shown}") - c(f"__c.{shown}")).alias("delta"), c(f"__s.{shown}").alias("subject"), c(f"__c.{shown}").alias("comp")).alias(name))
    months = F.datediff(c(valuation), c("__c.sale_date")) / fv.DAYS_PER_MONTH
    amounts["time"] = time_adjustment(
        beta(c(betas), "t"), beta(c(betas), "area_time"), c("__c.log_area"), months, c(sale_price).cast("double"), shrink
    )
    total = sum(amounts.values(), F.lit(0.0))
    ok = F.size("missing_terms") == 0
    out = rows.withColumn("missing_terms", missing).withColumns(
        {f"adj_{k}": F.when(ok, currency(v)) for k, v in amounts.items()}
    )
    return out.withColumns(
        {
            "total_adjustment": F.when(ok, currency(total)),
            "adjusted_value": F.when(ok, currency(c(sale_price) + total)),
            "base_sale_price": currency(c(sale_price)),
            "details": F.struct(*details, F.struct(months.alias("delta")).alias("time")),
        }
    ).drop("__s", "__c")


def property_type_term(x: Column) -> Column:
    """Name of the property-type dummy of a numeric type."""
    number = F.trim(x.cast("string")).try_cast("double")
    whole = F.concat(F.lit("pt_"), number.cast("bigint").cast("string"), F.lit(".0"))
    return F.when(number == F.floor(number), whole).otherwise(F.concat(F.lit("pt_"), number.cast("string")))


def predict_price(df: DataFrame, betas: str = "betas", prefix: str = "", name: str = "predicted_price", anchor: str = fv.ANCHOR_DATE) -> DataFrame:
    """Price from all coefficients of a market group; NULL without coefficients."""
    rows = df.withColumn("__f", adj_features(prefix))
    b = c(betas)

    def add(term: str, value: Column) -> Column:
        return F.coalesce(beta(b, term) * value, F.lit(0.0))

    t = time_index(c("__f.sale_date"), anchor)
    total = F.coalesce(beta(b, "const"), F.lit(0.0))
    for term in ("log_area", "log_lot", "log_age", "has_garage", "has_basement", "is_view"):
        total = total + add(term, c(f"__f.{term}"))
    for term, gone in (("quality_score", "missing_quality"), ("condition_score", "missing_condition")):
        total = total + F.when(c(f"__f.{term}").isNull(), add(gone, F.lit(1.0))).otherwise(add(term, c(f"__f.{term}")))
    total = total + add("t", t) + add("area_time", c("__f.log_area") * t)
    if f"{prefix}property_type" in df.columns:
        total = total + F.coalesce(F.try_element_at(b, property_type_term(c(f"{prefix}property_type"))), F.lit(0.0))
    return rows.withColumn(name, F.when(F.size(F.map_keys(b)) > 0, F.exp(total))).drop("__f")


def valuation_date(explicit: Column, roll_year: Column, as_of: dt.date) -> Column:
    """Explicit date, else January 1 of a sensible roll year, else the given day."""
    year = F.when((roll_year > 1990) & (roll_year < 2100), roll_year)
    return F.coalesce(explicit.cast("date"), F.make_date(year, F.lit(1), F.lit(1)), F.lit(as_of))


def storyboard(adjusted: DataFrame) -> DataFrame:
    """Per subject: mean comparable facts and adjustment totals by story group."""
    facts = ("gla", "lot_acres", "age", "quality_score", "condition_score")
    sums = {k: sum((F.coalesce(c(f"adj_{f}"), F.lit(0.0)) for f in fs), F.lit(0.0)) for k, fs in STORY_GROUPS.items()}
    return adjusted.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("comps"), *[F.avg(c(f"c_{x}").cast("double")).alias(f"avg_{x}") for x in facts],
        *[F.round(F.sum(v), 2).alias(f"total_{k}") for k, v in sums.items()],
    )


def _signed(delta: Column, decimals: int) -> Column:
    text = F.format_number(F.round(F.abs(delta), decimals), decimals)
    return F.when(delta > 0, F.concat(F.lit("+"), text)).when(delta < 0, F.concat(F.lit("-"), text)).otherwise(text)


_UNITS = {"area": ("sqft", 0), "lot": ("acres", 2), "age": ("years", 0), "quality": ("points", 1), "condition": ("points", 1)}


def _numeric_text(key: str) -> Column:
    unit, decimals = _UNITS[key]
    d = c(f"details.{key}")
    lead = f"{LABELS[key]} difference"
    side = F.when(d["delta"] > 0, "Subject higher").otherwise("Comparable higher")
    return (
        F.when(d["delta"].isNull(), F.lit(f"{lead} unavailable."))
        .when(d["delta"] == 0, F.lit(f"{lead}: No difference detected."))
        .otherwise(F.concat(F.lit(f"{lead}: "), _signed(d["delta"], decimals), F.lit(f" {unit} ("), side, F.lit(").")))
    )


def _feature_text(key: str) -> Column:
    label, s, k = LABELS[key], c(f"details.{key}.subject") > 0, c(f"details.{key}.comp") > 0
    return (
        F.when(s.isNull() | k.isNull(), F.lit(f"{label} data unavailable."))
        .when(s & ~k, F.lit(f"{label}: Subject has this feature while the comparable does not."))
        .when(~s & k, F.lit(f"{label}: Comparable has this feature while the subject does not."))
        .when(s, F.lit(f"{label}: Both properties have this feature."))
        .otherwise(F.lit(f"{label}: Neither property has this feature."))
    )


def _time_text() -> Column:
    d = c("details.time.delta")
    lead = "Time difference"
    side = F.when(d > 0, "later than").when(d < 0, "earlier than").otherwise("equal to")
    return F.when(d.isNull(), F.lit(f"{lead} unavailable.")).otherwise(
        F.concat(F.lit(f"{lead}: "), _signed(d, 1), F.lit(" months (valuation date "), side, F.lit(" the sale)."))
    )


def comparison_grid(adjusted: DataFrame) -> DataFrame:
    """Pairs with a labelled list of amounts and difference texts, one entry per factor."""
    entries = []
    for key, label in LABELS.items():
        text = _time_text() if key == "time" else _feature_text(key) if key in ("garage", "basement", "view") else _numeric_text(key)
        entries.append(F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), F.coalesce(c(f"adj_{key}"), F.lit(0.0)).alias("amount"), text.alias("delta_text")))
    return adjusted.withColumn("adjustment_list", F.array(*entries))
