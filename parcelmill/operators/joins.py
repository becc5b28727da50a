"""Joins between rolls, improvements, land and sales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelmill.functions import codes as cd
from parcelmill.functions import fixed_values as fv
from parcelmill.functions.cleaning import parse_numeric
from parcelmill.functions.measures import percent_change, preferred
from parcelmill.operators.filters import mode_filter, valid_sale

c = F.col
SQFT_PER_ACRE = 43560.0


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the least by `order`, then by all other columns.

    An aggregate, so duplicates collapse before the shuffle.
    """
    rest = [x for x in df.columns if x not in keys]
    best = F.min(F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)], *rest)).alias("__row")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"__row.{x}").alias(x) for x in rest]).select(*df.columns)


def latest_sale(sales: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Newest sale per parcel; unknown dates lose, ties go to the higher sale id."""
    newest = F.max(F.struct("sale_date", "sale_id", "sale_price", "deed_type")).alias("s")
    return sales.groupBy(key).agg(newest).select(
        key, c("s.sale_price").alias("last_sale_price"), c("s.sale_date").alias("last_sale_date"),
        c("s.deed_type").alias("last_deed_type"),
    )


def with_latest_sale(parcels: DataFrame, sales: DataFrame, key: str = "parcel_id") -> DataFrame:
    return parcels.join(latest_sale(sales, key), key, "left")


def latest_valid_sale(sales: DataFrame, key: str = "parcel_id") -> DataFrame:
    return latest_sale(sales.where(valid_sale()), key)


def regression_dataset(
    sales: DataFrame, parcels: DataFrame, mode: str = "sfr", since: str = fv.ANCHOR_DATE, min_price: float = 10000.0
) -> DataFrame:
    """Valid sales joined with the current parcel row: the model input."""
    kept = sales.where((c("sale_type") == "VALID SALE") & (c("sale_price") > min_price) & (c("sale_date") >= F.lit(since)))
    homes = mode_filter(parcels, mode).where((c("living_area") > 0) & (c("acres") > 0))
    area = F.coalesce(cd.first_prefix(c("hood_code"), fv.AREAS_LONG), F.lit("OTHER"))
    return kept.select("sale_id", "parcel_id", "sale_price", "sale_date").join(homes, "parcel_id").select(
        "sale_id",
        "parcel_id",
        "sale_price",
        "sale_date",
        "assessed_value",
        "total_market_value",
        c("living_area").cast("double").alias("living_area"),
        c("acres").cast("double").alias("lot_acres"),
        "year_built",
        "eff_year_built",
        F.coalesce(c("bedrooms"), F.lit(0)).alias("bedrooms"),
        F.coalesce(c("bathrooms"), F.lit(0.0)).cast("double").alias("bathrooms"),
        "quality_score",
        "condition_score",
        c("hood_code").alias("neighborhood_code"),
        "land_use_code",
        c("land_market_value").cast("double").alias("land_market_value"),
        (c("living_area") / F.nullif(c("acres") * SQFT_PER_ACRE, F.lit(0.0))).alias("floor_area_ratio"),
        F.when(c("garage_sqft") > 0, 1).otherwise(0).alias("has_garage"),
        F.when(c("basement_sqft") > 0, 1).otherwise(0).alias("has_basement"),
        cd.is_view(c("hood_code")).alias("is_view"),
        area.alias("valuation_area"),
    )


def build_master(roll: DataFrame, rollup: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Roll rows with their improvement rollup and the unified final columns."""
    joined = roll.join(rollup, key, "left")
    return joined.select(
        "*",
        F.coalesce("total_living_area", "living_area").alias("final_living_area"),
        F.coalesce("year_built_min", "year_built").alias("final_year_built"),
        c("total_garage_area").alias("final_garage_area"),
        F.coalesce("effective_year_built", "eff_year_built").alias("final_eff_year_built"),
    )


def roll_change(rolls: DataFrame, year: int, key: str = "parcel_id") -> DataFrame:
    """Active and prior roll value of each parcel and the change in percent."""
    value = preferred(c("total_market_value"), c("assessed_value"))
    active = rolls.where(c("roll_year") == year).select(key, value.alias("active_value"))
    prior = rolls.where(c("roll_year") == year - 1).select(key, value.alias("prior_value"))
    return active.join(prior, key, "left").withColumn("change_pct", percent_change(c("active_value"), c("prior_value")))


def fallback_fill(
    parcels: DataFrame, improvements: DataFrame, years: Sequence[int], key: str = "parcel_id"
) -> DataFrame:
    """Fill missing bed and bath counts from the first year that has improvement rows.

    Only parcels where both are missing are looked up; the lowest detail id of
    the chosen year supplies the texts.
    """
    rank = F.when(c("roll_year") == years[0], 0)
    for i, year in enumerate(years[1:], 1):
        rank = rank.when(c("roll_year") == year, i)
    first = (
        improvements.where(c("roll_year").isin(*years))
        .groupBy(key)
        .agg(F.min(F.struct(rank.alias("r"), "detail_id", "bedrooms_text", "plumbing_text", "rooms_text")).alias("i"))
        .select(
            key,
            F.nullif(parse_numeric(c("i.bedrooms_text")), F.lit(0.0)).alias("found_beds"),
            F.coalesce(
                F.nullif(parse_numeric(c("i.plumbing_text")), F.lit(0.0)),
                F.nullif(parse_numeric(c("i.rooms_text")), F.lit(0.0)),
            ).alias("found_baths"),
        )
    )
    missing = c("bedrooms").isNull() & c("bathrooms").isNull()
    joined = parcels.join(first, key, "left")
    return joined.select(
        *[x for x in parcels.columns if x not in ("bedrooms", "bathrooms")],
        F.when(missing, c("found_beds")).otherwise(c("bedrooms")).alias("bedrooms"),
        F.when(missing, c("found_baths")).otherwise(c("bathrooms")).alias("bathrooms"),
        (missing & F.coalesce(c("found_beds"), c("found_baths")).isNotNull()).alias("filled"),
    )


def backfill_acres(parcels: DataFrame, land: DataFrame, only_missing: bool = False, key: str = "parcel_id") -> DataFrame:
    """Acres from land totals (square feet as a fallback) where they differ."""
    totals = land.groupBy(key).agg(F.sum("size_acres").alias("a"), F.sum("size_sqft").alias("s"))
    acres = F.when(F.coalesce(c("a"), F.lit(0.0)) != 0, c("a")).otherwise(c("s") / SQFT_PER_ACRE)
    found = totals.select(key, acres.alias("new_acres")).where(c("new_acres") > 0)
    joined = parcels.join(found, key, "left")
    change = c("new_acres").isNotNull() & (c("acres").isNull() | (F.abs(c("acres") - c("new_acres")) >= 1e-4))
    if only_missing:
        change = change & (c("acres").isNull() | (c("acres") <= 0))
    return joined.withColumn("acres_updated", change).withColumn(
        "acres", F.when(change, c("new_acres")).otherwise(c("acres"))
    ).drop("new_acres")


def lookup_zoning(facts: DataFrame, rules: DataFrame) -> DataFrame:
    """Rule id by zone code and jurisdiction, ignoring case."""
    keyed = rules.select(
        F.lower("zone_code").alias("__z"), F.lower("jurisdiction").alias("__j"), c("rule_id")
    )
    on = (F.lower(facts["zone_code"]) == c("__z")) & (F.lower(facts["jurisdiction"]) == c("__j"))
    return facts.join(keyed, on, "left").drop("__z", "__j")


def with_rows_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_semi")


def without_rows_in(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key), key, "left_anti")


def history_with_hood(history: DataFrame, parcels: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Yearly records with the parcel's neighborhood; unmatched or blank hoods drop out."""
    hoods = parcels.where(F.trim(c("hood_code")) != "").select(key, F.trim("hood_code").alias("hood_code"))
    return history.join(hoods, key)


def latest_run(coefficients: DataFrame, group: str = "market_group") -> DataFrame:
    """Run with the newest creation time per market group (ties to the higher run id)."""
    return coefficients.groupBy(group).agg(F.max(F.struct("created_at", "run_id")).alias("r")).select(
        group, c("r.run_id").alias("run_id")
    )


def coefficient_sets(
    coefficients: DataFrame, run_id: str | None = None, include_all: bool = False, group: str = "market_group"
) -> DataFrame:
    """Term -> beta map of one run per market group.

    A model has a few dozen terms, so each map stays small.
    """
    if run_id is None:
        rows = coefficients.join(latest_run(coefficients, group), [group, "run_id"])
    else:
        rows = coefficients.where(c("run_id") == run_id)
    if not include_all:
        rows = rows.where(~c("term").isin(*fv.IGNORED_TERMS) & ~c("term").startswith("pt_"))
    one = rows.groupBy(group, "run_id", "term").agg(F.max("beta").alias("beta"))
    pairs = F.sort_array(F.collect_list(F.struct("term", "beta")))
    return one.groupBy(group, "run_id").agg(F.map_from_entries(pairs).alias("betas"))


def subject_snapshot(rolls: DataFrame, sales: DataFrame, year: int | None = None, key: str = "parcel_id") -> DataFrame:
    """Roll row per parcel (the requested year, else the newest) with its latest valid sale."""
    rows = rolls if year is None else rolls.where(c("roll_year") == year)
    newest = F.max(F.struct("roll_year", "roll_id", "assessed_value", "total_market_value")).alias("r")
    picked = rows.groupBy(key).agg(newest).select(key, "r.*")
    value = preferred(c("total_market_value"), c("assessed_value"))
    return picked.withColumn("value", value).join(latest_valid_sale(sales, key), key, "left")


def latest_roll(rolls: DataFrame, key: str = "parcel_id") -> DataFrame:
    """Newest roll row per parcel; unknown years last, then the higher id."""
    order = W.partitionBy(key).orderBy(c("roll_year").desc_nulls_last(), c("roll_id").desc())
    return rolls.withColumn("__rn", F.row_number().over(order)).where(c("__rn") == 1).drop("__rn")
