"""Ordered work per key: dedup, deltas, cadence, newest-n and ranked lists."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelmill.functions.cleaning import accounting_amount
from parcelmill.functions import fixed_values as fv
from parcelmill.operators.filters import is_residential

c = F.col
SORT_FIELDS = {
    "recent": ("sale_date", "desc"),
    "sale_price": ("sale_price", "desc"),
    "neighborhood": ("hood_code", "asc"),
    "assessed_value": ("assessed_value", "desc"),
    "market_value": ("total_market_value", "desc"),
    "acres": ("acres", "desc"),
    "year_built": ("year_built", "desc"),
}


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """First `n` rows per key; Spark trims each map task to `n` rows before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(c("__rn") <= n).drop("__rn")


def dedupe_master(df: DataFrame, key: str = "parcel_id") -> DataFrame:
    """One row per parcel: residential first, then with area, value and year."""
    has_area = F.coalesce(F.greatest("final_living_area", "total_living_area", "living_area"), F.lit(0.0)) > 0
    order = [
        F.coalesce(c("proptype") == "R", F.lit(False)).desc(),
        has_area.desc(),
        F.coalesce(c("total_market_value"), F.lit(-1.0)).desc(),
        F.coalesce(c("final_year_built"), F.lit(-1)).desc(),
        c("row_id"),
    ]
    return first_by(df, [key], order)


def dedupe_land(df: DataFrame) -> DataFrame:
    order = [c("value_year").desc_nulls_last(), c("market_value").desc_nulls_last(), c("land_segment_id"), c("size_sqft"), c("size_acres")]
    return first_by(df, ["parcel_id", "land_segment_id", "value_year", "land_type"], order)


def dedupe_improvements_by_id(df: DataFrame) -> DataFrame:
    order = [c("eff_year_built").desc_nulls_last(), c("year_built").desc_nulls_last(), c("detail_id"), c("value").desc_nulls_last()]
    return first_by(df, ["parcel_id", "improvement_id"], order)


def dedupe_sales(df: DataFrame) -> DataFrame:
    return first_by(df, ["parcel_id", "sale_price", "sale_date", "recording_number"], [c("sale_id").desc_nulls_last()])


def snapshot_delta(df: DataFrame, key: str = "hood_code", order: str = "metric_year") -> DataFrame:
    """Metrics beside those of the prior observed year."""
    w = W.partitionBy(key).orderBy(order)
    prior = {x: F.lag(x).over(w) for x in ("sales_ratio", "cod", "prd")}
    return df.select(
        "*", *[v.alias(f"prior_{k}") for k, v in prior.items()], (c("sales_ratio") - prior["sales_ratio"]).alias("sales_ratio_delta")
    )


def review_cadence(reviews: DataFrame, key: str = "place_id", when: str = "created_at", last: int = 15) -> DataFrame:
    """Mean gap in days between the newest reviews of a place, at least 1.

    Gaps between neighbors add up to the span, so no pairwise step is needed.
    """
    newest = first_by(reviews.select(key, when, "review_id"), [key], [c(when).desc(), c("review_id").desc()], last)
    span = (F.unix_micros(F.max(when).cast("timestamp")) - F.unix_micros(F.min(when).cast("timestamp"))) / 86400e6
    out = newest.groupBy(key).agg(F.count(F.lit(1)).alias("recent"), span.alias("__span"))
    gap = F.when(c("recent") >= 2, F.greatest(c("__span") / (c("recent") - 1), F.lit(1.0)))
    return out.select(key, "recent", gap.alias("avg_gap_days"))


def value_history(docs: DataFrame, newest: int = 24, key: str = "parcel_id") -> DataFrame:
    """Yearly value per parcel: first readable amount of four keys, newest years."""
    rec = docs.select(key, F.posexplode("rows").alias("pos", "r"))
    year = F.coalesce(F.nullif(F.try_element_at("r", F.lit("VALUE YEAR")), F.lit("")), F.try_element_at("r", F.lit("TAX YEAR")))
    value = F.coalesce(*[accounting_amount(F.try_element_at("r", F.lit(k))) for k in fv.HISTORY_VALUE_KEYS])
    rows = rec.select(key, "pos", year.try_cast("int").alias("year"), value.alias("value")).where("year IS NOT NULL AND value IS NOT NULL")
    return first_by(rows, [key], [c("year").desc(), c("pos").desc()], newest).drop("pos")


def ratio_history(metrics: DataFrame, newest: int = 10, key: str = "hood_code", order: str = "metric_year") -> DataFrame:
    return first_by(metrics.withColumn(key, F.upper(F.trim(c(key)))), [key], [c(order).desc()], newest)


def sales_list(df: DataFrame, sort: str = "recent", direction: str | None = None, limit: int = 25) -> DataFrame:
    """Sales ordered by one of the known keys, unknown values last, newer sale id first."""
    if sort not in SORT_FIELDS:
        raise ValueError(f"unsupported sort {sort}")
    column, default = SORT_FIELDS[sort]
    way = (direction or default).lower()
    order = c(column).asc_nulls_last() if way == "asc" else c(column).desc_nulls_last()
    return df.orderBy(order, c("sale_id").desc_nulls_last()).limit(limit)


def parcel_search(df: DataFrame, page: int = 1, size: int = 25, key: str = "parcel_id") -> DataFrame:
    """One page of parcels by assessed value, highest first.

    Page numbers need all rows before the page in one place; for deep pages use `indexed_page`,
    to walk through many pages `parcel_search_after`.
    """
    return df.orderBy(c("assessed_value").desc_nulls_last(), c(key)).offset((page - 1) * size).limit(size)


def parcel_search_after(df: DataFrame, last_value: float | None = None, last_key: str | int | None = None, size: int = 25, key: str = "parcel_id") -> DataFrame:
    """The page that follows a row, named by its value and key; the first page without one.

    Only `size` rows per task and page are kept, however deep the page lies.
    """
    rows = df
    if last_key is not None:
        later = c(key) > F.lit(last_key)
        if last_value is None:
            rows = df.where(c("assessed_value").isNull() & later)
        else:
            rows = df.where((c("assessed_value") < last_value) | c("assessed_value").isNull() | ((c("assessed_value") == last_value) & later))
    return rows.orderBy(c("assessed_value").desc_nulls_last(), c(key)).limit(size)


def write_page_index(df: DataFrame, path: str, ranges: int, key: str = "parcel_id") -> None:
    """Store parcels in page order so that any page reads only its own ranges.

    Rows go to `ranges` folders by (assessed value, key), highest value first and unknown last;
    equal values are told apart by the key, so no value fills a range of its own. A second
    table holds the rows before each range. An index is written once and replaced as a whole.
    """
    order = [c("assessed_value").desc_nulls_last(), c(key)]
    placed = df.repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id())
    placed.sortWithinPartitions("range", *order).write.mode("overwrite").partitionBy("range").parquet(f"{path}/rows")
    placed.limit(0).write.mode("overwrite").parquet(f"{path}/columns")  # an index without rows has no range to tell them
    counts = df.sparkSession.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    # One row per range.
    before = F.sum("rows").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    counts.withColumn("first", F.coalesce(before, F.lit(0))).write.mode("overwrite").parquet(f"{path}/ranges")


def _index_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows")


def indexed_page(spark: SparkSession, path: str, page: int, size: int = 25, key: str = "parcel_id") -> DataFrame:
    """One page from `write_page_index`: as `parcel_search`, but only the ranges of the page are read and sorted."""
    start = (page - 1) * size
    counts = spark.read.parquet(f"{path}/ranges")
    # Every range holds a row, so a page meets at most `size` of them.
    hit = counts.where((c("first") < start + size) & (c("first") + c("rows") > start)).orderBy("range").collect()
    skip = start - hit[0]["first"] if hit else 0
    rows = _index_rows(spark, path).where(c("range").isin([r["range"] for r in hit]))
    return rows.orderBy("range", c("assessed_value").desc_nulls_last(), c(key)).offset(skip).limit(size).drop("range")


def numbered_pages(spark: SparkSession, path: str, size: int = 25, key: str = "parcel_id") -> DataFrame:
    """All rows of `write_page_index` with their page and place on it; each range is ranked by itself."""
    rows = _index_rows(spark, path).join(spark.read.parquet(f"{path}/ranges").select("range", "first"), "range")
    at = c("first") + F.row_number().over(W.partitionBy("range").orderBy(c("assessed_value").desc_nulls_last(), c(key))) - 1
    return rows.withColumns({"page": F.floor(at / size) + 1, "place": at % size + 1}).drop("range", "first")


def _with_delta(joined: DataFrame) -> DataFrame:
    kept = joined.where((F.lower(F.trim("sale_type")) == "valid sale") & c("sale_price").isNotNull() & is_residential())
    delta = F.when(c("assessed_value") != 0, (c("sale_price") - c("assessed_value")) / c("assessed_value") * 100)
    return kept.withColumn("delta_pct", delta)


def top_sales(joined: DataFrame, n: int = 25) -> DataFrame:
    """Newest valid residential sales with sale-against-assessment difference."""
    return _with_delta(joined).orderBy(c("sale_date").desc_nulls_last(), c("sale_id").desc()).limit(n)


def newest_sale_detail(joined: DataFrame, key: str = "parcel_id") -> DataFrame:
    """The same row for every parcel: its newest valid sale."""
    return first_by(_with_delta(joined), [key], [c("sale_date").desc_nulls_last(), c("sale_id").desc()])


def next_fetch(
    places: DataFrame,
    cadence: DataFrame,
    now: dt.datetime,
    alpha: float = 0.8,
    min_days: float = 3.0,
    max_days: float = 45.0,
    key: str = "place_id",
) -> DataFrame:
    """Next fetch time of each place from its cadence; too few reviews wait longest."""
    joined = places.join(cadence, key, "left")
    days = F.when(
        c("avg_gap_days").isNotNull(), F.greatest(F.lit(min_days), F.least(F.lit(max_days), c("avg_gap_days") * alpha))
    ).otherwise(F.lit(max_days))
    return joined.withColumn("days", days).withColumn("next_fetch_at", add_days(F.lit(now), c("days")))


def fetch_outcome(
    df: DataFrame, now: dt.datetime, min_days: float = 3.0, max_days: float = 45.0
) -> DataFrame:
    """Schedule after one fetch: inserted rows, stored gap and failures decide the wait.

    Columns used: failed, inserted, recent, avg_gap_days (of the newest reviews),
    stored_gap_days (from earlier runs).
    """

    def clamp(x: Column) -> Column:
        return F.greatest(F.lit(min_days), F.least(F.lit(max_days), x))

    fresh = F.coalesce(c("avg_gap_days"), F.lit(14.0))
    days = (
        F.when(c("failed"), F.lit(1.0))
        .when(c("inserted") > 0, clamp(fresh * 0.8))
        .otherwise(clamp(F.coalesce(F.nullif(c("stored_gap_days"), F.lit(0.0)), F.lit(21.0)) * 1.25))
    )
    gap = F.when(~c("failed") & (c("inserted") > 0), fresh).otherwise(c("stored_gap_days"))
    return df.withColumn("days", days).withColumn("gap_days", gap).withColumn("next_fetch_at", add_days(F.lit(now), c("days")))


def add_days(start: Column, days: Column) -> Column:
    micros = F.unix_micros(start.cast("timestamp")) + F.round(days * 86400e6).cast("bigint")
    return F.timestamp_micros(micros)


def due(places: DataFrame, now: dt.datetime, n: int) -> DataFrame:
    """Active places whose fetch is due or never happened, oldest first."""
    ready = places.where(c("active") & (c("next_fetch_at").isNull() | (c("next_fetch_at") <= F.lit(now))))
    return ready.orderBy(c("next_fetch_at").asc_nulls_first(), c("place_id")).limit(n)


def recent_activity(events: DataFrame, n: int = 20) -> DataFrame:
    """Newest events with a label and a value."""
    kept = events.where((c("label") != "") & (F.trim("value") != ""))
    return kept.orderBy(c("ts").desc(), c("event_id").desc()).limit(n if n and n > 0 else 20)
