"""Comparable sales for every subject at once: candidates, scores, selection.

Distances are metres on a plane; parcels carry x and y in metres.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv
from parcelmill.functions.cleaning import clean_address
from parcelmill.operators import grid as gr
from parcelmill.operators.filters import is_residential
from parcelmill.operators.joins import latest_valid_sale
from parcelmill.session import cut_lineage

c = F.col
KEY = "parcel_id"
METRES_PER_MILE = 1609.34

# Default weights of the physical similarity and difference thresholds.
PHYSICAL_WEIGHTS = {
    "area": 0.25, "baths": 0.15, "beds": 0.10, "lot": 0.15, "age": 0.10, "garage": 0.05, "basement": 0.05,
    "quality": 0.075, "condition": 0.075,
}
DIFFERENCE_LIMITS = {
    "living_area": 150.0, "bedrooms": 1.0, "bathrooms": 1.0, "garage_sqft": 50.0, "acres": 0.1, "year_built": 10.0,
}
FACTS = (
    "x", "y", "hood_code", "city_district", "valuation_area", "land_use_code", "living_area", "bedrooms", "bathrooms", "acres",
    "year_built", "eff_year_built", "garage_sqft", "basement_sqft", "quality_score", "condition_score", "value",
)


def subject_facts(parcels: DataFrame) -> DataFrame:
    """Columns a subject or comparable is described by."""
    return parcels.where(is_residential() & c("x").isNotNull() & c("y").isNotNull()).select(KEY, *FACTS)


def comp_pool(parcels: DataFrame, sales: DataFrame, as_of: dt.date, days: int | None = 540) -> DataFrame:
    """Residential parcels with complete facts, an address and a recent valid sale."""
    complete = parcels.where(
        c("bedrooms").isNotNull() & c("bathrooms").isNotNull() & c("year_built").isNotNull() & c("living_area").isNotNull()
        & clean_address(c("address")).isNotNull()
    )
    if days and days > 0:  # a parcel's newest sale is recent if any of its sales is
        sales = sales.where(c("sale_date") >= F.lit(as_of - dt.timedelta(days=days)))
    sold = latest_valid_sale(sales).where(c("last_sale_price").isNotNull() & c("last_sale_date").isNotNull())
    sold = sold.select(KEY, c("last_sale_price").alias("sale_price"), c("last_sale_date").cast("date").alias("sale_date"))
    return subject_facts(complete).join(sold, KEY)


def comp_candidates(
    subjects: DataFrame, pool: DataFrame, n: int, radius: float | None = None, pick: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Nearest comparables of every subject in three scopes: same neighborhood, same city, anywhere.

    Land use must agree where the subject has one. For each scope the `n` nearest
    are found exactly, which is all that a tiered fill of `n` within the radius or a smaller one
    can ever need. Of these rows (subject_id, comp_id, `tier`, `distance`) `pick` keeps what it
    wants, by default the first `n` per subject in tier and distance order. Returns them with
    subject and comparable facts (s_ and c_ columns), dealt by subject.
    """
    pool = cut_lineage(pool)
    use = F.nullif(F.upper(F.trim(c("land_use_code"))), F.lit(""))
    scopes = F.array(
        F.struct(F.lit(0).alias("tier"), F.concat(F.lit("hood:"), c("hood_code")).alias("scope")),
        F.struct(F.lit(1).alias("tier"), F.concat(F.lit("city:"), c("city_district")).alias("scope")),
        F.struct(F.lit(2).alias("tier"), F.lit("any").alias("scope")),
    )
    s = subjects.select(c(KEY).alias("subject_id"), "x", "y", F.coalesce(use, F.lit("*")).alias("use"), F.inline(scopes)).where(
        c("scope").isNotNull()
    )
    f = pool.select(c(KEY).alias("comp_id"), "x", "y", F.explode(F.array_compact(F.array(use, F.lit("*")))).alias("use"), scopes.alias("sc"))
    f = f.select("comp_id", "x", "y", "use", F.inline("sc")).where(c("scope").isNotNull()).drop("tier")
    features = gr.point_box(f).drop("x", "y")
    found = gr.nearest(s, features, n + 1, "subject_id", "comp_id", by=["scope", "use"], within=radius).where(c("comp_id") != c("subject_id"))
    # Dealt by subject once: the steps per pair and per subject up to the choice follow without another shuffle.
    dealt = found.select("subject_id", "comp_id", "tier", "distance").repartition("subject_id")
    best = dealt.groupBy("subject_id", "comp_id").agg(F.min("tier").alias("tier"), F.min("distance").alias("distance"))
    top = pick(best) if pick else tiered_topk(best, n)
    left = subjects.select(c(KEY).alias("subject_id"), *[c(x).alias(f"s_{x}") for x in subjects.columns if x != KEY])
    right = pool.select(c(KEY).alias("comp_id"), *[c(x).alias(f"c_{x}") for x in pool.columns if x != KEY])
    return top.join(right, "comp_id").join(left, "subject_id")


def tiered_topk(df: DataFrame, n: int) -> DataFrame:
    """First `n` per subject: lower tier first, then nearer, then lower id."""
    w = W.partitionBy("subject_id").orderBy("tier", "distance", "comp_id")
    return df.withColumn("__rn", F.row_number().over(w)).where(c("__rn") <= n).drop("__rn")


def location_score(distance: Column, radius: float, same_area: Column, same_hood: Column, same_city: Column) -> Column:
    """1 at the subject falling to 0 at the radius, raised for the same neighborhood or city.

    `same_area` false (not unknown) gives 0.
    """
    base = F.coalesce(F.greatest(F.lit(0.0), 1.0 - F.least(distance, F.lit(radius)) / radius), F.lit(0.8))
    bonus = F.when(F.coalesce(same_hood, F.lit(False)), 0.2).when(F.coalesce(same_city, F.lit(False)), 0.05).otherwise(0.0)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + bonus))
    return F.when(~F.coalesce(same_area, F.lit(True)), 0.0).otherwise(score)


def time_score(sale: Column, valuation: Column) -> Column:
    months = F.abs(F.datediff(valuation, sale)) / fv.DAYS_PER_MONTH
    return (
        F.when(months <= 3, 1.0).when(months <= 6, 0.9).when(months <= 12, 0.7).when(months <= 18, 0.5).when(months <= 24, 0.3)
        .otherwise(0.0)
    )


def _near(a: Column, b: Column, scale: Column | float) -> Column:
    return F.exp(-F.abs(a - b) / scale)


def physical_score(weights: Mapping[str, Column | float] | None = None, now_year: int = fv.REFERENCE_YEAR) -> Column:
    """Weighted similarity of the s_ and c_ columns; unknown facts drop out of both sums."""
    w = {**PHYSICAL_WEIGHTS, **(weights or {})}

    def pair(x: str) -> tuple[Column, Column]:
        return c(f"s_{x}").cast("double"), c(f"c_{x}").cast("double")

    area, lot = pair("living_area"), pair("acres")
    age = tuple(F.greatest(F.lit(now_year) - v, F.lit(0.0)) for v in pair("eff_year_built"))
    age = tuple(F.when(c(f"{p}_eff_year_built").isNotNull(), v) for p, v in zip("sc", age))
    same = {}
    for name, column, other in (("garage", "garage_sqft", 0.5), ("basement", "basement_sqft", 0.6)):
        a, b = (F.coalesce(v, F.lit(0.0)) > 0 for v in pair(column))
        same[name] = F.when(a == b, 1.0).otherwise(other)
    for name, column in (("quality", "quality_score"), ("condition", "condition_score")):
        a, b = pair(column)
        same[name] = F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 1.0).otherwise(0.6))
    parts = {
        "area": F.when(area[0] > 0, _near(*area, F.greatest(area[0] * 0.2, F.lit(300.0)))),
        "baths": _near(*pair("bathrooms"), 0.75),
        "beds": _near(*pair("bedrooms"), 1.0),
        "lot": F.when(lot[0] > 0, _near(*lot, F.greatest(lot[0] * 0.25, F.lit(0.1)))),
        "age": _near(*age, 10.0),
        **same,
    }
    score, weight = F.lit(0.0), F.lit(0.0)
    for name, value in parts.items():
        amount = w[name] if isinstance(w[name], Column) else F.lit(float(w[name]))
        score = score + F.coalesce(value * amount, F.lit(0.0))
        weight = weight + F.when(value.isNotNull(), amount).otherwise(0.0)
    return F.when(weight == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score / weight)))


def beta_weights(betas: Column) -> dict[str, Column]:
    """Similarity weights from the size of model coefficients, summing to 1."""
    terms = {
        "area": "log_area", "lot": "log_lot", "age": "log_age", "quality": "quality_score", "condition": "condition_score",
        "garage": "has_garage", "basement": "has_basement", "view": "is_view",
    }
    raw = {k: F.abs(F.coalesce(F.try_element_at(betas, F.lit(t)), F.lit(0.0))) for k, t in terms.items()}
    total = sum(raw.values(), F.lit(0.0))
    total = F.when(total == 0, 1.0).otherwise(total)
    return {k: v / total for k, v in raw.items()}


def total_score(location: Column, time: Column, physical: Column) -> Column:
    def clamp(x: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(x, F.lit(0.0))))

    return 0.40 * clamp(location) + 0.30 * clamp(time) + 0.30 * clamp(physical)


def with_scores(pairs: DataFrame, radius: float, valuation: Column, weights: Mapping[str, Column | float] | None = None, now_year: int = fv.REFERENCE_YEAR) -> DataFrame:
    """Location, time, physical and total score of each pair."""
    scored = pairs.withColumns(
        {
            "location_score": location_score(
                c("distance"), radius, c("s_valuation_area") == c("c_valuation_area"), c("s_hood_code") == c("c_hood_code"),
                c("s_city_district") == c("c_city_district"),
            ),
            "time_score": time_score(c("c_sale_date"), valuation),
            "physical_score": physical_score(weights, now_year),
        }
    )
    return scored.withColumn("total_score", total_score(c("location_score"), c("time_score"), c("physical_score")))


def difference_flags() -> Column:
    """Struct of flags: does a fact differ by its alert threshold or more?"""
    return F.struct(
        *[F.coalesce(F.abs(c(f"s_{x}") - c(f"c_{x}")) >= limit, F.lit(False)).alias(x) for x, limit in DIFFERENCE_LIMITS.items()]
    )


SORT_COLUMNS = {"sale_price": "c_sale_price", "adjusted_price": "c_sale_price", "distance": "distance", "sale_date": "c_sale_date"}


def comp_order(field: str = "score", direction: str = "desc") -> list[Column]:
    """Sort columns of a comparable list: the score tuple, or one field; ties by id."""
    field, down = field.strip().lower(), direction.strip().lower() != "asc"
    if field in SORT_COLUMNS:
        column = c(SORT_COLUMNS[field])
        return [column.desc() if down else column.asc(), c("comp_id")]
    keys = [c("total_score"), c("location_score"), c("time_score"), c("physical_score"), c("c_sale_date"), -c("distance")]
    return [*[k.desc() if down else k.asc() for k in keys], c("comp_id")]


def select_comps(scored: DataFrame, n: int = 16, field: str = "score", direction: str = "desc") -> DataFrame:
    """Best `n` per subject with their `rank`."""
    w = W.partitionBy("subject_id").orderBy(*comp_order(field, direction))
    return scored.withColumn("rank", F.row_number().over(w)).where(c("rank") <= n)


def citizen_comps(candidates: DataFrame, n: int, radius: float) -> DataFrame:
    """Simple nearest comparables from candidate rows, with their `rank`: see `escalate_radius` for one radius."""
    return escalate_radius(candidates, n, (radius,)).drop("ring")


def escalate_radius(candidates: DataFrame, n: int, radii: Sequence[float] = (3218.0, 4828.0), miles: float = 1.0) -> DataFrame:
    """Comparables of the small radius first, then new ones of the larger, until `n`, with their `ring` and `rank`.

    A ring takes its tiered fill, of that the nearest, of those only the ones within a mile
    when there are three or more. `candidates` must reach the largest radius and hold a pair
    once; all rings are counted in one pass over the rows of a subject.
    """
    pick = max(n, 8)
    whole = W.partitionBy("subject_id")
    rings = range(len(radii))

    def first(rows: DataFrame, marks: Sequence[Column], order: Sequence[str], most: int) -> DataFrame:
        """Columns __0, __1 ..: which marked rows are the first `most` of their subject; rows of no ring go."""
        so_far = whole.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        rows = rows.withColumns({f"__{i}": m for i, m in enumerate(marks)})
        rows = rows.withColumns({f"__n{i}": F.count_if(f"__{i}").over(so_far) for i in rings})
        rows = rows.withColumns({f"__{i}": c(f"__{i}") & (c(f"__n{i}") <= most) for i in rings})
        return rows.where(reduce(or_, [c(f"__{i}") for i in rings]))

    rows = first(candidates, [c("distance") <= r for r in radii], ["tier", "distance", "comp_id"], pick * 2)
    rows = first(rows, [c(f"__{i}") for i in rings], ["distance", "comp_id"], pick)
    close = c("distance") <= miles * METRES_PER_MILE
    rows = rows.withColumns({f"__k{i}": F.count_if(c(f"__{i}") & close).over(whole) for i in rings})
    rows = first(rows, [c(f"__{i}") & ((c(f"__k{i}") < 3) | close) for i in rings], ["distance", "comp_id"], n)
    ring = F.coalesce(*[F.when(c(f"__{i}"), F.lit(i)) for i in rings])
    rows = rows.select("subject_id", "comp_id", "tier", "distance", ring.alias("ring"))
    # Within a ring the order is by distance, for a comparable new to it as for all.
    order = whole.orderBy("ring", "distance", "comp_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(c("rank") <= n)


def match_scores(scored: DataFrame) -> DataFrame:
    """Display percentages per pair: overall and its parts, from whichever are known."""

    def ratio(x: str) -> Column:
        a, b = c(f"s_{x}").cast("double"), c(f"c_{x}").cast("double")
        return F.when((a > 0) & (b > 0), F.least(a, b) / F.greatest(a, b))

    def same(x: str) -> Column:
        a, b = c(f"s_{x}"), c(f"c_{x}")
        return F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, 1.0).otherwise(0.6))

    def mean(parts: Sequence[Column]) -> Column:
        known = F.array_compact(F.array(*parts))
        return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known))

    def percent(x: Column) -> Column:
        return F.when(x.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.bround(x * 100, 0).cast("int"))))

    parts = {
        "proximity": c("location_score"), "time": c("time_score"), "size": ratio("living_area"),
        "quality_condition": mean([same("quality_score"), same("condition_score")]), "land": ratio("acres"),
    }
    overall = F.coalesce(mean(list(parts.values())), c("total_score"), F.lit(0.0))
    return scored.select("*", percent(overall).alias("match_overall"), *[percent(v).alias(f"match_{k}") for k, v in parts.items()])
