"""Column expressions for ages, values, prices and display numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def preferred(*columns: Column) -> Column:
    """First value present."""
    return F.coalesce(*columns)


def age_bucket(age: Column) -> Column:
    return F.when(age <= 10, "0-10").when(age <= 30, "10-30").when(age <= 60, "30-60").when(age.isNotNull(), "60+")


def age_features(roll_year: Column, years: list[Column], renovated: Column | None = None) -> dict[str, Column]:
    """Final year by priority (0 counts as missing), age, its square and bucket, renovation age."""
    final = F.coalesce(*[F.when(y != 0, y) for y in years])
    age = F.greatest(roll_year - final, F.lit(0)).cast("double")
    age = F.when(final.isNotNull(), age)
    out = {"improvement_year_built": final, "age": age, "age_sq": age * age, "age_bucket": age_bucket(age)}
    if renovated is not None:
        since = F.greatest(roll_year - renovated, F.lit(0)).cast("double")
        out["renovation_age"] = F.when(final.isNotNull() & (renovated != 0), since)
    return out


def price_per_sqft(price: Column, area: Column) -> Column:
    return F.when(area > 0, price / area)


def currency(c: Column) -> Column:
    return F.round(c.cast("double"), 2)


def compact_currency(c: Column) -> Column:
    """$1.2M / $3K / $950 text."""

    def short(size: int, suffix: str) -> Column:
        text = F.format_string("%.1f", F.round(c / size, 1))
        return F.concat(F.lit("$"), F.regexp_replace(text, r"\.0$", ""), F.lit(suffix))

    plain = F.concat(F.lit("$"), F.format_number(F.round(c, 0), 0))
    return F.when(c >= 1_000_000, short(1_000_000, "M")).when(c >= 1_000, short(1_000, "K")).when(c.isNotNull(), plain)


def quarter_baths(c: Column) -> Column:
    """Bath count to the nearest quarter as short text."""
    value = F.floor(c / 0.25 + 0.5) * 0.25
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", value), r"0+$", ""), r"\.$", "")


def percent_change(new: Column, old: Column) -> Column:
    """Change in percent; NULL when the old value is NULL or 0."""
    return F.when(old != 0, (new - old) * 100.0 / old)
