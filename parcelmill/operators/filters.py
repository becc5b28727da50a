"""Predicate sets of the parcel, sales and comparable searches."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv
from parcelmill.functions.codes import starts_with_any

c = F.col


def is_residential(column: str = "proptype") -> Column:
    return F.upper(F.trim(F.coalesce(c(column), F.lit("")))) == "R"


def valid_sale(column: str = "sale_type") -> Column:
    return c(column).rlike(r"(?i)^\s*valid sale\s*$")


def _between(df: DataFrame, column: str, low, high) -> DataFrame:
    if low is not None:
        df = df.where(c(column) >= F.lit(low))
    if high is not None:
        df = df.where(c(column) <= F.lit(high))
    return df


def contains_text(column: str, text: str) -> Column:
    return F.contains(F.lower(c(column)), F.lit(text.lower()))


def parcel_filter(
    df: DataFrame,
    *,
    address: str | None = None,
    parcel: object | None = None,
    value: tuple[float | None, float | None] = (None, None),
    year: tuple[int | None, int | None] = (None, None),
    acres: tuple[float | None, float | None] = (None, None),
    sale_price: tuple[float | None, float | None] = (None, None),
    district: str | None = None,
    id_column: str = "parcel_id",
) -> DataFrame:
    """Residential parcels that meet every given bound (bounds are inclusive)."""
    df = df.where(is_residential())
    if address:
        df = df.where(contains_text("address", address))
    if parcel is not None:
        df = df.where(c(id_column) == F.lit(parcel))
    if district:
        df = df.where(c("city_district") == district)
    df = _between(df, "assessed_value", *value)
    df = _between(df, "year_built", *year)
    df = _between(df, "acres", *acres)
    if sale_price != (None, None):
        df = _between(df, "last_sale_price", *sale_price)
    return df


def sales_filter(
    df: DataFrame,
    *,
    hood: str | None = None,
    city: str | None = None,
    parcel: object | None = None,
    price: tuple[float | None, float | None] = (None, None),
    dates: tuple[dt.date | None, dt.date | None] = (None, None),
    land_use: str | None = None,
    acres: tuple[float | None, float | None] = (None, None),
    id_column: str = "parcel_id",
) -> DataFrame:
    """Valid residential sales that meet every given bound."""
    df = df.where(F.lower(F.trim(c("sale_type"))) == "valid sale").where(is_residential())
    for column, wanted in (("hood_code", hood), ("city_district", city), (id_column, parcel), ("land_use_code", land_use)):
        if wanted is not None:
            df = df.where(c(column) == F.lit(wanted))
    df = _between(df, "sale_price", *price)
    df = _between(df, "sale_date", *dates)
    return _between(df, "acres", *acres)


def cma_filter(
    df: DataFrame,
    *,
    property_type: str | None = None,
    dates: tuple[dt.date | None, dt.date | None] = (None, None),
    price: tuple[float | None, float | None] = (None, None),
    bedrooms: float | None = None,
    bathrooms: float | None = None,
    bbox: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """Comparable filters; the last sale day counts in full."""
    if property_type:
        df = df.where(F.lower(c("proptype")) == property_type.lower())
    first, last = dates
    if first is not None:
        df = df.where(c("sale_date") >= F.lit(first))
    if last is not None:
        df = df.where(c("sale_date") < F.lit(last + dt.timedelta(days=1)))
    df = _between(df, "sale_price", *price)
    df = _between(df, "bedrooms", bedrooms, None)
    df = _between(df, "bathrooms", bathrooms, None)
    if bbox is not None:
        x0, y0, x1, y1 = bbox
        df = df.where(c("x").between(x0, x1) & c("y").between(y0, y1))
    return df


def parcel_lookup(
    df: DataFrame,
    text: str,
    *,
    id_column: str = "parcel_number",
    order_by: str | None = None,
    limit: int = 15,
    min_length: int = 3,
) -> DataFrame:
    """Type-ahead search by parcel id, address start or address part."""
    text = text.strip()
    address = F.lower(c("address"))
    base = df.where(is_residential() & (F.trim(c("address")) != "") & ~F.contains(address, F.lit("nan")))
    if len(text) < min_length:
        base = base.where(F.lit(False))
    if re.fullmatch(r"[Pp]\s*\d+", text):
        digits = re.sub(r"\D", "", text)
        base = base.where(F.upper(c(id_column)).startswith(f"P{digits}"))
    elif re.match(r"\d", text):
        base = base.where(address.startswith(text.lower()))
    else:
        base = base.where(F.contains(address, F.lit(text.lower())))
    return base.orderBy(order_by or id_column, id_column).limit(limit)


def drop_junk_addresses(df: DataFrame, column: str = "address") -> DataFrame:
    text = c(column)
    junk = text.isin(*fv.JUNK_ADDRESSES) | (F.trim(text) == "") | text.rlike(r"(?i)^nan[ ,nan]*$")
    return df.where(text.isNotNull() & ~junk)


def in_prefixes(df: DataFrame, column: str, prefixes=fv.TREND_PREFIXES) -> DataFrame:
    return df.where(starts_with_any(c(column), prefixes))


def mode_filter(df: DataFrame, mode: str, land_use: str = "land_use_code") -> DataFrame:
    """Rows of one model mode: sfr, mobile_home or condo (unknown modes act as sfr)."""
    mode = (mode or "sfr").strip().lower()
    residential = F.coalesce(c("proptype"), F.lit("")) == "R"
    code = F.trim(c(land_use))
    number = F.when(code.rlike(r"^\d+$"), code.try_cast("int"))
    if mode == "condo":
        return df.where(residential)
    if mode == "mobile_home":
        typed = F.upper(F.coalesce(c("proptype"), F.lit(""))).isin("M", "MH")
        return df.where(F.coalesce(number.isin(*fv.MODE_LAND_USE["mobile_home"]), F.lit(False)) | typed)
    return df.where(residential & number.isin(*fv.MODE_LAND_USE["sfr"]))


def recent(df: DataFrame, column: str, days: int | None, as_of: dt.date) -> DataFrame:
    """Rows of the last `days` days; no days or a non-positive number keeps all rows."""
    if not days or days <= 0:
        return df
    return df.where(c(column) >= F.lit(as_of - dt.timedelta(days=days)))


def ratio_window(df: DataFrame, column: str = "ratio", low: float = 0.25, high: float = 2.5) -> DataFrame:
    return df.where(c(column).between(low, high))
