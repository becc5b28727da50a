"""Nested parcel documents and vector search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.operators.windows import dedupe_improvements_by_id, dedupe_land, dedupe_sales, sales_list

c = F.col
KEY = "parcel_id"


def _down(x: Column) -> list[Column]:
    """Sort keys for descending order with unknown values last."""
    return [x.isNull(), -x]


def ordered_list(df: DataFrame, order: Sequence[Column], fields: Sequence[str], name: str) -> DataFrame:
    """One ordered array of structs per parcel."""
    keys = [o.alias(f"__o{i}") for i, o in enumerate(order)]
    rows = F.sort_array(F.collect_list(F.struct(*keys, F.struct(*fields).alias("__v"))))
    return df.groupBy(KEY).agg(F.transform(rows, lambda r: r["__v"]).alias(name))


def land_lists(land: DataFrame) -> DataFrame:
    order = [*_down(c("value_year")), c("land_segment_id"), *_down(c("market_value"))]
    return ordered_list(dedupe_land(land), order, ["value_year", "land_type", "size_acres", "size_sqft", "market_value"], "land_segments")


def improvement_lists(improvements: DataFrame) -> DataFrame:
    order = [c("improvement_id"), *_down(c("eff_year_built")), *_down(c("year_built"))]
    fields = ["improvement_id", "type_code", "building_style", "condition_code", "value", "area", "year_built", "eff_year_built"]
    return ordered_list(dedupe_improvements_by_id(improvements), order, fields, "improvements")


def sale_lists(sales: DataFrame) -> DataFrame:
    order = [*_down(F.unix_date(c("sale_date").cast("date"))), *_down(c("sale_price")), c("sale_id")]
    return ordered_list(dedupe_sales(sales), order, ["sale_price", "sale_date", "sale_type", "deed_type", "recording_number"], "sales")


def parcel_detail(parcels: DataFrame, land: DataFrame, improvements: DataFrame, sales: DataFrame) -> DataFrame:
    """Residential parcels with ordered, deduplicated land, improvement and sale arrays."""
    homes = parcels.where(F.upper(F.trim(F.coalesce(c("proptype"), F.lit("")))) == "R")
    out = homes.join(land_lists(land), KEY, "left").join(improvement_lists(improvements), KEY, "left").join(sale_lists(sales), KEY, "left")
    for name in ("land_segments", "improvements", "sales"):
        out = out.withColumn(name, F.coalesce(c(name), F.array()))
    return out


def as_json(df: DataFrame, *arrays: str) -> DataFrame:
    """Arrays as JSON text without null fields."""
    return df.withColumns({name: F.to_json(c(name)) for name in arrays})


def _total(array: str, field: str) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, s: acc + F.coalesce(s[field], F.lit(0.0)))


def detail_summary(detail: DataFrame) -> DataFrame:
    """Land totals (parcel value when none), latest sale and the first five real sales."""
    real = F.filter("sales", lambda s: s["sale_price"] > 0)
    return detail.select(
        KEY,
        F.coalesce(F.nullif(_total("land_segments", "size_acres"), F.lit(0.0)), c("acres")).alias("land_acres"),
        F.coalesce(F.nullif(_total("land_segments", "market_value"), F.lit(0.0)), c("total_market_value")).alias("land_market_value"),
        F.try_element_at("sales", F.lit(1)).alias("latest_sale"),
        F.slice(real, 1, 5).alias("recent_valid"),
        F.size("sales").alias("total_records"),
    )


def sales_documents(
    sales: DataFrame, parcels: DataFrame, land: DataFrame, improvements: DataFrame, sort: str = "recent", limit: int = 25
) -> DataFrame:
    """The sales list with nested land and improvements.

    The list is cut to its at most 100 rows first; that bound makes the
    broadcast of its parcel ids safe, so land and improvements are filtered
    while they are scanned.
    """
    valid = sales.where(F.lower(F.trim("sale_type")) == "valid sale")
    homes = parcels.where(F.upper(F.trim(F.coalesce(c("proptype"), F.lit("")))) == "R")
    page = sales_list(valid.join(homes, KEY), sort, limit=limit)
    ids = F.broadcast(page.select(KEY).distinct())
    out = page.join(land_lists(land.join(ids, KEY, "left_semi")), KEY, "left")
    out = out.join(improvement_lists(improvements.join(ids, KEY, "left_semi")), KEY, "left")
    for name in ("land_segments", "improvements"):
        out = out.withColumn(name, F.coalesce(c(name), F.array()))
    return out.withColumn("land_acres", F.coalesce(F.nullif(_total("land_segments", "size_acres"), F.lit(0.0)), c("acres")))


def l2_distance(vector: Column, query: Sequence[float]) -> Column:
    target = F.array(*[F.lit(float(x)) for x in query])
    squares = F.zip_with(vector, target, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def vector_search(df: DataFrame, query: Sequence[float], k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Nearest `k` vectors by distance; rows without a vector are skipped."""
    near = df.where(c(vector).isNotNull()).withColumn("distance", l2_distance(c(vector), query))
    top = near.orderBy("distance", key).limit(k)
    return top.withColumn("similarity", 1 / (1 + c("distance"))).drop(vector)


def fallback_search(parcels: DataFrame, k: int = 10) -> DataFrame:
    """Parcels by market value, used when no encoder is at hand."""
    kept = parcels.where(c("address").isNotNull() & (F.upper(F.trim(F.coalesce(c("proptype"), F.lit("")))) == "R"))
    return kept.orderBy(c("total_market_value").desc_nulls_last(), c(KEY)).limit(k).withColumn("similarity", F.lit(None).cast("double"))


def hashing_encoder(size: int = 64) -> Callable[[pd.Series], np.ndarray]:
    """Encoder that counts word hashes; needs no model files."""

    def encode(texts: pd.Series) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), size))
        for i, text in enumerate(texts):
            for word in (text or "").lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % size] += 1.0 if h & 0x80000000 else -1.0
        return out

    return encode


def embed(
    df: DataFrame, text: str, encoder: Callable[[pd.Series], np.ndarray] | None = None, vector: str = "embedding"
) -> DataFrame:
    """Unit-length embeddings for rows that have none yet; others pass through."""
    encode = encoder or hashing_encoder()

    @F.pandas_udf("array<float>")
    def to_vector(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            m = encode(texts)
            norms = np.linalg.norm(m, axis=1, keepdims=True)
            m = m / np.where(norms == 0, 1.0, norms)
            yield pd.Series(list(m.astype("float32")))

    if vector not in df.columns:
        return df.withColumn(vector, to_vector(c(text)))
    done = df.where(c(vector).isNotNull())
    return df.where(c(vector).isNull()).withColumn(vector, to_vector(c(text))).unionByName(done)
