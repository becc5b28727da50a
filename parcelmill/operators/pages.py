"""Links, scores and tables read from raw pages."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.functions import web as wb
from parcelmill.operators.windows import first_by

c = F.col


def page_links(df: DataFrame, url: str = "url", html: str = "html", key: str = "page_id") -> DataFrame:
    """Distinct absolute price-list links per page."""
    anchors = F.regexp_extract_all(c(html), F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))
    rows = df.select(key, c(url).alias("base"), F.explode(anchors).alias("a"))
    parts = rows.select(
        key,
        "base",
        F.regexp_extract("a", r"""(?is)href\s*=\s*["']([^"']*)["']""", 1).alias("href"),
        F.regexp_replace(F.regexp_replace("a", r"(?s)<[^>]*>", ""), r"\s+", " ").alias("label"),
    )
    wanted = parts.where((c("href") != "") & wb.looks_like_menu(c("label"), c("href")))
    return wanted.select(key, wb.normalize_url(wb.absolute_url(c("base"), c("href"))).alias("link")).distinct()


def _cells(row: Column) -> Column:
    found = F.regexp_extract_all(row, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    return F.transform(found, lambda x: F.trim(_plain(x)))


def _plain(x: Column) -> Column:
    text = F.regexp_replace(x, r"(?s)<[^>]*>", "")
    for mark, value in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(mark), F.lit(value))
    return text


def table_rows(df: DataFrame, html: str = "html", key: str = "parcel_id", mark: str = "Account History For Parcel") -> DataFrame:
    """Rows of the history table as maps: third row names the columns.

    Rows whose width differs from the header are left out.
    """
    table = F.regexp_extract(c(html), rf"(?is)<table\b(?:(?!<table\b).)*?{mark}.*?</table>", 0)
    lines = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    split = df.select(key, F.transform(lines, _cells).alias("t"))
    header = F.coalesce(F.try_element_at("t", F.lit(3)), F.array().cast("array<string>"))
    body = F.when(F.size("t") > 3, F.slice(c("t"), F.lit(4), F.size("t"))).otherwise(F.array().cast("array<array<string>>"))
    named = split.select(key, header.alias("h"), body.alias("b"))
    good = F.filter("b", lambda r: F.size(r) == F.size("h"))
    ident = F.create_map(F.lit("ParcelID"), c(key).cast("string"))
    return named.select(key, F.transform(good, lambda r: F.map_concat(F.map_from_arrays(c("h"), r), ident)).alias("rows"))


def changed_pages(snapshots: DataFrame, now: dt.datetime, days: int = 90, key: str = "site", html: str = "html") -> DataFrame:
    """Newest snapshot per site: content hash, whether it changed, whether to fetch again.

    Only the two newest hashes of a site leave the map side.
    """
    hashed = snapshots.select(key, "fetched_at", "page_id", F.sha2(F.coalesce(c(html), F.lit("")), 256).alias("hash"))
    two = first_by(hashed, [key], [c("fetched_at").desc(), c("page_id").desc()], 2)
    entry = F.struct("fetched_at", "page_id", "hash")
    out = two.groupBy(key).agg(F.max(entry).alias("new"), F.min(entry).alias("old"), F.count(F.lit(1)).alias("n"))
    return out.select(
        key,
        c("new.page_id").alias("page_id"),
        c("new.hash").alias("hash"),
        ((c("n") == 1) | (c("new.hash") != c("old.hash"))).alias("changed"),
        (c("new.fetched_at") < F.lit(now - dt.timedelta(days=days))).alias("fetch_again"),
    )
