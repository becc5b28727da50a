"""Queries for the append feeds, in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelmill.plans.registry import query
from parcelmill.streaming import feeds as fd

c = F.col


def raw_reviews(t):
    """All reviews twice, the second time a day later; some texts are blank."""
    rows = t.reviews.withColumn("text", F.when(c("review_id") % 9 == 0, " ").otherwise(c("text")))
    return rows.unionByName(rows.withColumn("created_at", c("created_at") + F.expr("INTERVAL 1 DAY")))


@query(
    "t01_review_ingest",
    """WITH o AS (SELECT place_id, source, review_id, created_at, CASE WHEN review_id % 9 = 0 THEN ' ' ELSE text END AS text FROM reviews),
            r AS (SELECT * FROM o UNION ALL SELECT place_id, source, review_id, created_at + INTERVAL 1 DAY, text FROM o),
            d AS (SELECT place_id, source, review_id, min(created_at) AS created_at FROM r WHERE trim(text) <> '' GROUP BY 1, 2, 3)
       SELECT place_id, count(*) AS reviews, CAST(CAST(max(created_at) AS DATE) AS VARCHAR) AS last_day FROM d GROUP BY 1""",
)
def _(t):
    out = fd.last_review_dates(fd.distinct_reviews(raw_reviews(t)))
    return out.select("place_id", "reviews", c("last_review_date").cast("date").cast("string").alias("last_day"))
