"""Append feeds as Structured Streaming jobs over shared folders."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parcelmill.operators.windows import recent_activity
from parcelmill.session import cut_lineage

c = F.col
REVIEW_KEY = ["place_id", "source", "review_id"]


def valid_reviews(reviews: DataFrame) -> DataFrame:
    """Rows with a text and an id."""
    return reviews.where((F.trim(c("text")) != "") & (F.trim(c("review_id").cast("string")) != ""))


def distinct_reviews(reviews: DataFrame) -> DataFrame:
    """One row per place, source and id (batch form): the earliest."""
    rest = [x for x in reviews.columns if x not in REVIEW_KEY]
    first = F.min(F.struct("created_at", *[x for x in rest if x != "created_at"])).alias("r")
    return valid_reviews(reviews).groupBy(*REVIEW_KEY).agg(first).select(*REVIEW_KEY, "r.*").select(*reviews.columns)


def last_review_dates(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("place_id").agg(F.max("created_at").alias("last_review_date"), F.count(F.lit(1)).alias("reviews"))


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:  # nothing was written yet
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def _commits(spark: SparkSession, table_path: str) -> DataFrame:
    """(batch): the batches that count, which are committed and not replaced by a compaction."""
    found = _read_or_none(spark, f"{table_path.rstrip('/')}/_commits")
    if found is None:
        return spark.createDataFrame([], "batch string")
    replaced = found.select(F.explode("replaces").alias("batch")).distinct()
    return found.select("batch").distinct().join(replaced, "batch", "left_anti")


def _commit(spark: SparkSession, table_path: str, batch: str, replaces: Column) -> None:
    """One small file under the name of the batch: a batch that is run again commits again, to the same place."""
    entry = spark.range(1).select(F.lit(batch).alias("batch"), replaces.cast("array<string>").alias("replaces"))
    entry.coalesce(1).write.mode("overwrite").parquet(f"{table_path.rstrip('/')}/_commits/name={batch}")


def _committed_rows(spark: SparkSession, table_path: str) -> DataFrame | None:
    rows = _read_or_none(spark, table_path)
    return None if rows is None else rows.join(_commits(spark, table_path), "batch", "left_semi")


def stored_reviews(spark: SparkSession, table_path: str) -> DataFrame:
    """The stored table: committed rows, one per review.

    Two jobs that store the same review at the same time both commit it; here the earliest row stays.
    """
    rows = _committed_rows(spark, table_path)
    if rows is None:
        raise ValueError(f"no reviews were stored in {table_path}")
    return distinct_reviews(rows.drop("batch", "bucket"))


def _job_of(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint: the same after a restart, another for a new checkpoint."""
    text = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0]
    return str(json.loads(text)["id"])


def ingest_reviews(stream: DataFrame, table_path: str, checkpoint: str, places_path: str | None = None, buckets: int = 64) -> StreamingQuery:
    """Add each review once to a stored table, however old it is and however many jobs write.

    Repeats inside a micro-batch leave the earliest; an anti join with the committed keys of the
    touched buckets drops what the table holds. A batch is named by the id of its stream and its
    number, is written to partitions of its own and counts once its name is committed. So a
    batch that runs again replaces what it wrote itself, never what another job or an earlier
    checkpoint wrote, and what a failed one left is not seen. `stored_reviews` reads the table,
    `compact_reviews` joins its small files. With `places_path` each batch stores what it added
    to every place; `place_counts` adds it up.
    """
    columns = stream.columns
    bucket = F.pmod(F.xxhash64(*REVIEW_KEY), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        name = f"{_job_of(spark, checkpoint)}-{batch_id}"
        rows = distinct_reviews(batch.select(*columns)).withColumn("bucket", bucket).withColumn("batch", F.lit(name))
        old = _committed_rows(spark, table_path)
        if old is not None:
            # At most `buckets` numbers.
            touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]
            known = old.where(c("bucket").isin(touched) & (c("batch") != name)).select(*REVIEW_KEY)
            rows = rows.join(known, REVIEW_KEY, "left_anti")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(table_path)
        if places_path is not None:
            written = _read_or_none(spark, table_path)
            if written is not None:
                added = last_review_dates(written.where(c("batch") == name))
                added.write.mode("overwrite").parquet(f"{places_path.rstrip('/')}/batch={name}")
        _commit(spark, table_path, name, F.array())

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def place_counts(spark: SparkSession, table_path: str, places_path: str) -> DataFrame:
    """(place_id, last_review_date, reviews) over all committed batches of all jobs."""
    added = spark.read.parquet(places_path).join(_commits(spark, table_path), "batch", "left_semi")
    return added.groupBy("place_id").agg(F.max("last_review_date").alias("last_review_date"), F.sum("reviews").alias("reviews"))


def compact_reviews(spark: SparkSession, table_path: str, places_path: str | None = None) -> str:
    """Write all committed reviews anew, one file per bucket, and let them stand for the batches they come from.

    The old files stay, unseen, so a reader that has begun is not disturbed; remove the folders
    of replaced batches when no reader is left. No stream may write in the meantime. Returns the
    name of the new batch.
    """
    name = f"compact-{uuid.uuid4().hex}"
    names = cut_lineage(_commits(spark, table_path))
    rows = spark.read.parquet(table_path).join(names, "batch", "left_semi")
    kept = distinct_reviews(rows.drop("batch", "bucket")).join(rows.select(*REVIEW_KEY, "bucket").distinct(), REVIEW_KEY)
    kept.withColumn("batch", F.lit(name)).repartition("bucket").write.mode("append").partitionBy("bucket", "batch").parquet(table_path)
    if places_path is not None:
        own = spark.read.parquet(table_path).where(c("batch") == name)
        last_review_dates(own).write.mode("overwrite").parquet(f"{places_path.rstrip('/')}/batch={name}")
    replaces = [r["batch"] for r in names.collect()]  # one name per batch
    _commit(spark, table_path, name, F.array(*map(F.lit, replaces)))
    return name


def activity_feed(stream: DataFrame, table_path: str, checkpoint: str, n: int = 20) -> StreamingQuery:
    """Keep the newest `n` events: each batch merges its own newest with the stored ones.

    The state is two alternating folders of at most `n` rows; a repeated batch
    reads the folder of the batch before it and gives the same result.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = recent_activity(batch, n)
        if batch_id > 0:
            rows = recent_activity(rows.unionByName(spark.read.parquet(f"{table_path}/slot={(batch_id - 1) % 2}")), n)
        rows.coalesce(1).write.mode("overwrite").parquet(f"{table_path}/slot={batch_id % 2}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


SCHEDULE = "place_id long, event string, at timestamp, days double, gap_days double, next_fetch_at timestamp"


def fetch_schedule(outcomes: DataFrame, late: str = "1 day", min_days: float = 3.0, max_days: float = 45.0) -> DataFrame:
    """The refresh schedule of every place as a stream of `fetched`, `late` and `due` events.

    `outcomes` is a stream of fetches: place_id, at, failed, inserted, avg_gap_days (of the
    newest reviews). A place keeps its stored gap, its next fetch and its newest outcome as
    state, three numbers however long the feed is. Each outcome sets the next fetch by the rule
    of `fetch_outcome` and a timer for it; once the watermark, `late` behind the newest time,
    passes the timer without another outcome, the place is due. Outcomes of a batch are taken by
    time. One that is not newer than what its place has handled is reported as `late` and changes
    nothing; Spark leaves out rows that are behind the watermark when they are read, so `late`
    must cover the feed's disorder. Rows without place or time are left out; missing flags and
    counts are false and 0.
    """

    def micros(at: pd.Timestamp) -> int:
        return at.value // 1000

    def clamp(days: float) -> float:
        return max(min_days, min(max_days, days))

    def wait(row: object, gap: float | None) -> tuple[float, float | None]:
        if row.failed:
            return 1.0, gap
        if row.inserted > 0:
            fresh = 14.0 if math.isnan(row.avg_gap_days) else float(row.avg_gap_days)
            return clamp(fresh * 0.8), fresh
        return clamp((gap or 21.0) * 1.25), gap

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        gap, following, newest = state.get if state.exists else (None, None, None)
        out = []
        if state.hasTimedOut:
            out.append((key[0], "due", following, None, gap, following))
            state.update((gap, following, newest))  # without the timer, which would go off again
        else:
            rows = pd.concat(list(batches)).sort_values(["at", "failed", "inserted", "avg_gap_days"])
            for row in rows.itertuples(index=False):
                at = micros(row.at)
                if newest is not None and at <= newest:
                    out.append((key[0], "late", at, None, gap, following))
                    continue
                days, gap = wait(row, gap)
                newest, following = at, at + round(days * 86400e6)
                out.append((key[0], "fetched", at, days, gap, following))
            state.update((gap, following, newest))
            if following // 1000 > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(following // 1000)
            elif any(x[1] == "fetched" for x in out):
                out.append((key[0], "due", following, None, gap, following))
        if not out:
            return
        made = pd.DataFrame(out, columns=["place_id", "event", "at", "days", "gap_days", "next_fetch_at"])
        times = {x: pd.to_datetime(made[x].astype("int64"), unit="us") for x in ("at", "next_fetch_at")}
        yield made.assign(days=made["days"].astype(float), gap_days=made["gap_days"].astype(float), **times)

    rows = outcomes.where(c("place_id").isNotNull() & c("at").isNotNull()).select(
        c("place_id").cast("long").alias("place_id"), "at", F.coalesce("failed", F.lit(False)).alias("failed"),
        F.coalesce(c("inserted").cast("int"), F.lit(0)).alias("inserted"), c("avg_gap_days").cast("double").alias("avg_gap_days"),
    )
    keyed = rows.withWatermark("at", late).groupBy("place_id")
    return keyed.applyInPandasWithState(run, SCHEDULE, "gap double, following long, newest long", "append", GroupStateTimeout.EventTimeTimeout)
