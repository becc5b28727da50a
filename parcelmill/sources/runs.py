"""Run artifacts, exports and the import log."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def write_run(
    stats: DataFrame, coefficients: DataFrame, metadata: Mapping[str, str], path: str, segments: DataFrame | None = None,
    totals: Mapping[str, float] | None = None, warnings: Sequence[str] = (), errors: Sequence[str] = (),
) -> None:
    """One JSON record per run: metadata, statistics, segments, coefficients, global figures and messages.

    A run has some dozens of segments and terms; the lists are bounded by the model, not by
    the sales it was fitted on.
    """
    def listed(df: DataFrame, name: str) -> DataFrame:
        rest = [x for x in df.columns if x != "run_id"]
        return df.groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(name))

    record = listed(stats, "stats").join(listed(coefficients, "coefficients"), "run_id", "left")
    if segments is not None:
        record = record.join(listed(segments, "segments"), "run_id", "left")
    record = record.withColumn("metadata", F.struct(*[F.lit(v).alias(n) for n, v in metadata.items()]))
    if totals:
        record = record.withColumn("global_metrics", F.struct(*[F.lit(float(v)).alias(n) for n, v in totals.items()]))
    texts = {"warnings": warnings, "errors": errors}
    record = record.withColumns({n: F.array(*[F.lit(x) for x in v]).cast("array<string>") for n, v in texts.items()})
    record.write.mode("append").json(path)


def load_run(spark: SparkSession, path: str, run_id: str | None = None, mode: str | None = None) -> DataFrame:
    """One run by its id, or the newest; with `mode` only of that mode. No row where there is none."""
    runs = spark.read.json(path)
    if run_id is not None:
        runs = runs.where(c("run_id") == run_id)
    if mode is not None:
        runs = runs.where(c("metadata.mode") == mode)
    return runs.orderBy(c("metadata.generated_at").desc(), "run_id").limit(1)


def list_runs(spark: SparkSession, path: str, mode: str | None = None) -> DataFrame:
    """Run ids and times in an artifact folder, newest first."""
    runs = spark.read.json(path).select("run_id", "metadata.generated_at", "metadata.mode")
    if mode is not None:
        runs = runs.where(c("mode") == mode)
    return runs.orderBy(c("generated_at").desc(), "run_id")


def export(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a report as CSV (arrays become text) or JSON."""
    if fmt == "json":
        df.write.mode("overwrite").json(path)
        return
    if fmt != "csv":
        raise ValueError(f"unknown format {fmt}")
    nested = ("array", "map", "struct")
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in nested else c(f.name) for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def log_import(
    spark: SparkSession, path: str, dataset: str, table: str, source: str, counts: DataFrame, at: dt.datetime, success: bool = True,
) -> None:
    """Append one line to the import log, with the counts (lines, kept, skipped) a loader observed.

    `counts` is a one-row frame such as `roll_counts` gives; the time is the caller's.
    """
    row = counts.select(
        F.lit(dataset).alias("dataset"), F.lit(table).alias("table"), F.lit(source).alias("source"), F.lit(success).alias("success"),
        c("kept").cast("bigint").alias("row_count"), c("lines").cast("bigint").alias("lines"), c("skipped").cast("bigint").alias("skipped"), F.lit(at).alias("imported_at"),
    )
    row.write.mode("append").parquet(path)
