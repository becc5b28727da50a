"""Profiles and checks of columns, codes and layers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelmill.operators.quantiles import metric_quantiles

c = F.col


def long_form(df: DataFrame, columns: Sequence[str], kind: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per input row and column: (keys, column, value)."""
    pairs = F.array(*[F.struct(F.lit(x).alias("column"), c(x).cast(kind).alias("value")) for x in columns])
    return df.select(*keys, F.inline(pairs))


def profile_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts, range, mean, spread and known problems per numeric column."""
    out = long_form(df, columns, "double").groupBy("column").agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count("value").alias("non_null"),
        (F.count(F.lit(1)) - F.count("value")).alias("nulls"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.avg("value").alias("avg"),
        F.stddev_samp("value").alias("stddev"),
    )
    name = F.lower("column")
    issues = F.array_compact(
        F.array(
            F.when(c("non_null") == 0, F.lit("Column is completely empty")),
            F.when(name.contains("aspect") & ((c("min") < 0) | (c("max") > 360)), F.lit("Aspect out of 0-360 deg range")),
            F.when(name.contains("dist") & (c("min") < 0), F.lit("Distance is negative")),
        )
    )
    return out.withColumn("issues", issues)


def profile_text(df: DataFrame, columns: Sequence[str], samples: int = 10) -> DataFrame:
    rows = long_form(df, columns, "string")
    counts = rows.groupBy("column").agg(
        F.count(F.lit(1)).alias("total_rows"), F.count("value").alias("non_null"),
        (F.count(F.lit(1)) - F.count("value")).alias("nulls"),
    )
    values = rows.where(c("value").isNotNull()).distinct()
    first = values.withColumn("rn", F.row_number().over(W.partitionBy("column").orderBy("value"))).where(c("rn") <= samples)
    listed = first.groupBy("column").agg(F.sort_array(F.collect_list("value")).alias("sample_values"))
    return counts.join(listed, "column", "left").withColumn("sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))


def profile_geometry(df: DataFrame, x: str, y: str, srid: str | None = None) -> DataFrame:
    """Presence, reference system range and extent of a coordinate pair."""
    system = c(srid) if srid else F.lit(None).cast("int")
    present = c(x).isNotNull() & c(y).isNotNull()
    return df.agg(
        F.count_if(present).alias("non_null"), F.count_if(~present).alias("nulls"),
        F.min(F.when(present, system)).alias("srid_min"), F.max(F.when(present, system)).alias("srid_max"),
        F.min(x).alias("min_x"), F.min(y).alias("min_y"), F.max(x).alias("max_x"), F.max(y).alias("max_y"),
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Missing count and percent per column that has any, worst first."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(c(x).isNull()).alias(x) for x in df.columns])
    pairs = F.array(*[F.struct(F.lit(x).alias("column"), c(x).alias("missing")) for x in df.columns])
    rows = counts.select("__n", F.inline(pairs)).where(c("missing") > 0)
    return rows.select("column", "missing", (c("missing") * 100.0 / c("__n")).alias("percent")).orderBy(c("percent").desc(), "column")


def unbiased_skew(values: Column) -> Column:
    n = F.count(values)
    return F.when(n > 2, F.skewness(values) * F.sqrt(n * (n - 1.0)) / (n - 2.0))


def dataset_profile(df: DataFrame, columns: Sequence[str], target: str | None = None) -> DataFrame:
    """Long profile: missing share, skew, pairwise correlations; one pass over the data."""
    aggs: list[Column] = []
    rows: list[Column] = []
    for i, x in enumerate(columns):
        aggs += [F.round(F.avg(c(x).isNull().cast("double")), 3).alias(f"m{i}"), F.round(unbiased_skew(c(x).cast("double")), 4).alias(f"s{i}")]
        rows += [_fact("missing_pct", x, None, c(f"m{i}")), _fact("skewness", x, None, c(f"s{i}"))]
        for j, y in enumerate(columns):
            if j > i:
                aggs.append(F.round(F.corr(c(x).cast("double"), c(y).cast("double")), 4).alias(f"c{i}_{j}"))
                kind = "target_correlation" if target in (x, y) else "correlation"
                rows.append(_fact(kind, x, y, c(f"c{i}_{j}")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def _fact(kind: str, a: str, b: str | None, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(a).alias("column"), F.lit(b).cast("string").alias("other"), value.alias("value"))


def coverage(df: DataFrame, columns: Sequence[str], threshold_pct: float = 95.0) -> DataFrame:
    rows = long_form(df, columns, "string").groupBy("column").agg(
        F.count("value").alias("non_null"), (F.count(F.lit(1)) - F.count("value")).alias("null_count"),
        (F.count("value") * 100.0 / F.count(F.lit(1))).alias("coverage_pct"),
    )
    return rows.withColumn("flagged", c("coverage_pct") < threshold_pct)


def range_violations(df: DataFrame, rules: Mapping[str, Column], key: str, samples: int = 5) -> DataFrame:
    """Rows that break a rule: count per rule and the first keys in order."""
    broken = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    hits = df.select(c(key).alias("key"), F.explode(broken).alias("rule"))
    counts = hits.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))
    first = hits.withColumn("rn", F.row_number().over(W.partitionBy("rule").orderBy("key"))).where(c("rn") <= samples)
    return counts.join(first.groupBy("rule").agg(F.sort_array(F.collect_list("key")).alias("samples")), "rule")


def unmapped(values: DataFrame, column: str, known: Sequence[str], split: str | None = None) -> DataFrame:
    """Distinct normalized codes (or tokens) that a code table does not hold."""
    text = F.upper(F.trim(c(column)))
    if split:
        token = F.explode(F.split(text, split))
        rows = values.select(token.alias("code"))
        bare = F.regexp_extract("code", r"^\d+([A-Z]+)", 1)
        rows = rows.select(F.when(bare != "", bare).otherwise(c("code")).alias("code"))
    else:
        rows = values.select(text.alias("code"))
    seen = rows.where(c("code") != "").groupBy("code").agg(F.count(F.lit(1)).alias("rows"))
    return seen.where(~c("code").isin(*known))


def verify_sample(
    stored: DataFrame, recomputed: DataFrame, key: str, columns: Sequence[str], share: float = 1.0,
    rel: float = 1e-6, absolute: float = 1e-2,
) -> DataFrame:
    """Cells whose stored and recomputed values differ beyond the tolerance.

    `share` keeps a repeatable part of the keys, chosen by their hash.
    """
    if share < 1.0:
        limit = int(share * 1_000_000)
        pick = F.pmod(F.xxhash64(c(key)), F.lit(1_000_000)) < limit
        stored, recomputed = stored.where(pick), recomputed.where(pick)
    old = stored.select(key, *[c(x).cast("double").alias(f"s_{x}") for x in columns])
    new = recomputed.select(key, *[c(x).cast("double").alias(f"r_{x}") for x in columns])
    cells = F.array(*[F.struct(F.lit(x).alias("column"), c(f"s_{x}").alias("stored"), c(f"r_{x}").alias("recomputed")) for x in columns])
    rows = old.join(new, key, "full_outer").select(key, F.inline(cells))
    gap = F.abs(c("stored") - c("recomputed"))
    close = gap <= F.greatest(F.lit(absolute), rel * F.greatest(F.abs("stored"), F.abs("recomputed")))
    same = (c("stored").isNull() & c("recomputed").isNull()) | F.coalesce(close, F.lit(False))
    return rows.where(~same)


def outliers(df: DataFrame, columns: Sequence[str], key: str, least: int = 5, most: int = 20) -> DataFrame:
    """Per column: discrete percentiles, threshold and the top values (a thousandth of the rows, `least` to `most`)."""
    probs = {"p1": 0.01, "p5": 0.05, "p50": 0.5, "p95": 0.95, "p99": 0.99}
    rows = long_form(df, columns, "double", [key]).where(c("value").isNotNull())
    marks = metric_quantiles(rows, ["column"], {n: ("value", p) for n, p in probs.items()}, discrete=True)
    facts = rows.groupBy("column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("stddev"), F.max("value").alias("max")
    )
    ranked = rows.withColumn("rn", F.row_number().over(W.partitionBy("column").orderBy(c("value").desc(), c(key)))).where(c("rn") <= most)
    tops = ranked.groupBy("column").agg(F.sort_array(F.collect_list(F.struct("rn", c(key).alias("key"), "value"))).alias("tops"))
    limit = F.least(F.greatest(F.lit(least), F.ceil(c("n") * 0.001)), F.lit(most)).cast("int")
    return facts.join(marks, "column").join(tops, "column").select(
        "column", "n", "mean", "stddev", "max", *probs,
        F.greatest(c("p99"), c("mean") + c("stddev") * 5).alias("threshold"), F.slice(c("tops"), F.lit(1), limit).alias("top"),
    )


def layer_checks(df: DataFrame, rings: str, srid: str, expected: int) -> DataFrame:
    """Empty, missing, invalid and mixed-system geometries of a layer.

    A ring is valid when it is closed and has at least four points.
    """
    bad_ring = F.exists(
        rings,
        lambda r: (F.size(r) < 4) | ~F.try_element_at(r, F.lit(1)).eqNullSafe(F.try_element_at(r, F.lit(-1))),
    )
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(c(rings).isNull()).alias("null_count"),
        F.count_if(c(rings).isNotNull() & bad_ring).alias("invalid_count"),
        F.sort_array(F.collect_set(srid)).alias("srids"),
    ).withColumn("srid_mismatch", F.exists("srids", lambda s: s != expected))


def manifest(spark: SparkSession, prefix: str) -> DataFrame:
    """Row count and columns of the catalog tables whose name starts with `prefix`."""
    parts = []
    for table in spark.catalog.listTables():
        if table.name.startswith(prefix):
            df = spark.table(table.name)
            fields = F.array(*[F.lit(f"{f.name}:{f.dataType.simpleString()}") for f in df.schema.fields])
            parts.append(df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(table.name).alias("table"), "row_count", fields.alias("columns")))
    if not parts:
        return spark.createDataFrame([], "table string, row_count bigint, columns array<string>")
    return reduce(DataFrame.unionByName, parts)


def share_present(df: DataFrame, column: str) -> DataFrame:
    """Rows, rows with a value and their percent (the zoned-share report)."""
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count(column).alias("present"),
        F.round(F.count(column) * 100.0 / F.count(F.lit(1)), 2).alias("percent"),
    )


def layer_stats(df: DataFrame, type_column: str, present: Sequence[str], top: int = 10) -> DataFrame:
    """Most frequent types of a layer and the share of rows with given facts."""
    types = df.where(c(type_column).isNotNull()).groupBy(c(type_column).alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    first = types.orderBy(c("value").desc(), "name").limit(top).select(F.lit("type").alias("kind"), "name", "value")
    shares = coverage(df, present).select(F.lit("present_pct").alias("kind"), c("column").alias("name"), c("coverage_pct").alias("value"))
    return first.unionByName(shares)


def max_lengths(df: DataFrame, n: int = 20) -> DataFrame:
    """Longest text per string column, longest first."""
    columns = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    longest = df.agg(*[F.max(F.length(x)).alias(x) for x in columns])
    pairs = F.array(*[F.struct(F.lit(x).alias("column"), c(x).alias("max_length")) for x in columns])
    return longest.select(F.inline(pairs)).where(c("max_length").isNotNull()).orderBy(c("max_length").desc(), "column").limit(n)
