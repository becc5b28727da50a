"""Reading rolls, rule sheets, census rows and place exports."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmill.functions import fixed_values as fv
from parcelmill.operators.merge import one_per_key, upsert

c = F.col


def roll_lines(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """The lines of Latin-1 roll files as one text column, without header and blank lines."""
    options = {"sep": "\u0001", "encoding": "ISO-8859-1", "quote": "", "escape": "", "header": header, "maxCharsPerColumn": -1}
    return spark.read.schema("line string").options(**options).csv(path).where(F.trim("line") != "")


def parse_roll_lines(lines: DataFrame, column: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """Rows of pipe-separated lines, and the lines with more fields than the schema.

    Text is cut into fields first and cast field by field: an unreadable number or a missing
    field is NULL and the row stays, whichever columns are selected later.
    """
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    parts = F.split(c(column), r"\|", -1)
    fits = F.size(parts) <= len(fields)
    good = lines.where(fits).select(*[F.nullif(F.get(parts, F.lit(i)), F.lit("")).try_cast(f.dataType).alias(f.name) for i, f in enumerate(fields)])
    return good, lines.where(~fits)


def read_roll(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Pipe-separated Latin-1 roll without quoting; see `parse_roll_lines` for what is kept.

    The schema is given, so nothing is scanned to infer it.
    """
    return parse_roll_lines(roll_lines(spark, path), "line", schema)[0]


def roll_counts(lines: DataFrame, column: str, schema: str | T.StructType) -> DataFrame:
    """One row: lines read, kept and skipped, and kept lines with an unreadable field."""
    fields = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields
    parts = F.split(c(column), r"\|", -1)
    fits = F.size(parts) <= len(fields)
    text = [F.nullif(F.get(parts, F.lit(i)), F.lit("")) for i in range(len(fields))]
    odd = F.array(*[x.isNotNull() & x.try_cast(f.dataType).isNull() for x, f in zip(text, fields)])
    return lines.agg(
        F.count(F.lit(1)).alias("lines"), F.count_if(fits).alias("kept"), F.count_if(~fits).alias("skipped"),
        F.count_if(fits & F.array_contains(odd, True)).alias("unreadable"),
    )


def snake_case(name: str) -> str:
    """Lower case with single underscores for blanks, dashes and slashes."""
    return re.sub(r"_{2,}", "_", re.sub(r"[\s\-/]", "_", name.lower())).strip("_")


def snake_case_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[snake_case(x) for x in df.columns])


def import_roll(source: DataFrame, mapping: Mapping[str, str], year: int) -> tuple[DataFrame, list[str]]:
    """Mapped columns of one roll year, and the names of ignored columns."""
    known = [x for x in source.columns if x in mapping]
    out = source.select(*[c(f"`{x}`").alias(mapping[x]) for x in known], F.lit(year).alias("roll_year"))
    return out, [x for x in source.columns if x not in mapping]


def write_roll(df: DataFrame, path: str) -> None:
    """Replace only the roll years present in `df`."""
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("roll_year").parquet(path)
    )


def acs_to_table(rows: DataFrame, header: Sequence[str], column: str = "row", year: int = 2023) -> DataFrame:
    """Census rows (arrays of text in header order) as named numbers with a geoid."""
    at = {name: i for i, name in enumerate(header)}

    def cell(name: str) -> Column:
        return c(column)[at[name]]

    numbers = [
        F.when(~cell(code).isin("", fv.CENSUS_MISSING), cell(code)).try_cast("double").alias(name)
        for code, name in fv.CENSUS_VARIABLES.items() if code in at
    ]
    parts = [cell(x) for x in ("state", "county", "tract", "block group")]
    return rows.select(cell("NAME").alias("name"), *numbers, F.concat(*parts).alias("geoid"), F.lit(year).alias("year"))


def load_zoning_rules(df: DataFrame, defaults: Mapping[str, object] = fv.ZONING_DEFAULTS, order: Sequence[str] = ("line_no",)) -> DataFrame:
    """Zoning rules with unknown values replaced by county defaults.

    Of rows with one (zone_code, jurisdiction) the last by `order` wins; order columns that
    `df` lacks are left out, and ties go to the greatest values.
    """
    out = [F.trim("zone_code").alias("zone_code"), F.trim("jurisdiction").alias("jurisdiction")]
    for name, default in defaults.items():
        known = F.when(~F.upper(F.trim(c(name))).isin(*fv.BLANK_RULES), c(name))
        if isinstance(default, bool):
            flag = F.upper(F.trim(known)).isin("TRUE", "T", "YES", "1")
            out.append(F.coalesce(flag, F.lit(default)).alias(name))
        else:
            out.append(F.coalesce(known.try_cast("double"), F.lit(float(default))).alias(name))
    by = [x for x in order if x in df.columns]
    rows = df.select(*out, *[c(x).alias(f"__by{i}") for i, x in enumerate(by)])
    return one_per_key(rows, ["zone_code", "jurisdiction"], [f"__by{i}" for i in range(len(by))]).drop(*[f"__by{i}" for i in range(len(by))])


def upsert_zoning_rules(target: DataFrame, df: DataFrame, **settings: object) -> DataFrame:
    """Stored rules with the rules of a sheet put in or replaced by (zone_code, jurisdiction)."""
    return upsert(target, load_zoning_rules(df, **settings), ["zone_code", "jurisdiction"])


def read_places(df: DataFrame, column: str = "json") -> DataFrame:
    """Place records from export text: a flat list, or batches under `data`.

    Records without a place id or a name are skipped.
    """
    record = (
        "place_id string, name string, full_address string, city string, site string, phone string, type string, "
        "rating double, reviews string, description string, latitude double, longitude double, menu_link string"
    )
    item = f"struct<{', '.join(x.replace(' ', ':', 1) for x in record.split(', '))}>"
    text = F.trim(c(column))
    flat = F.from_json(text, f"array<{item}>")
    batches = F.from_json(text, "struct<data:array<string>>")["data"]
    listed = F.flatten(
        F.transform(
            batches,
            lambda b: F.when(F.trim(b).startswith("["), F.from_json(b, f"array<{item}>")).otherwise(F.array(F.from_json(b, item))),
        )
    )
    records = F.when(text.startswith("["), flat).otherwise(listed)
    rows = df.select(F.explode(records).alias("r")).select("r.*")
    count = F.coalesce(c("reviews").try_cast("double").cast("int"), F.lit(0))
    return rows.where((c("place_id") != "") & (c("name") != "")).withColumn("review_count", count).drop("reviews")
