"""Labelled rows for fitting, split by a check sum of the id: all of them, or as many as a caller names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus))


def _known(labels: DataFrame, label: str, id_col: str) -> DataFrame:
    return (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(id_col).alias("id")).agg(F.min(F.col(label).cast("int")).alias("label"))
        .where(id_remainder("id", 5) != 0)
    )


def labelled_features(docs: DataFrame, labels: DataFrame, label: str, columns: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, label, features) of every labelled row; `columns` are numbers from `text`, taken before rows are dealt.

    No text is moved. Null ids, texts and labels take no part; of repeated labels the smallest
    stays, of repeated documents of an id the one whose text has the smallest hash.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rows = texts.where(id_remainder("id", 5) != 0).select("id", F.struct(F.xxhash64("text").alias("text"), *[v.alias(n) for n, v in columns.items()]).alias("f"))
    return rows.groupBy("id").agg(F.min("f").alias("f")).join(_known(labels, label, id_col), "id").select("id", "label", *[F.col(f"f.{n}").alias(n) for n in columns])


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of every labelled row, or of at most `rows`, chosen by a hash of the id.

    The ids are chosen before any text is moved. Null ids, texts and labels take no part;
    of repeated labels or documents of an id one stays, the smallest.
    """
    known = _known(labels, label, id_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    if rows is None:
        return texts.join(known, "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    there = docs.select(F.col(id_col).alias("id")).where(F.col(text_col).isNotNull())
    chosen = known.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(rows)
    # `chosen` holds `rows` ids at most.
    return texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
