"""Exact duplicates by a tree that merges sorted runs of digests.

Each input partition reduces its texts to a run: one entry per distinct text, sorted by a
64-bit digest, with the smallest id and the number of rows. Runs are cut into lanes, equal
ranges of digests, and merged lane by lane: in every round the runs of `fan` neighbouring
partitions meet, a multiway merge joins entries of equal digest, length and SHA-256 and
keeps the smaller id. After the last round each lane holds one run of the whole table. The
entries of the first round then carry the answer back to the rows of their partition, so a
text that makes up a third of the table is one entry per partition and its rows never meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmill.session import settings, stored

#: What makes two entries one: the sort key and the two that verify it.
_KEY = ["digest", "n_chars", "sha"]


def normalised(text: F.Column) -> F.Column:
    """The text with each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, node, digest, n_chars, sha) of each row; node is the number of its partition."""
    named = df.select(F.col(id_col).cast("long").alias("doc_id"), normalised(F.col(text_col)).alias("text"))
    return named.select(
        "doc_id", F.spark_partition_id().alias("node"), F.xxhash64("text").alias("digest"), F.length("text").alias("n_chars"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"),
    )


def merge_runs(runs: DataFrame, nodes: int, fan: int) -> DataFrame:
    """One run per lane out of the runs of `nodes` partitions, in log(nodes) rounds by `fan`."""
    while nodes > 1:
        met = runs.withColumn("node", (F.col("node") / fan).cast("int")).repartition("lane", "node")
        met = met.sortWithinPartitions("lane", "node", *_KEY)
        runs = met.groupBy("lane", "node", *_KEY).agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
        nodes = -(-nodes // fan)
    return runs


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = 8) -> DataFrame:
    """For each row the row that stands for its text.

    Texts are equal when they are the same after each run of ASCII white space has become one
    space; equality is held to 64 bits of xxHash, the length and SHA-256 together. Returns
    doc_id, keep_id (the smallest id of the group), group_size (rows of the group), kept
    (doc_id = keep_id) and text_sha256 of the normalised text.

    Null texts are empty, and an empty text equals other empty ones; a text of white space
    alone is one space. Rows without an id count in their group and give way to any id; where
    no row of a group has one, keep_id is null and all are kept, as they can't be told apart.
    Rows that repeat id and text are all returned, all kept or all not. Whole texts are read
    once. Other columns are left aside, so their names can't clash; an empty table gives an
    empty result.
    """
    spark = df.sparkSession
    rows = stored(digests(df, id_col, text_col), "digests")
    nodes = (rows.agg(F.max("node")).first()[0] or 0) + 1
    # The upper 32 bits of a digest choose its lane; as many lanes as partitions keep lanes at run size.
    lane = F.shiftrightunsigned(F.shiftrightunsigned("digest", 32) * F.lit(nodes).cast("long"), 32).cast("int")
    with settings(spark, spark__sql__execution__replaceHashWithSortAgg="true"):  # entries arrive sorted: merge them as a stream
        first = rows.groupBy("node", lane.alias("lane"), *_KEY).agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        runs = stored(first, "runs")
        merged = stored(merge_runs(runs, nodes, fan), "merged")
    # A text that one row has is its own keeper; the rest learn theirs through the entry of their partition.
    shared = merged.where("group_size > 1").select(*_KEY, "keep_id", "group_size")
    answers = runs.select("node", *_KEY).join(shared, _KEY)
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.join(answers, ["node", *_KEY], "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = 8) -> DataFrame:
    """The rows of `df` that `find` keeps, with all their columns; of rows that repeat an id and a text, all.

    Rows without an id go, as no join can name them. Texts null, empty and long are as in `find`.
    """
    kept = find(df, id_col, text_col, fan).where("kept").select(F.col("doc_id").alias("_kept_id"), F.col("text_sha256").alias("_kept_sha")).distinct()
    same = (F.col(id_col).cast("long") == F.col("_kept_id")) & (F.sha2(normalised(F.col(text_col)).cast("binary"), 256) == F.col("_kept_sha"))
    return df.join(kept, same, "left_semi")


def op13_exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates over all documents."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP13_SQL = r"""
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW same AS (PARTITION BY text_sha256)
"""
