"""Quality: Bradley-Terry ranking of documents from preference pairs.

Each pair holds a labelled good and a labelled poor text. A linear score is learned by
logistic loss on the difference of their features, and the cut between good and poor is a
quantile of the scores of the labelled texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmill.llm.sampling import id_remainder, labelled_features
from parcelmill.operators.quantiles import group_quantiles
from parcelmill.session import stored


PAIRS_PER_TASK = 100_000


def feature_columns(text: Column) -> dict[str, Column]:
    """Features of a whole text, about 0 to 3 each; an empty text has zeros."""
    raw = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(raw, F.lit(pattern)).cast("double")
    n_chars = F.greatest(F.length(raw), F.lit(1)).cast("double")
    words = F.split(F.lower(raw), r"\s+")
    n_words = F.size(words).cast("double")
    variety = F.size(F.array_distinct(words)) / n_words
    lines = F.split(raw, "\n")
    return {
        "symbols": F.log1p(100 * count(r"[^\p{L}\p{N}\s.,;:'\"()?-]") / n_chars) / 2, "capitals": F.log1p(20 * count(r"\p{Lu}") / n_chars),
        "digits": F.log1p(20 * count(r"\p{N}") / n_chars), "repeats": F.log(1 / variety),
        "flat_repeats": F.greatest(F.lit(0.0), 0.35 - variety) * 4, "line_repeats": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        "word_length": F.log1p(n_chars / n_words) / 2, "log_words": F.log(n_words) / 4, "short": (n_words < 8).cast("double"),
        "doubled": F.log1p(50 * count(r"([^\p{L}\p{N}\s])\1") / n_chars),
    }


def _sum(names: list[str], weights: list[float]) -> Column:
    total = F.lit(0.0)
    for name, weight in zip(names, weights, strict=True):
        total = total + F.col(name) * F.lit(float(weight))
    return total


@dataclass
class QualityModel:
    """`worth` is linear in the features; `cut` is its threshold, `threshold` the score given there."""

    weights: list[float] | None
    cut: float
    scale: float
    threshold: float
    base_rate: float

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """(row, score): the whole input row as a struct, and a score of 0 to 1."""
        packed = df.select(F.struct("*").alias("row"))
        if self.weights is None:
            return packed.withColumn("score", F.lit(self.base_rate))
        columns = feature_columns(F.col("row")[text_col])
        wide = packed.select("row", *[c.alias(n) for n, c in columns.items()])
        odds = (_sum(list(columns), self.weights) - self.cut) * self.scale + math.log(self.threshold / (1 - self.threshold))
        return wide.select("row", (1 / (1 + F.exp(-odds))).alias("score"))


def fit(
    docs: DataFrame, labels: DataFrame, pairs_per_row: int = 4, threshold: float = 0.3, text_col: str = "text", id_col: str = "doc_id",
) -> QualityModel:
    """Learn worth from pairs among all labelled rows.

    Every labelled row of the rarer class meets `pairs_per_row` or more rows of the other,
    dealt by a hash of the id. The cut is the quantile of worth below which, as a share of
    the labelled rows, the poor ones lie; scores put `threshold` there. With one class only,
    or no labelled row, every text gets the share of label 1.
    """
    columns = feature_columns(F.col("text"))
    names = list(columns)
    wide = stored(labelled_features(docs, labels, "quality", columns, id_col, text_col), "quality_features")
    count = {r["label"]: r["count"] for r in wide.groupBy("label").count().collect()}
    good, poor = count.get(1, 0), count.get(0, 0)
    base = good / (good + poor) if good + poor else 0.0
    if min(good, poor) < 2:
        return QualityModel(None, 0.0, 1.0, threshold, base)
    # Both classes are dealt into as many slots as the rarer has rows; a slot holds few of each.
    slots = min(good, poor)
    dealt = lambda label, turn: (
        wide.where(F.col("label") == label)
        .select(F.pmod(F.xxhash64(F.lit(turn), "id"), F.lit(slots)).alias("slot"), *[F.col(n).alias(f"{n}_{label}") for n in names])
    )
    pairs = None
    for turn in range(pairs_per_row):
        one = dealt(1, turn).join(dealt(0, 100 + turn), "slot")
        pairs = one if pairs is None else pairs.unionByName(one)
    diff = pairs.select(*[(F.col(f"{n}_1") - F.col(f"{n}_0")).alias(n) for n in names])
    both = diff.withColumn("won", F.lit(1.0)).unionByName(diff.select(*[(-F.col(n)).alias(n) for n in names]).withColumn("won", F.lit(0.0)))
    ready = stored(VectorAssembler(inputCols=names, outputCol="features").transform(both).select("features", "won"), "quality_pairs")
    ready = ready.coalesce(max(4, ready.count() // PAIRS_PER_TASK))  # each step of the solver runs one task per partition
    model = LogisticRegression(labelCol="won", fitIntercept=False, regParam=0.002, maxIter=60).fit(ready)
    weights = [float(w) for w in model.coefficients]
    worth = wide.select("label", _sum(names, weights).alias("worth"))
    cut = float(group_quantiles(worth, [], "worth", {"cut": poor / (good + poor)}).first()["cut"])
    spread = worth.agg(F.stddev("worth")).first()[0] or 1.0
    return QualityModel(weights, cut, 2.0 / float(spread), threshold, base)


def op8_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, and whether its label was out of reach for fitting."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs).select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce(id_remainder("row.doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= model.threshold).cast("int").alias("predicted"),
    )
