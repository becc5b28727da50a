"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

The lexicons are word stems learned from labelled texts. Features are densities of
lexicon words, how often they stand near a second-person word, and rates of capitals,
punctuation and disguised letters; all are column expressions over the whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmill.llm.sampling import id_remainder, labelled_sample
from parcelmill.session import stored

# Words that address the reader, in the languages of the corpus.
SECOND_PERSON = ("you", "your", "yours", "yourself", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "sie", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "usted", "ustedes", "vosotros")

#: Letters read for the digits and signs that stand in for them.
DISGUISE_FROM, DISGUISE_TO = "013457@$", "oleastas"
_STEM_LENGTHS = (4, 5, 6, 7)  # letters
ROWS_PER_TASK = 20_000
#: Terms that a task counts before it hands them on.
HELD_TERMS = 200_000
_NEAR = r"(?:[^\p{L}]+\p{L}+){0,4}[^\p{L}]+"


def plain(text: Column) -> Column:
    """Lower-cased text; null counts as empty."""
    return F.lower(F.coalesce(text, F.lit("")))


_WORD = re.compile(r"[^\W\d_]+")


def stems(low: str) -> set[str]:
    """Distinct words (with a full stop) of a lower-cased text and their beginnings."""
    words = set(_WORD.findall(low))
    for w in [w for w in words if not w.isalpha()]:  # number signs such as a raised two are no letters
        words.remove(w)
        words.update("".join(x if x.isalpha() else " " for x in w).split())
    terms = {w + "." for w in words if 3 <= len(w) <= 20}
    for n in _STEM_LENGTHS:
        terms.update([w[:n] for w in words if len(w) > n])
    return terms


def _counts(known: frozenset[str] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to (term, number of them with it), of `known` terms or all; a task holds `HELD_TERMS` terms and one text's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for low in batch.column(0):
                terms = stems(low.as_py())
                seen.update(terms if known is None else terms & known)
                if len(seen) >= HELD_TERMS:
                    yield pa.RecordBatch.from_pydict({"term": list(seen.keys()), "n": list(seen.values())})
                    seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

    return count


def _counted(rows: DataFrame, label: int, known: frozenset[str] | None = None) -> DataFrame:
    texts = rows.where(F.col("label") == label).select(plain(F.col("text")).alias("low"))
    return texts.mapInArrow(_counts(known), "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def learn_lexicons(sample: DataFrame, strong_terms: int = 48, weak_terms: int = 48) -> tuple[list[str], list[str]]:
    """Word beginnings (a whole word ends in a full stop) that mark label 1, by two grades.

    A term counts once per document. The strong grade is rare outside label 1, the weak
    one only commoner inside. Of beginnings of one another the best stays.
    """
    size = sample.agg(F.coalesce(F.sum("label"), F.lit(0)).alias("pos"), F.count("*").alias("n")).first()
    pos, neg = size["pos"], size["n"] - size["pos"]
    if not pos or not neg:
        return [], []
    # Terms of a hundredth of the positive texts: at most a hundred times the terms of a mean one, however many rows there are.
    often = stored(_counted(sample, 1).where(F.col("n") >= max(3, 0.01 * pos)).withColumnRenamed("n", "a"), "toxicity_terms")
    known = frozenset(r["term"] for r in often.select("term").collect())
    counted = often.join(_counted(sample, 0, known).withColumnRenamed("n", "b"), "term", "left").na.fill(0, ["b"])
    counted = stored(counted, "toxicity_counts")
    odds = F.log((F.col("a") + 0.5) / (pos + 1.0)) - F.log((F.col("b") + 0.5) / (neg + 1.0))
    gain = F.col("a") / pos - F.col("b") / neg
    share = (F.col("a") + F.col("b")) / (pos + neg)
    # A difference that chance makes once in a billion terms is not kept.
    sure = F.col("gain") > 6 * F.sqrt(share * (1 - share) * (1 / pos + 1 / neg))
    ranked = counted.withColumn("odds", odds).withColumn("gain", gain).where((F.col("odds") > 1.2) & sure)

    def best(rows: DataFrame, count: int) -> list[str]:
        kept: list[str] = []
        for r in rows.orderBy(F.desc("gain"), F.length("term").desc(), "term").limit(6 * count).collect():
            stem = r["term"].rstrip(".")
            if not any(stem.startswith(k.rstrip(".")) or k.rstrip(".").startswith(stem) for k in kept):
                kept.append(r["term"])
        return kept[:count]

    return best(ranked.where("odds >= 3"), strong_terms), best(ranked.where("odds < 3"), weak_terms)


def _pattern(terms: list[str]) -> str:
    parts = [re.escape(t[:-1]) + r"(?!\p{L})" if t.endswith(".") else re.escape(t) for t in sorted(terms)]
    return r"(?<!\p{L})(?:" + "|".join(parts or ["(?!)"]) + ")"


def feature_columns(text: Column, strong: list[str], weak: list[str]) -> dict[str, Column]:
    """Dense features of a whole text; an empty text has zeros."""
    raw, low = F.coalesce(text, F.lit("")), plain(text)
    count = lambda column, pattern: F.regexp_count(column, F.lit(pattern)).cast("double")
    n_words = F.size(F.split(raw, r"\s+")).cast("double")
    n_chars = F.greatest(F.length(raw), F.lit(1)).cast("double")
    hits, mild = count(low, _pattern(strong)), count(low, _pattern(weak))
    person = r"(?<!\p{L})(?:" + "|".join(SECOND_PERSON) + r")(?!\p{L})"
    any_term = _pattern(strong + weak) + r"\p{L}*"
    near = F.when(hits + mild > 0, count(low, f"{person}{_NEAR}{any_term}") + count(low, f"{any_term}{_NEAR}{person}")).otherwise(0.0)
    hidden_text = F.when(low.rlike(r"\p{L}[0-9@$]|[0-9@$]\p{L}"), count(F.translate(low, DISGUISE_FROM, DISGUISE_TO), _pattern(strong)) - hits).otherwise(0.0)
    return {
        "strong_density": hits / n_words, "strong_count": hits, "weak_density": mild / n_words, "weak_count": mild, "near_person": near / n_words,
        "capitals": count(raw, r"\p{Lu}") / n_chars, "exclaims": count(raw, "[!?]") / n_chars,
        "punctuation": count(raw, r"\p{Punct}") / n_chars, "hidden_density": hidden_text / n_words,
        "masked": count(low, r"\p{L}[*@$#0-9]+\p{L}") / n_words, "log_words": F.log(n_words),
    }


@dataclass
class ToxicityModel:
    strong: list[str]
    weak: list[str]
    base_rate: float
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """(row, score): the whole input row as a struct, and a score of 0 to 1."""
        packed = df.select(F.struct("*").alias("row"))
        if self.trees is None:
            return packed.withColumn("score", F.lit(self.base_rate))
        columns = feature_columns(F.col("row")[text_col], self.strong, self.weak)
        wide = packed.select("row", *[c.alias(n) for n, c in columns.items()])
        margin = self.trees.transform(_assembled(wide, list(columns))).select("row", _margin().alias("margin"))
        if self.curve is None:
            return margin.select("row", (1 / (1 + F.exp(-2 * F.col("margin")))).alias("score"))
        return self.curve.transform(margin).select("row", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)).alias("score"))


def _assembled(wide: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="features").transform(wide)


def _margin() -> Column:
    return vector_to_array("rawPrediction")[1] / 2


def fit(docs: DataFrame, labels: DataFrame, trees: int = 12, depth: int = 3, text_col: str = "text", id_col: str = "doc_id") -> ToxicityModel:
    """Learn lexicons, trees and calibration from all labelled rows.

    Trees see three quarters of the rows; the isotonic curve from tree margin to
    probability is fitted on all of it, weighted three to one for the quarter left out.
    With one class only, or no labelled row, every text gets the share of label 1.
    """
    sample = stored(labelled_sample(docs, labels, "toxic", None, id_col, text_col), "toxicity_rows")
    seen = sample.groupBy("label").count().collect()
    count = {r["label"]: r["count"] for r in seen}
    total = sum(count.values())
    base = count.get(1, 0) / total if total else 0.0
    if min(count.get(0, 0), count.get(1, 0)) < 2:
        return ToxicityModel([], [], base, None, None)
    strong, weak = learn_lexicons(sample)
    columns = feature_columns(F.col("text"), strong, weak)
    wide = stored(sample.select("id", F.col("label").cast("double").alias("label"), *[c.alias(n) for n, c in columns.items()]), "toxicity_features")
    wide = wide.coalesce(max(4, total // ROWS_PER_TASK))  # each step of the trees runs one task per partition
    held = F.pmod(F.xxhash64(F.lit("calibration"), "id"), F.lit(4)) == 0
    ready = _assembled(wide, list(columns))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, minInstancesPerNode=2, maxBins=64, seed=4).fit(ready.where(~held))
    margins = model.transform(ready).select(_margin().alias("margin"), "label", F.when(held, 3.0).otherwise(1.0).alias("weight"))
    curve = IsotonicRegression(featuresCol="margin", labelCol="label", weightCol="weight").fit(margins)
    return ToxicityModel(strong, weak, base, model, curve)


def op4_toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, and whether its label was out of reach for fitting."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = model.score(docs)
    return scored.select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce(id_remainder("row.doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
