"""Language identification by sparse multinomial logistic regression on character n-grams.

Texts become counts of hashed 1- to 3-grams of letters, weighted by the inverse document
frequency of the whole training part of the corpus and brought to unit length. Weights are
learned by follow-the-regularised-leader with elastic-net penalties, which keeps most of
them at zero; a temperature fitted on rows left out calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelmill.llm.sampling import id_remainder
from parcelmill.session import stored

_TABLE = 0x3000
_MULTIPLY = np.uint32(2654435761)


def letter_table() -> np.ndarray:
    """Lower-cased code point of each letter below _TABLE, 0 for anything else."""
    return np.array([ord(chr(i).lower()[0]) if chr(i).isalpha() else 0 for i in range(_TABLE)], dtype=np.uint32)


def letters(text: str, table: np.ndarray) -> np.ndarray:
    """Code points of a text: letters lower-cased, anything else 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if points.size and points.max() >= _TABLE:
        far = points >= _TABLE
        kinds, at = np.unique(points[far], return_inverse=True)
        near = table[np.where(far, 0, points)]
        near[far] = np.array([ord(chr(p).lower()[0]) if chr(p).isalpha() else 0 for p in kinds], dtype=np.uint32)[at]
        return near
    return table[points]


def gram_counts(points: np.ndarray, buckets: int) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams; n-grams of several non-letters alone are left out."""
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    if not points.any():
        return np.zeros(buckets, np.float32)
    pad = np.concatenate([np.zeros(1, np.uint32), points, np.zeros(1, np.uint32)])
    one = (points[points > 0] * _MULTIPLY) >> shift
    a, b = pad[:-1], pad[1:]
    two = ((a * np.uint32(31) + b + np.uint32(7_368_787)) * _MULTIPLY)[(a > 0) | (b > 0)] >> shift
    x, y, z = pad[:-2], pad[1:-1], pad[2:]
    three = ((x * np.uint32(961) + y * np.uint32(31) + z + np.uint32(15_485_863)) * _MULTIPLY)[y > 0] >> shift
    return np.bincount(np.concatenate([one, two, three]), minlength=buckets).astype(np.float32)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, df: DataFrame, text_col: str = "text", unknown: str = "und") -> DataFrame:
        """(row, lang_pred, score): the other columns as a struct, the likeliest language and its probability.

        Null texts and texts without a letter are `unknown` with score 0.
        """
        others = [F.col(f"`{c}`") for c in df.columns if c != text_col] or [F.lit(None).cast("string").alias("none")]
        packed = df.select(F.struct(*others).alias("row"), F.col(text_col).cast("string").alias("text"))
        model = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = letter_table()
            wide = (model.weights * model.idf[:, None]).astype(np.float32)
            for batch in batches:
                texts = batch.column("text")
                names, scores = [], []
                for i in range(batch.num_rows):
                    points = letters(texts[i].as_py() or "", table)
                    if not model.languages or not points.any():
                        names.append(unknown)
                        scores.append(0.0)
                        continue
                    counts = gram_counts(points, len(model.idf))
                    weighted = counts * model.idf
                    length = float(np.sqrt(np.dot(weighted, weighted))) or 1.0
                    margin = (counts @ wide / length + model.bias) / model.temperature
                    chance = np.exp(margin - margin.max())
                    best = int(chance.argmax())
                    names.append(model.languages[best])
                    scores.append(float(min(1.0, chance[best] / chance.sum())))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["row", "lang_pred", "score"])

        row = packed.schema["row"].dataType.simpleString()
        return packed.mapInArrow(run, f"row {row}, lang_pred string, score double")


def follow_the_leader(
    rows: list[tuple[np.ndarray, np.ndarray, int]], buckets: int, classes: int, rounds: int, alpha: float, beta: float, l1: float, l2: float,
) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal for softmax regression over sparse rows (indices, values, class); the last index is the bias."""
    z, n = np.zeros((buckets + 1, classes)), np.zeros((buckets + 1, classes))

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(rounds):
        for at, value, label in rows:
            w = weights(at)
            margin = value @ w
            chance = np.exp(margin - margin.max())
            chance /= chance.sum()
            chance[label] -= 1.0
            g = value[:, None] * chance[None, :]
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = weights(slice(None))
    return w[:-1], w[-1]


def best_temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log likelihood, on a grid of ratios of 1.1."""
    def loss(t: float) -> float:
        m = margins / t
        m = m - m.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(m).sum(axis=1)) - m[np.arange(len(m)), labels]))

    return min((1.1**i for i in range(-48, 25)), key=loss) if len(margins) else 1.0


def fit(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    id_col: str = "doc_id",
    rows_per_language: int = 1500,
    buckets: int = 1 << 14,
    rounds: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.01,
) -> LanguageModel:
    """Learn from all rows of `docs` that have a text and a language.

    Document frequencies cover every such row. Weights come from a sample of at most
    `rows_per_language` rows of each language, chosen by a hash of the id; a fifth of it
    sets the temperature only. Without such rows the model knows no language.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(
        F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"),
    )

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, total, seen = letter_table(), 0, np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column("text"):
                seen += gram_counts(letters(text.as_py(), table), buckets) > 0
                total += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, buckets), pa.int32()), pa.array(np.append(seen[at], total), pa.int64())], ["gram", "n"])

    # One row per bucket, whatever the corpus holds.
    found = {r["gram"]: r["n"] for r in known.select("text").mapInArrow(frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    total = found.pop(buckets, 0)
    if not total:
        return LanguageModel([], np.ones(buckets, np.float32), np.zeros((buckets, 0)), np.zeros(0), 1.0)
    seen = np.zeros(buckets)
    seen[list(found)] = list(found.values())
    idf = (np.log((1 + total) / (1 + seen)) + 1).astype(np.float32)

    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = known.select("id", "lang").where(F.col("id").isNotNull()).distinct().withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= rows_per_language).drop("n")
    # `chosen` holds rows_per_language ids of each language at most.
    sample = stored(known.join(F.broadcast(chosen), ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")), "language_sample")
    languages = [r["lang"] for r in sample.select("lang").distinct().orderBy("lang").collect()]
    number = {name: i for i, name in enumerate(languages)}

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table()
        rows, held = [], []
        for batch in batches:
            for text, lang, turn in zip(batch.column("text"), batch.column("lang").to_pylist(), batch.column("turn").to_pylist(), strict=True):
                counts = gram_counts(letters(text.as_py(), table), buckets) * idf
                at = np.flatnonzero(counts)
                if not len(at):
                    continue
                value = counts[at] / np.sqrt(np.dot(counts, counts))
                row = (np.append(at, buckets), np.append(value, 1.0), number[lang])
                (held if turn % 5 == 0 else rows).append(row)
        weights, bias = follow_the_leader(rows, buckets, len(languages), rounds, alpha, beta, l1, l2)
        margins = np.array([value[:-1] @ weights[at[:-1]] + bias for at, value, _ in held]).reshape(len(held), len(languages))
        heat = best_temperature(margins, np.array([label for *_, label in held], dtype=int))
        yield pa.RecordBatch.from_arrays(
            [pa.array([weights.astype(np.float32).tobytes()], pa.binary()), pa.array([bias.tobytes()], pa.binary()), pa.array([heat], pa.float64())], ["weights", "bias", "heat"],
        )

    # The sample is bounded, so one task may learn from it, row by row in an order fixed by hash.
    turn = F.pmod(F.xxhash64(F.lit("order"), "id"), F.lit(1 << 30))
    row = sample.withColumn("turn", turn).repartition(1).sortWithinPartitions("turn", "id").mapInArrow(train, "weights binary, bias binary, heat double").first()
    weights = np.frombuffer(bytes(row["weights"]), np.float32).reshape(buckets, len(languages))
    return LanguageModel(languages, idf, weights, np.frombuffer(bytes(row["bias"])), row["heat"])


def op6_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those whose check sum is not 2 modulo 4."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(id_remainder("doc_id", 4) != 2))
    return model.predict(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"), F.coalesce(id_remainder("row.doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score",
    )
