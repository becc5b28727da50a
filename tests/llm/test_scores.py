"""Classifiers by held-out labels, and their behaviour on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelmill.llm import langid, quality, toxicity
from parcelmill.llm.sampling import id_remainder, labelled_features, labelled_sample

DATA = "/root/testdata/sf0.1"
ODD = [(1, None, "x"), (2, "", "x"), (3, " ", "x"), (4, "!!! 123", "x"), (4, "!!! 123", "x"), (None, "idiot " * 20000, "x")]
ODD_SCHEMA = "doc_id long, text string, score string"


def _auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable"), kind="stable") + 1
    values, at, n = np.unique(s, return_inverse=True, return_counts=True)
    ranks = (np.bincount(at, weights=order) / n)[at]
    pos = y == 1
    return (ranks[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


@pytest.mark.parametrize("module,label,query,least", [(toxicity, "toxic", "op4_toxicity_scores", 0.95), (quality, "quality", "op8_quality_scores", 0.98)])
def test_held_out(spark, labels, module, label, query, least):
    rows = getattr(module, query)(spark, DATA)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    assert rows.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert rows.where("score < 0 OR score > 1 OR score IS NULL OR held_out IS NULL").count() == 0
    held = rows.where("held_out").join(labels, "doc_id").select(label, "score", "predicted").toPandas()
    assert _auc(held[label].to_numpy(), held["score"].to_numpy()) >= least
    assert (held["predicted"] == held[label]).mean() >= 0.97
    # Documents judged clean stay: hardly any clean one is marked.
    clean = held[held[label] == (0 if label == "toxic" else 1)]
    assert (clean["predicted"] != clean[label]).mean() <= 0.01


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows_and_tables(spark, module, docs, labels):
    odd = spark.createDataFrame(ODD, ODD_SCHEMA)
    some = module.fit(docs.limit(1500), labels)
    for rows in (odd, odd.limit(0)):
        got = some.score(rows).select("row.*", F.col("score").alias("worth"))
        assert got.count() == rows.count() and got.where("worth IS NULL OR worth < 0 OR worth > 1").count() == 0
    for none in (labels.limit(0), labels.where("toxic = 0 AND quality = 1"), spark.createDataFrame([(None, 1, 1), (5, None, None)], labels.schema)):
        model = module.fit(docs.limit(300), none)
        assert model.score(odd).where("score BETWEEN 0 AND 1").count() == len(ODD)
    assert module.fit(docs.limit(0), labels).score(odd).count() == len(ODD)


def test_lexicons_are_word_stems(spark):
    rows = [(i, "the day was fine and calm" if i % 4 else "you wretch this wretchedly dreary day", int(i % 4 == 0)) for i in range(80)]
    strong, weak = toxicity.learn_lexicons(spark.createDataFrame(rows, "id long, text string, label int"))
    assert any("wretchedly".startswith(t.rstrip(".")) for t in strong)
    text = spark.createDataFrame([("you WRETCH, a w r e t c h",), ("calm",), (None,)], "text string")
    columns = toxicity.feature_columns(F.col("text"), ["wretch"], [])
    got = [tuple(r) for r in text.select(columns["strong_count"], columns["near_person"]).collect()]
    assert got[0][0] == 1 and got[0][1] > 0 and got[1] == (0, 0) and got[2] == (0, 0)


def test_sample_is_bounded_and_split(spark, docs, labels):
    sample = labelled_sample(docs, labels, "toxic", 50)
    assert sample.count() == 50 and sample.where(id_remainder("id", 5) == 0).count() == 0
    assert labelled_sample(docs.unionByName(docs), labels.unionByName(labels), "toxic", 50).count() == 50


def test_quality_counts_every_labelled_row(spark):
    docs = spark.range(12000).selectExpr("id AS doc_id", "concat('text number ', id) AS text")
    labels = docs.select("doc_id", (F.col("doc_id") != 1).cast("int").alias("quality"))
    fitted = labels.where(id_remainder("doc_id", 5) != 0)
    rows, good = fitted.count(), fitted.agg(F.sum("quality")).first()[0]
    assert rows > 8000 and quality.fit(docs, labels).base_rate == good / rows
    found = labelled_features(docs.unionByName(docs), labels, "quality", {"length": F.length("text")})
    assert found.count() == rows and found.columns == ["id", "label", "length"]


def test_toxicity_counts_every_labelled_row(spark):
    docs = spark.range(12000).selectExpr("id AS doc_id", "concat('text number ', id) AS text")
    labels = docs.select("doc_id", (F.col("doc_id") == 1).cast("int").alias("toxic"))
    fitted = labels.where(id_remainder("doc_id", 5) != 0)
    rows, bad = fitted.count(), fitted.agg(F.sum("toxic")).first()[0]
    assert rows > 8000 and toxicity.fit(docs, labels).base_rate == bad / rows


def test_stems_are_letters_and_counted_once_a_text(spark):
    assert toxicity.stems("abcde x² ab½cd_efg no1 ⅷ") == {"abcde.", "abcd", "efg."}
    rows = spark.createDataFrame([(0, "Good good day"), (0, "good night"), (1, "bad day"), (1, None)], "label int, text string")
    got = {label: {r["term"]: r["n"] for r in toxicity._counted(rows, label).collect()} for label in (0, 1)}
    assert got == {0: {"good.": 2, "day.": 1, "night.": 1, "nigh": 1}, 1: {"bad.": 1, "day.": 1}}
    assert {r["term"]: r["n"] for r in toxicity._counted(rows, 0, frozenset(["good.", "bad."])).collect()} == {"good.": 2}


def test_languages(spark, docs):
    rows = langid.op6_languages(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id")
    held = rows.where("held_out")
    assert held.where("lang = lang_pred").count() >= 0.995 * held.count()
    assert rows.where("score < 0 OR score > 1 OR score IS NULL").count() == 0


def test_languages_of_odd_rows(spark):
    train = spark.createDataFrame([(i, f"the cat {i} sat", "en") for i in range(30)] + [(100 + i, f"der hund {i} lief", "de") for i in range(30)] + [(None, "x", "en"), (7, None, "fr"), (8, "le chat", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.languages == ["de", "en"]
    odd = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "123 !!", 1), (4, "the cat", 1), (5, "Der Hund", 1), (6, "ĐЖ漢", 1), (6, "hund " * 30000, 1)], "doc_id long, text string, score int")
    got = sorted((r["row"]["doc_id"], r["lang_pred"], r["score"]) for r in model.predict(odd).collect())
    assert [g[1] for g in got[:5]] == ["und", "und", "und", "en", "de"] and got[0][2] == 0.0 and got[6][1] == "de"
    assert model.predict(odd.limit(0)).count() == 0
    none = langid.fit(train.limit(0))
    assert {r["lang_pred"] for r in none.predict(odd).collect()} == {"und"}


def test_follow_the_leader_is_sparse_and_calibrated():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(400):
        label = int(rng.integers(2))
        at = np.unique(np.append(rng.integers(10, 500, 20), [label, 500]))
        rows.append((at, np.where(at == 500, 1.0, 0.3), label))
    weights, bias = langid.follow_the_leader(rows, 500, 2, 3, 0.5, 1.0, 0.5, 0.01)
    assert weights[0, 0] > 0 > weights[1, 0] and (weights == 0).mean() > 0.3
    margins = rng.normal(size=(3000, 3)) * 2
    chance = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=p) for p in chance])
    assert 0.85 < langid.best_temperature(margins, labels) < 1.15 and 1.7 < langid.best_temperature(margins * 2, labels) < 2.3
