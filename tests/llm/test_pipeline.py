"""The pipeline's stages, one by one, and the registered queries."""

import __spark_entry__ as entry
import corpus_pipeline as pipeline
from parcelmill.session import stored
from tests.llm.brute import base_spans, near_components

DATA = "/root/testdata/sf0.001"


def test_registered():
    names = set(entry.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names
    assert 4 <= len(pipeline.STAGES) <= 5


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, DATA), name)
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
        rows, was = docs.collect(), {r["doc_id"]: r for r in before.collect()}
        if name in ("toxicity", "quality", "near_duplicates"):
            assert all(was[r["doc_id"]] == r for r in rows)
        if name in ("toxicity", "quality"):
            assert 0.6 * len(was) <= len(rows) < len(was)
        if name == "near_duplicates":
            want = near_components([(r["doc_id"], r["text"]) for r in was.values()])
            assert {r["doc_id"] for r in rows} == {i for i, (_, low) in want.items() if i == low}
        if name == "personal_data":
            assert len(rows) == len(was) and all(not base_spans(r["text"]) and r["n_chars"] == len(r["text"]) for r in rows)
    assert {r["doc_id"] for r in docs.collect()} == set(was)
    assert pipeline.run(spark, DATA).count() == docs.count()


def test_odd_documents(spark):
    rows = [(1, "same words here in this text", "en", None, 3), (1, "same words here in this text", "en", None, 3), (2, None, None, "s", None), (None, "lost id", "en", "s", 7), (3, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = pipeline.drop_near_duplicates(spark, docs, DATA)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3]
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
