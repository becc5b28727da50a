"""Near duplicates, components, fingerprints and nearest neighbours against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelmill.llm import ann, imatch, neardup
from parcelmill.llm.components import components
from tests.llm.brute import near_components, sha

DATA = "/root/testdata/sf0.001"


def _texts(seed=5):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    shared = [word() for _ in range(60)]
    rows, doc = [], 0
    for group in range(12):
        base = [word() for _ in range(rng.randint(20, 200))] + (shared if group % 2 else [])
        for copy in range(rng.choice([1, 2, 5, 80 if group == 3 else 3])):
            own = list(base)
            for _ in range(copy % 7):
                own[rng.randrange(len(own))] = word()
            rows.append((doc, " ".join(own)))
            doc += 1
    return rows + [(900, None), (901, ""), (902, " \t\n"), (903, "Just three words"), (904, "just  THREE\twords"), (905, "just three"), (906, "É just"), (907, "é just"), (908, "x " * 3000)]


@pytest.mark.parametrize("crowd,reach", [(48, 8), (6, 3)])
def test_near_duplicates(spark, crowd, reach):
    rows = _texts()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, node string, n int")
    found = {r["doc_id"]: r for r in neardup.find(df, crowd=crowd, reach=reach).collect()}
    want = near_components(rows)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in found.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in found.items())


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    rows = neardup.find(df).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in rows) == [(-1, -1), (1, 1), (1, 1), (2, 1), (3, 1), (3, 1)]
    assert neardup.find(df.limit(0)).count() == 0


def test_near_duplicates_at_the_fringe_of_a_crowd(spark):
    rng = random.Random(8)
    shared, rows = [f"s{i}" for i in range(80)], []
    for i in range(1500):
        own = [f"m{i}x{j}" for j in range(10)]
        rows.append((i, " ".join(shared + own)))
        if i % 5 == 0:  # 76 of 101 words in common with this member, fewer than 6 in 10 with any other
            rows.append((10_000 + i, " ".join(rng.sample(shared, 66) + own + [f"f{i}x{j}" for j in range(11)])))
    found = {r["doc_id"]: r["component_id"] for r in neardup.find(spark.createDataFrame(rows, "doc_id long, text string"), width=1).collect()}
    assert set(found.values()) == {0}


@pytest.mark.parametrize("edges_per_task", [3, 1000])
def test_components(spark, edges_per_task):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(200, 200 + i) for i in range(1, 40)]
    loose = [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)]
    edges = chain + star + loose + [(7, 7)]
    parent = {}
    for a, b in edges:
        parent.setdefault(a, a), parent.setdefault(b, b)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    rng.shuffle(edges)
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), edges_per_task).collect()}
    assert found == {x: root(x) for x in parent if root(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprints(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    texts = sorted([(r["doc_id"], r["text"]) for r in rows] + [(10_001, None), (10_002, ""), (10_003, "a"), (10_004, "😀é word " * 9), (10_005, rows[3]["text"])])
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in texts], "doc_id long, text string, bucket int, term string").repartition(7)
    for size in (4_000_000, 20_000):
        found = {r["doc_id"]: r for r in imatch.fingerprints(df, bucket_bytes=size).collect()}
        assert len(found) == len(texts)
        for at, (doc, text) in enumerate(texts):
            follows = texts[(at + 1) % len(texts)][1] or ""
            own = text or ""
            quarter = len(own) // 4
            edited = own[: len(own) - quarter] + follows[:quarter]
            r = found[doc]
            assert (r["n_chars"], r["edited_sha256"]) == (len(own), sha(edited))
            assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
            if edited == own:
                assert r["fingerprint"] == r["edited_fingerprint"] and r["near_edited"] == 1
        assert found[10_005]["fingerprint"] == found[rows[3]["doc_id"]]["fingerprint"]
        near = np.array([(r["near_edited"], r["near_next"]) for r in found.values()])
        assert near[:, 0].mean() > 0.3 and near[:, 1].mean() < 0.05


def test_fingerprints_of_odd_tables(spark):
    assert imatch.fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = imatch.fingerprints(spark.createDataFrame([(5, "one two three four")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == sha("one two three one ")
    odd = imatch.fingerprints(spark.createDataFrame([(None, "b c"), (1, "x y z"), (1, "x y z"), (1, "k")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or -1, r["n_chars"]) for r in odd) == [(-1, 3), (1, 1), (1, 5), (1, 5)]


def _vectors(rows, width, seed, norms=False):
    x = np.random.default_rng(seed).normal(size=(rows, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x * np.random.default_rng(seed + 1).uniform(0.1, 9, size=(rows, 1)) if norms else x


@pytest.mark.parametrize("norms,hashes", [(False, None), (True, None), (False, 2)])
def test_neighbours(spark, norms, hashes):
    x = _vectors(600, 24, 2, norms)
    x[300:420] = x[300]
    x[500:520] = x[500] + 1e-3 * _vectors(20, 24, 3)
    df = spark.createDataFrame([(i, [float(v) for v in row], "x") for i, row in enumerate(x)], "vec_id long, embedding array<double>, score string")
    found = ann.search(df, "id % 20 = 0", hashes=hashes, block_rows=64)
    rows = {}
    for r in found.collect():
        rows.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 600, 20):
        score = (x[q] * x).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(600), -score)) if i != q][:20]
        got = sorted(rows[q])
        assert [r for r, *_ in got] == list(range(1, 21)) and q not in [v for _, v, _ in got]
        assert np.allclose([s for *_, s in got], score[[v for _, v, _ in got]], atol=1e-12)
        hits += len({v for _, v, _ in got} & set(order))
        if q in (300, 320):
            assert [v for _, v, _ in got] == order
    assert hits >= 0.9 * 20 * 30


@pytest.mark.parametrize("rows", [15, 25])
def test_sparse_tables_give_all_neighbours(spark, rows):
    vecs = np.random.default_rng(rows).normal(size=(rows, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    found = ann.search(df, "true").collect()
    near = min(20, rows - 1)
    assert len(found) == rows * near
    if rows == 15:
        score = vecs @ vecs.T
        want = {(q, r + 1, int(v)) for q in range(rows) for r, v in enumerate([v for v in np.argsort(-score[q]) if v != q])}
        assert {(r["query_id"], r["rank"], r["vec_id"]) for r in found} == want


def test_neighbours_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [0.0, 0.0]), (6, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [1.0]), (None, [1.0, 1.0])]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 20 = 0").orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in found if r["query_id"] == 0] == [(0, 1, 6, 1.0), (0, 2, 7, 1.0), (0, 3, 20, 0.0)]
    assert ann.search(spark.createDataFrame([], "vec_id long, embedding array<double>"), "id % 20 = 0").count() == 0


def test_large_tables_are_hashed_like_small_ones(spark, monkeypatch):
    taken, plain = set(), ann.rotations
    monkeypatch.setattr(ann, "rotations", lambda width, tables, hashes, seed: taken.add(hashes) or plain(width, tables, hashes, seed))
    angle = F.col("id") / 40_000
    df = spark.range(200_001).select(F.col("id").alias("vec_id"), F.array(F.cos(angle), F.sin(angle)).alias("embedding"))
    found = ann.search(df, "id = 1000", k=4, tables=1)
    assert taken == {1}
    assert {r["vec_id"] for r in found.collect()} == {998, 999, 1001, 1002}


def test_recall_on_a_table(spark):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    found = ann.op1_cross_polytope_neighbors(spark, DATA)
    rows = df.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    truth = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -9
        truth += [(int(ids[q]), int(ids[v])) for v in np.lexsort((ids, -score))[:20]]
    assert ann.recall(found, spark.createDataFrame(truth, "query_id long, vec_id long")) >= 0.9
    assert found.select(F.countDistinct("query_id")).first()[0] == (ids % 20 == 0).sum()
