import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parcelmill.operators.quantiles import group_quantiles, metric_quantiles


def test_matches_numpy_on_skewed_groups(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in np.round(rng.lognormal(12, 0.4, 3000), 2)]
    rows += [("neg", float(v)) for v in rng.normal(0, 5, 301)] + [("one", 7.0)] + [(None, float(v)) for v in range(10)] + [("hot", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in group_quantiles(df, ["g"], "v", {"a": 0.1, "m": 0.5, "z": 0.97}).collect()}
    for g in ("hot", "neg", "one", None):
        v = [x for k, x in rows if k == g and x is not None]
        for name, p in (("a", 0.1), ("m", 0.5), ("z", 0.97)):
            assert abs(got[g][name] - np.quantile(v, p)) < 1e-9 * max(1, abs(np.quantile(v, p)))


def test_discrete_and_metrics(spark):
    df = spark.createDataFrame([("a", i, float(i % 5)) for i in range(1, 101)], "g string, v int, w double")
    out = metric_quantiles(df, ["g"], {"p1": ("v", 0.01), "p95": ("v", 0.95), "w5": ("w", 0.5)}, discrete=True).first()
    assert (out["p1"], out["p95"], out["w5"]) == (1.0, 95.0, 2.0)
    assert metric_quantiles(df, [], {"m": ("v", 0.5)}).first()["m"] == 50.5


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60), st.floats(0, 1))
def test_any_values(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = group_quantiles(df, [], "v", {"q": p}).select(F.col("q")).first()[0]
    assert abs(got - np.quantile(values, p)) <= 1e-6 * max(1.0, max(abs(v) for v in values))
