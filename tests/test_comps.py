import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parcelmill.operators import comps as cm

MILE = 1609.34


def _ring(rows, n, radius):
    pick = max(n, 8)
    filled = sorted(r for r in rows if r[1] <= radius)[: pick * 2]
    short = sorted(filled, key=lambda r: r[1:])[:pick]
    near = [r for r in short if r[1] <= MILE]
    return (near if len(near) >= 3 else short)[:n]


@pytest.mark.parametrize("n, radii", [(7, (3218.0, 4828.0)), (3, (3218.0,)), (10, (1000.0, 2000.0, 4828.0))])
def test_rings_are_counted_in_one_pass(spark, n, radii):
    rnd = random.Random(n)
    pairs = {}  # subject: (tier, distance, comp_id), with equal distances
    for s in range(60):
        reach = rnd.choice([1500, 3000, 4828])
        pairs[s] = [(rnd.randrange(3), float(rnd.randrange(1, reach // 100) * 100), k) for k in range(rnd.randrange(40))]
    want = set()
    for s, rows in pairs.items():
        chosen = []
        for i, radius in enumerate(radii):
            chosen += [(i, *r) for r in _ring(rows, n, radius) if r not in [x[1:] for x in chosen]]
        want |= {(s, k, ring, rank) for rank, (ring, _, _, k) in enumerate(chosen[:n], 1)}
    rows = spark.createDataFrame([(s, k, t, d) for s, x in pairs.items() for t, d, k in x], "subject_id long, comp_id long, tier int, distance double")
    found = cm.escalate_radius(rows, n, radii).select("subject_id", "comp_id", "ring", "rank")
    assert {tuple(r) for r in found.collect()} == want
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Join" not in plan
    assert found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1


def test_pool_looks_at_recent_sales_only(spark):
    facts = dict.fromkeys(cm.FACTS, 1.0) | {"hood_code": "20A", "city_district": "C", "valuation_area": "A", "land_use_code": "110", "address": "1 A ST", "proptype": "R"}
    parcels = spark.range(1, 5).select(F.col("id").alias("parcel_id"), *[F.lit(v).alias(k) for k, v in facts.items()])
    sales = [
        (1, 1, 100.0, dt.datetime(2001, 6, 1)), (2, 1, 90.0, dt.datetime(2001, 7, 1)),  # the newest of two
        (3, 2, 80.0, dt.datetime(1999, 1, 1)), (4, 3, None, dt.datetime(2001, 7, 1)), (5, 3, 70.0, dt.datetime(2001, 6, 1)),  # old; newest without a price
        (6, 4, 60.0, None), (7, 4, 50.0, dt.datetime(2000, 2, 8)),  # without a date; the last day that counts
    ]
    sales = spark.createDataFrame(sales, "sale_id long, parcel_id long, sale_price double, sale_date timestamp").withColumns(
        {"sale_type": F.lit("VALID SALE"), "deed_type": F.lit("WARRANTY DEED")}
    )
    pool = cm.comp_pool(parcels, sales, dt.date(2001, 8, 1))
    assert {(r["parcel_id"], r["sale_price"]) for r in pool.collect()} == {(1, 90.0), (4, 50.0)}
    plan = pool._jdf.queryExecution().optimizedPlan().toString()
    assert ">=" in plan.split("Aggregate", 1)[1]  # the cut is made before the newest sale is looked for
