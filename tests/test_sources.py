import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv
from parcelmill.operators import windows as wn
from parcelmill.session import settings
from parcelmill.sources import layers as ly
from parcelmill.sources import roll as rl
from parcelmill.sources import runs as rn
from parcelmill.streaming import feeds as fd


def test_roll_file_round_trip(spark, tmp_path):
    text = "PARCEL|OWNER \"X\"|VALUE\nP1|Jos\xe9 \"B\"|10.5\nshort\na|b|1|2\n\nP2|Ann|x\nP3|Bo|7\n"
    path = tmp_path / "roll.txt"
    path.write_bytes(text.encode("latin-1"))
    schema = "parcel string, owner string, value double"
    df = rl.read_roll(spark, str(path), schema)
    rows = df.orderBy("parcel").collect()
    assert [(r[0], r[1], r[2]) for r in rows] == [("P1", 'José "B"', 10.5), ("P2", "Ann", None), ("P3", "Bo", 7.0), ("short", None, None)]
    assert df.count() == 4 and [df.select(x).count() for x in df.columns] == [4, 4, 4] and len(df.select("value").collect()) == 4
    lines = rl.roll_lines(spark, str(path))
    assert [r["line"] for r in rl.parse_roll_lines(lines, "line", schema)[1].collect()] == ["a|b|1|2"]
    assert tuple(rl.roll_counts(lines, "line", schema).first()) == (5, 4, 1, 1)


def test_one_run_is_read_back(spark, tmp_path, tables):
    path = str(tmp_path / "runs")
    stats = tables.segment_stats
    for run, mode, day in (("RUN1", "sfr", "01"), ("RUN2", "sfr", "03"), ("RUN2", "condo", "02")):
        own = stats.where(F.col("run_id") == run)
        segments = own.select("run_id", "market_group", F.lit("large").alias("size")).distinct()
        rn.write_run(own, tables.coefficients, {"generated_at": f"2025-02-{day}", "mode": mode}, path, segments, {"cod": 9.5}, ["few sales"])
    one = rn.load_run(spark, path, "RUN1").first()
    assert one["metadata"]["mode"] == "sfr" and one["global_metrics"]["cod"] == 9.5 and one["warnings"] == ["few sales"] and one["errors"] == [] and len(one["segments"]) > 0
    assert rn.load_run(spark, path).first()["metadata"]["generated_at"] == "2025-02-03"
    assert rn.load_run(spark, path, mode="condo").first()["run_id"] == "RUN2"
    assert rn.load_run(spark, path, "RUN1", "condo").count() == 0


def test_zoning_rules_are_kept_once_per_key(spark):
    names = ["min_lot_size_sqft", "max_lot_coverage_pct", "max_height_ft", "front_setback_ft", "side_setback_ft", "rear_setback_ft", "allows_adu", "allows_duplex", "allows_multifamily"]
    sheet = spark.createDataFrame([("R1", "X", "5", 1), (" R1", "X ", "7", 2), ("R2", "X", "UNKNOWN", 3)], "zone_code string, jurisdiction string, min_lot_size_sqft string, line_no int")
    for x in names[1:]:
        sheet = sheet.withColumn(x, F.lit("NONE"))
    rules = {r["zone_code"]: r["min_lot_size_sqft"] for r in rl.load_zoning_rules(sheet).collect()}
    assert rules == {"R1": 7.0, "R2": float(fv.ZONING_DEFAULTS["min_lot_size_sqft"])}
    later = rl.upsert_zoning_rules(rl.load_zoning_rules(sheet), sheet.where("line_no = 1"))
    assert {r["zone_code"]: r["min_lot_size_sqft"] for r in later.collect()}["R1"] == 5.0 and later.count() == 2


def test_roll_years_are_replaced(spark, tmp_path):
    out = str(tmp_path / "rolls")
    df = spark.createDataFrame([("P1", 1.0)], "parcel string, value double")
    for year, value in ((2024, 1.0), (2025, 2.0), (2025, 3.0)):
        rows, ignored = rl.import_roll(df.withColumn("value", F.lit(value)).withColumn("junk", F.lit(1)), {"parcel": "parcel", "value": "value"}, year)
        rl.write_roll(rows, out)
    assert ignored == ["junk"]
    assert sorted((r["roll_year"], r["value"]) for r in spark.read.parquet(out).collect()) == [(2024, 1.0), (2025, 3.0)]


def test_runs_export_and_log(spark, tmp_path, tables):
    stats = tables.segment_stats.where("run_id = 'RUN1'")
    rn.write_run(stats, tables.coefficients, {"generated_at": "2025-01-01T00:00:00", "mode": "sfr"}, str(tmp_path / "runs"))
    rn.write_run(stats, tables.coefficients, {"generated_at": "2025-02-01T00:00:00", "mode": "condo"}, str(tmp_path / "runs"))
    assert [r["mode"] for r in rn.list_runs(spark, str(tmp_path / "runs")).collect()] == ["condo", "sfr"]
    assert rn.list_runs(spark, str(tmp_path / "runs"), "sfr").count() == 1
    rn.export(stats.withColumn("tags", F.array(F.lit("a"))), str(tmp_path / "csv"))
    rn.export(stats, str(tmp_path / "json"), "json")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == stats.count() == spark.read.json(str(tmp_path / "json")).count()
    counts = spark.createDataFrame([(7, 5, 2)], "lines int, kept int, skipped int")
    rn.log_import(spark, str(tmp_path / "log"), "rolls", "assessor", "file", counts, dt.datetime(2025, 1, 1))
    assert spark.read.parquet(str(tmp_path / "log")).first()["row_count"] == 5


def test_review_stream_keeps_each_review_once(spark, tmp_path):
    schema = "place_id long, source string, review_id string, text string, created_at timestamp"
    at = dt.datetime(2024, 1, 1)
    day = lambda n: at + dt.timedelta(days=n)
    first = [(1, "g", "a", "x", at), (1, "g", "a", "x", day(3)), (1, "g", "b", " ", at), (2, "g", "a", "y", at)]
    second = [(1, "g", "a", "x", at), (1, "g", "c", "z", day(400))]
    # A place that is new brings its whole history.
    third = [(3, "g", "a", "old", day(-4000)), (3, "g", "b", "new", day(401)), (1, "g", "d", "late", day(-1))]
    src, table, places = str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "places")
    for rows in (first, second, third, third):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        fd.ingest_reviews(stream, table, str(tmp_path / "cp"), places, buckets=4).awaitTermination(120)
    stored = fd.stored_reviews(spark, table)
    want = [(1, "a", at), (1, "c", day(400)), (1, "d", day(-1)), (2, "a", at), (3, "a", day(-4000)), (3, "b", day(401))]
    assert sorted((r["place_id"], r["review_id"], r["created_at"]) for r in stored.collect()) == want
    newest = [(1, day(400), 3), (2, at, 1), (3, day(401), 2)]
    assert sorted(tuple(r) for r in fd.place_counts(spark, table, places).collect()) == newest
    # A second job with a checkpoint of its own adds what is new and overwrites nothing.
    other = str(tmp_path / "in2")
    spark.createDataFrame([*first, (9, "g", "a", "mine", at)], schema).coalesce(1).write.parquet(other)
    fd.ingest_reviews(spark.readStream.schema(schema).parquet(other), table, str(tmp_path / "cp2"), places, buckets=4).awaitTermination(120)
    want.append((9, "a", at))
    rows = lambda: sorted((r["place_id"], r["review_id"], r["created_at"]) for r in fd.stored_reviews(spark, table).collect())
    assert rows() == want
    # What a job left without a commit is not seen.
    left = spark.createDataFrame([(7, "g", "lost", "x", at)], schema).withColumns({"bucket": F.lit(0), "batch": F.lit("dead-0")})
    left.write.mode("append").partitionBy("bucket", "batch").parquet(table)
    assert rows() == want
    fd.compact_reviews(spark, table, places)
    assert rows() == want and sorted(tuple(r) for r in fd.place_counts(spark, table, places).collect()) == [*newest, (9, at, 1)]
    # The stream goes on after a compaction.
    spark.createDataFrame([(1, "g", "a", "x", at), (9, "g", "b", "more", at)], schema).coalesce(1).write.mode("append").parquet(src)
    fd.ingest_reviews(spark.readStream.schema(schema).parquet(src), table, str(tmp_path / "cp"), places, buckets=4).awaitTermination(120)
    assert rows() == [*want, (9, "b", at)]


def test_activity_stream_keeps_newest(spark, tmp_path):
    schema = "event_id long, ts timestamp, label string, value string"
    src, table = str(tmp_path / "in"), str(tmp_path / "feed")
    for k in range(2):
        rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=i), "l", "" if i % 5 == 0 else "v") for i in range(k * 20, k * 20 + 20)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        fd.activity_feed(spark.readStream.schema(schema).parquet(src), table, str(tmp_path / "cp"), 5).awaitTermination(120)
    newest = spark.read.parquet(table + "/slot=1").orderBy(F.desc("ts")).collect()
    assert [r["event_id"] for r in newest] == [39, 38, 37, 36, 34]


def test_cadence_of_last_fifteen(spark):
    rows = [(1, i, dt.datetime(2024, 1, 1) + dt.timedelta(days=i * (3 if i > 10 else 50))) for i in range(30)]
    df = spark.createDataFrame(rows, "place_id long, review_id long, created_at timestamp")
    newest = sorted(r[2] for r in rows)[-15:]
    want = (newest[-1] - newest[0]).total_seconds() / 86400 / 14
    assert abs(wn.review_cadence(df).first()["avg_gap_days"] - want) < 1e-9


def test_features_of_every_kind(spark):
    shapes = [
        ("Point", "[1, 2]"), ("MultiPoint", "[[1, 2], [3, 4]]"), ("LineString", "[[0, 0], [1, 1]]"), ("MultiLineString", "[[[0, 0], [1, 1]], [[2, 2], [3, 3], [4, 4]]]"),
        ("Polygon", "[[[0, 0], [1, 0], [1, 1], [0, 0]]]"), ("MultiPolygon", "[[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]"),
        ("LineString", "[[0, 0]]"), ("Polygon", "[[[0, 0], [1, 0], [1, 1]]]"), ("Point", "[]"), ("MultiLineString", "[]"), ("Curve", "[1]"),
    ]
    text = '{"features": [' + ", ".join(f'{{"geometry": {{"type": "{k}", "coordinates": {v}}}, "properties": {{"n": "{i}"}}}}' for i, (k, v) in enumerate(shapes)) + "]}"
    rows = {int(r["properties"]["n"]): r for r in ly.read_features(spark.createDataFrame([(text,)], "json string")).collect()}
    assert [i for i in sorted(rows) if rows[i]["valid"]] == [0, 1, 2, 3, 4, 5]
    assert (rows[0]["x"], rows[0]["y"]) == (1, 2) and [len(r) for r in rows[1]["rings"]] == [1, 1]
    assert [len(r) for r in rows[3]["rings"]] == [2, 3] and len(rows[5]["rings"]) == 2 and rows[2]["kind"] == "LineString"


@pytest.mark.parametrize("block", [64, 301, 1_000_000])
def test_feature_files_in_blocks(spark, tmp_path, block):
    rng = random.Random(block)
    odd = ['a}b', 'say \\"{x}\\"', 'back\\\\', "é😀}{", "line\\nbreak", "", '{"type": "Feature"}', "]}", "plain"]

    def feature(i):
        text = json.dumps(odd[i % len(odd)], ensure_ascii=i % 2 == 0)
        props = {"n": str(i), "t": "@"} if i % 5 else {"n": str(i)}
        geometry = {"type": "LineString", "coordinates": [[i, k] for k in range(2 + rng.randrange(30))]} if i % 3 else {"coordinates": [i, 2], "type": "Point"}
        made = {"type": "Feature", "properties": props, "geometry": geometry} if i % 2 else {"geometry": geometry, "properties": props, "type": "Feature"}
        return json.dumps(made, indent=rng.choice([None, 2])).replace('"@"', text)

    head = '{"type": "FeatureCollection", "name": "x{\\"", "crs": {"type": "name", "properties": {"name": "}a"}}, "features": ['
    tail = '], "note": "b}c", "extra": {"type": "other"}}'
    first = head + ", ".join(feature(i) for i in range(60)) + tail + "\n" + '{"features": [], "type": "FeatureCollection"}' + head + feature(60) + tail
    (tmp_path / "a.json").write_text(first, encoding="utf-8")
    (tmp_path / "b.json").write_text('{"features":[' + ",".join(feature(i) for i in range(61, 90)) + "]}\n", encoding="utf-8")
    (tmp_path / "empty.json").write_text('{"type": "FeatureCollection", "features": []}')
    (tmp_path / "cut.json").write_text('{"features":[' + feature(90) + ', {"type": "Feature", "properties": {"n": "91"')
    decoder, want = json.JSONDecoder(), {}
    for text in (first, (tmp_path / "b.json").read_text(encoding="utf-8")):
        at = 0
        while at < len(text.rstrip()):
            whole, at = decoder.raw_decode(text, at)
            at += len(text[at:]) - len(text[at:].lstrip())
            want |= {int(f["properties"]["n"]): f for f in whole["features"]}
    with settings(spark, spark__sql__files__maxPartitionBytes=str(block), spark__sql__files__openCostInBytes="1"):
        found = [json.loads(r["json"]) for r in ly.feature_texts(spark, str(tmp_path)).collect() if '"91"' not in r["json"]]
        rows = {r["properties"]["n"]: r for r in ly.read_feature_files(spark, str(tmp_path)).where("valid").collect()}
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > (1 if block < 1000 else 0)
    got = {int(f["properties"]["n"]): f for f in found}
    assert len(found) == len(got) == 91 and got.pop(90)["type"] == "Feature" and got == want
    assert {int(n) for n in rows} >= set(want) and rows["1"]["kind"] == "LineString" and rows["3"]["x"] == 3


def test_schedule_stream_equals_the_batch_rule(spark, tmp_path):
    schema = "place_id long, at timestamp, failed boolean, inserted int, avg_gap_days double"
    src, sink, rng = str(tmp_path / "in"), str(tmp_path / "out"), random.Random(2)
    start, at, feed = dt.datetime(2024, 1, 1), {}, []
    for turn in range(4):
        rows = []
        for place in range(6):
            for _ in range(rng.randrange(3) if turn else 2):
                at[place] = at.get(place, start) + dt.timedelta(days=rng.randrange(1, 9), microseconds=rng.randrange(10**6))
                rows.append((place, at[place], rng.random() < 0.2, rng.randrange(3), rng.choice([None, 2.0, 10.0, 400.0])))
        rng.shuffle(rows)
        feed.append(rows)
    feed.append([(0, start, False, 1, 5.0), (99, max(at.values()) + dt.timedelta(days=300), None, None, None), (None, start, False, 0, None), (5, None, False, 0, None)])
    feed.append([(99, max(at.values()) + dt.timedelta(days=500), False, 0, None)])
    for rows in feed:  # one run per part: the schedule goes on from the state of the checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        out = fd.fetch_schedule(spark.readStream.schema(schema).parquet(src), late="60 days")
        out.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(sink).awaitTermination(180)
    got = spark.read.parquet(sink).toPandas()
    fetched = {(r.place_id, r.at.to_pydatetime()): r for r in got[got.event == "fetched"].itertuples()}
    outcomes = sorted((r for rows in feed[:4] for r in rows), key=lambda r: (r[0], r[1]))
    steps, stored = [], {}
    for place, when, failed, inserted, gap in outcomes:
        steps.append((place, when, failed, inserted, gap, stored.get(place)))
        if not failed and inserted > 0:
            stored[place] = gap if gap is not None else 14.0
    batch = spark.createDataFrame(steps, schema + ", stored_gap_days double")
    want = wn.fetch_outcome(batch, start).select("place_id", "at", "days", "gap_days").collect()
    assert len(want) == len(outcomes) == len(fetched) - 2
    for r in want:
        mine = fetched[r["place_id"], r["at"]]
        assert mine.days == pytest.approx(r["days"]) and (r["gap_days"] is None or mine.gap_days == pytest.approx(r["gap_days"]))
        assert abs((mine.next_fetch_at - mine.at).total_seconds() - r["days"] * 86400) < 1e-5
    assert got[got.event == "late"].place_id.tolist() == [0]
    # In the end the newest outcome of every place is past its timer, so each is due at its last time.
    last = {p: max(fetched[k].next_fetch_at for k in fetched if k[0] == p) for p in at}
    due = got[got.event == "due"]
    for place, k in ((p, max(w for q, w in fetched if q == p)) for p in at):
        assert fetched[place, k].next_fetch_at in set(due[due.place_id == place]["at"]), (place, last)
    assert not due.duplicated(["place_id", "at"]).any()


def test_pages_from_the_index(spark, tmp_path):
    rows = [(i * 7919 % 1009, None if i % 10 == 0 else float(i % 4) if i % 3 else 5.0) for i in range(1000)]
    df = spark.createDataFrame(rows, "parcel_id long, assessed_value double")
    path = str(tmp_path / "index")
    wn.write_page_index(df, path, 7)
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0.0), r[0]))
    for page in (1, 2, 17, 40, 41, 10_000):
        assert [tuple(r) for r in wn.indexed_page(spark, path, page, 25).collect()] == want[(page - 1) * 25 : page * 25]
    plan = wn.indexed_page(spark, path, 30, 25)
    assert len(plan.inputFiles()) == 7 and spark.read.parquet(path + "/ranges").agg(F.max("rows")).first()[0] < 400
    numbered = {r["parcel_id"]: (r["page"], r["place"]) for r in wn.numbered_pages(spark, path, 25).collect()}
    assert numbered == {r[0]: (i // 25 + 1, i % 25 + 1) for i, r in enumerate(want)}
    wn.write_page_index(df.limit(0), path, 3)
    assert wn.indexed_page(spark, path, 1).count() == 0 and wn.numbered_pages(spark, path).count() == 0
