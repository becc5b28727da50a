"""Personal data against Python's regular expressions, and what contexts add."""

import random

from parcelmill.llm import pii
from tests.llm.brute import base_spans, sha

DATA = "/root/testdata/sf0.001"
HARD = [
    "a@b.c.@d.e x@y.com%foo@z.org a@b@c.d ..@-.- q@w", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 4 1 1",
    "+1 (017) 555-7713, +49 30 123456789012345 +1 2 +12345678 +1((((2", "é😀 me@x.io 😀 +44 20 7946 0958.", "", None, "no digits at all", "1" * 300, "a" * 3000 + "@b.cc", "1.2.3.4 " * 400, "0@0.0",
]


def _spans(row):
    return [s for s in row["spans"].split(",") if s]



def test_base_spans(spark, tmp_path):
    rng = random.Random(4)
    fuzz = ["".join(rng.choice("12.@+- ()ab%_") for _ in range(rng.randint(1, 60))) for _ in range(400)]
    rows = list(enumerate(HARD + fuzz))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in pii.op5_personal_data(spark, str(tmp_path)).collect()}
    assert len(found) == len(rows)
    for doc, text in rows:
        want, r = base_spans(text), found[doc]
        assert r["base_sha256"] == sha(",".join(want)), text
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k + ":") for s in want) for k in pii.KINDS]
        assert set(want) <= set(_spans(r))


def test_whole_table(spark):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in pii.op5_personal_data(spark, DATA).collect():
        assert r["base_sha256"] == sha(",".join(base_spans(rows[r["doc_id"]])))


def test_contexts_add_what_the_patterns_miss(spark):
    rows = [(i, f"call phone: +1 202 555 01{i:02d} today, version {i}.{i % 7} of item {1000 + i}") for i in range(30)]
    rows += [(100, "call phone: 2025550199 today"), (101, "elsewhere 2025550199 stands alone"), (102, "item 1234 and 555777"), (103, "phone: soon"), (104, None)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, key string, kind int")
    found = {r["doc_id"]: r for r in pii.find(df).collect()}
    texts = dict(rows)
    cut = lambda i: [(s["kind"], texts[i][s["start"] : s["end"]]) for s in found[i]["added"]]
    assert cut(100) == [("phone", "2025550199")] and cut(101) == [("phone", "2025550199")]
    assert all(cut(i) == [] for i in texts if i not in (100, 101))


def _added(spark, rows):
    texts = dict(rows)
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["added"]] for r in found if r["added"]}


def _card(number):
    """16 digits that pass the check sum, in groups."""
    digits = f"4{number:014d}"
    digits += next(c for c in "0123456789" if any(x.startswith("card") for x in base_spans(digits + c)))
    return " ".join(digits[i : i + 4] for i in range(0, 16, 4))


def test_contexts_add_identifiers_with_spaces(spark):
    rows = [(i, f"call phone: +1 202 555 01{i:02d} today") for i in range(30)]
    rows += [(100 + i, f"paid by card {_card(7919 * i)} at noon") for i in range(30)]
    want = {
        200: [("phone", "0171 555 7713")], 201: [("phone", "(0171) 555-77 14")], 202: [("phone", "0171.555 7715")], 203: [("phone", "0171 555 7713")],
        210: [("card", "3782 822463 10005")], 211: [("card", "3782-8224 6310-006")],
    }
    rows += [(200, "call phone: 0171 555 7713"), (201, "call phone: (0171) 555-77 14 today"), (202, "call phone: 0171.555 7715. 3 more"), (203, "elsewhere 0171 555 7713, alone")]
    rows += [(210, "paid by card 3782 822463 10005 at noon"), (211, "paid by card 3782-8224 6310-006, then"), (212, "rooms 12 34 56 78 and 2024 2025 2026"), (213, "1 " * 400)]
    assert _added(spark, rows) == want


def test_contexts_with_a_third_unseen(spark):
    rows = [(i, f"please dial number +44 20 7946 09{i:02d} now") for i in range(10)] + [(20 + i, f"please dial number 02079460{i}77 now") for i in range(5)]
    rows += [(40 + i, f"my login from {i}.7.7.{i} failed") for i in range(4)] + [(50 + i, f"my login from fe80::{i}:a1 failed") for i in range(2)]
    # Not of the make: no evidence against the pattern. Other contexts: not to be added.
    rows += [(60 + i, f"please dial number {x} now") for i, x in enumerate(["v1.2.3b", "2024", "item12", "1999", "x86-64", "2031"])]
    rows += [(70 + i, f"the order number 5500{i}1234 shipped") for i in range(12)] + [(90 + i, f"serial number 77{i}12345 and +44 20 7946 09{i:02d}") for i in range(6)]
    want = {20 + i: [("phone", f"02079460{i}77")] for i in range(5)} | {50 + i: [("ip", f"fe80::{i}:a1")] for i in range(2)}
    assert _added(spark, rows) == want


def test_redaction_keeps_rows_and_columns(spark):
    rows = [(1, "mail a@b.cc, ip 1.2.3.4!", 7, "k"), (1, "mail a@b.cc, ip 1.2.3.4!", 7, "k"), (2, None, None, None), (None, "é +44 20 7946 0958", 1, "k"), (3, "", 0, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = sorted(((r["doc_id"] or -1, r["text"], r["spans"]) for r in pii.redact(df).collect()), key=str)
    assert pii.redact(df).columns == df.columns
    assert got == sorted([(1, "mail [EMAIL], ip [IP]!", "k")] * 2 + [(2, None, None), (-1, "é [PHONE]", "k"), (3, "", "k")], key=str)
    assert pii.redact(df.limit(0)).count() == 0 and pii.find(df.limit(0)).count() == 0
