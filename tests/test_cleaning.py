import pytest
from pyspark.sql import functions as F

from parcelmill.functions import cleaning as cl
from parcelmill.functions import codes as cd
from parcelmill.functions import measures as ms
from parcelmill.functions import web as wb


def values(spark, items, expr, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in df.select("i", expr(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


@pytest.mark.parametrize("code, area", [
    ("20B123", "BURLINGTON"), ("21LC45", "LACONNER_CONWAY"), ("20A9", "ANACORTES"), ("21SW5", "SEDRO_WOOLLEY"),
    ("10CC1", "CONCRETE"), ("21MV8", "MOUNT_VERNON"), ("99ZZ", "OTHER"), (None, None), (" ", None),
])
def test_market_group(spark, code, area):
    assert values(spark, [code], cd.market_group) == [area]


def test_split_code(spark):
    raw = ["(110) UGA", "110", "", None, "( ) x", "(a1) two-story o'brien"]
    assert values(spark, raw, lambda c: cl.split_code_desc(c)[0]) == ["110", "110", None, None, None, "A1"]
    assert values(spark, raw, lambda c: cl.split_code_desc(c)[1]) == ["Uga", None, None, None, "X", "Two-Story O'Brien"]


def test_bath_tokens(spark):
    got = values(spark, ["2FB,HB", "33FB", "3QB", "QTR", "FB;HB MB", "", None], cd.bath_tokens)
    assert [tuple(x) for x in got] == [(2, 1, 0), (3, 0, 0), (0, 0, 1), (0, 0, 0), (2, 1, 0), (0, 0, 0), (0, 0, 0)]


def test_money(spark):
    raw = ["$4,900.00", "$.00", "(1,200)", "x", None, "99.5"]
    assert values(spark, raw, cl.money_int) == [4900, 0, 0, 0, 0, 100]
    assert values(spark, raw, cl.accounting_amount) == [4900.0, 0.0, -1200.0, None, None, 99.5]


def test_parse_numeric(spark):
    raw = ["3", "¾", "3qb", "1/2", "na", "4/0", None, "2.5 baths"]
    assert values(spark, raw, cl.parse_numeric) == [3.0, 0.75, 0.75, 0.5, None, None, None, 2.5]


def test_urls(spark):
    base = F.lit("https://a.example/x/y/z.html?q=1#f")
    links = ["m.pdf", "../m", "/r/./s", "//c.example/d", "?k=2", "#top", "http://b.example/", ""]
    want = [
        "https://a.example/x/y/m.pdf", "https://a.example/x/m", "https://a.example/r/s", "https://c.example/d",
        "https://a.example/x/y/z.html?k=2", "https://a.example/x/y/z.html?q=1#top", "http://b.example/", "https://a.example/x/y/z.html?q=1#f",
    ]
    assert values(spark, links, lambda c: wb.absolute_url(base, c)) == want
    assert values(spark, ["https://a.example/x/?b=1#z", "https://a.example/"], wb.normalize_url) == ["https://a.example/x?b=1", "https://a.example"]


def test_aspect_and_display(spark):
    got = values(spark, [0.0, 22.5, 359.9, 360.0, -1.0, 180.0, None], cd.aspect_direction, "double")
    assert got == ["N", "NE", "N", None, None, "S", None]
    assert values(spark, [1_250_000.0, 2_000.0, 950.0, None], ms.compact_currency, "double") == ["$1.3M", "$2K", "$950", None]
    assert values(spark, [1.7, 2.5, 3.0], ms.quarter_baths, "double") == ["1.75", "2.5", "3"]
