"""Queries for snapshot merges and the loaders."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv
from parcelmill.functions import geometry as gm
from parcelmill.operators import merge as mg
from parcelmill.plans.registry import query
from parcelmill.session import shared_folder
from parcelmill.sources import layers as ly
from parcelmill.sources import roll as rl

c = F.col

# The whole table plays the stored rows, and once more, partly under new keys, the new ones.
_SIDES = """old_rows AS (SELECT c_custkey AS k, c_name AS name, c_acctbal AS amount, c_mktsegment AS seg FROM {c}),
    new_rows AS (SELECT CASE WHEN c_custkey % 3 = 0 THEN -c_custkey ELSE c_custkey END AS k, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN NULL ELSE lower(c_name) END AS name,
                 CASE WHEN c_custkey % 5 = 0 THEN 0e0 ELSE c_acctbal END AS amount FROM {c})"""
_DUCK = _SIDES.format(c="customer")


def sides(t):
    """Stored rows, and new rows with every key twice: `ver` 1 is stale, 2 counts."""
    sql = "WITH " + _SIDES.format(c="{customer}") + " SELECT * FROM "
    old, new = t.sql(sql + "old_rows"), t.sql(sql + "new_rows").withColumn("ver", F.lit(2))
    stale = new.select("k", F.lit("stale").alias("name"), (c("amount") + 1).alias("amount"), F.lit(1).alias("ver"))
    return old, stale.unionByName(new)


@query(
    "m01_upsert",
    f"""WITH {_DUCK} SELECT coalesce(o.k, n.k) AS k, CASE WHEN n.k IS NOT NULL THEN n.name ELSE o.name END AS name,
        CASE WHEN n.k IS NOT NULL THEN n.amount ELSE o.amount END AS amount, o.seg FROM old_rows o FULL JOIN new_rows n ON o.k = n.k""",
)
def _(t):
    return mg.upsert(*sides(t), ["k"], order=["ver"])


@query(
    "m02_insert_new",
    f"WITH {_DUCK} SELECT k, name, amount, seg FROM old_rows UNION ALL SELECT k, name, amount, NULL FROM new_rows WHERE k NOT IN (SELECT k FROM old_rows)",
)
def _(t):
    old, new = sides(t)
    return mg.insert_new(old, new, ["k"], order=[-c("ver")]).drop("ver")


@query(
    "m03_merge_changed",
    f"""WITH {_DUCK}, j AS (SELECT o.k AS ok, n.k AS nk, o.name AS oname, n.name AS nname, o.amount AS oa, n.amount AS na, o.seg FROM old_rows o FULL JOIN new_rows n ON o.k = n.k),
        d AS (SELECT *, coalesce(nname <> '', false) AND nname IS DISTINCT FROM oname AS cn, coalesce(na <> 0, false) AND na IS DISTINCT FROM oa AS ca FROM j)
        SELECT coalesce(ok, nk) AS k, CASE WHEN ok IS NULL OR cn THEN nname ELSE oname END AS name, CASE WHEN ok IS NULL OR ca THEN na ELSE oa END AS amount, seg,
               CASE WHEN ok IS NULL THEN 'created' WHEN nk IS NOT NULL AND (cn OR ca) THEN 'updated' ELSE 'kept' END AS action FROM d""",
)
def _(t):
    old, new = sides(t)
    return mg.merge_changed(old, new, ["k"], ["name", "amount"], order=["ver"])


@query(
    "m04_replace_scope",
    f"WITH {_DUCK} SELECT k, name, amount, seg FROM old_rows WHERE NOT (seg = 'BUILDING') UNION ALL SELECT k, name, amount, NULL FROM new_rows",
)
def _(t):
    old, new = sides(t)
    return mg.replace_scope(old, new.where("ver = 2").drop("ver"), c("seg") == "BUILDING")


@query(
    "m05_undo_run",
    "SELECT run_id, market_group, term, beta FROM coefficients WHERE run_id <> (SELECT run_id FROM coefficients ORDER BY created_at DESC, run_id DESC LIMIT 1)",
)
def _(t):
    return mg.undo_run(t.coefficients).select("run_id", "market_group", "term", "beta")


_ITEMS = """items AS (SELECT l_suppkey AS place_id, 'http://m/' || CAST(l_partkey % 7 AS {s}) AS source_url, CASE WHEN l_linenumber = 7 THEN 'x' ELSE ' ' || p_name || ' ' END AS name,
        CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE '  ' || p_brand END AS description, '$' || CAST(p_size AS {s}) || '.50 each' AS price_text, p_type AS section
        FROM {l} JOIN {p} ON l_partkey = p_partkey)"""


@query(
    "m06_menu_items",
    f"""WITH {_ITEMS.format(s='VARCHAR', l='lineitem', p='part')}
        SELECT place_id, source_url, trim(name) AS name, count(*) AS n, min(trim(coalesce(description, ''))) AS description,
               min(CAST(regexp_extract(price_text, '[0-9.]+', 0) AS DOUBLE)) AS price FROM items WHERE length(trim(name)) >= 2 GROUP BY 1, 2, 3""",
)
def _(t):
    items = t.sql("WITH " + _ITEMS.format(s="STRING", l="{lineitem}", p="{part}") + " SELECT * FROM items")
    return mg.menu_items(items).groupBy("place_id", "source_url", "name").agg(
        F.count(F.lit(1)).alias("n"), F.min("description").alias("description"), F.min("price").cast("double").alias("price")
    )


@query(
    "m06_menu_upsert",
    f"""WITH {_ITEMS.format(s='VARCHAR', l='lineitem', p='part')}, k AS (SELECT DISTINCT place_id, source_url, trim(name) AS name FROM items WHERE length(trim(name)) >= 2)
        SELECT place_id, count(*) AS items FROM (SELECT place_id, source_url, name FROM k UNION SELECT s_suppkey, 'http://m/0', 'house soup' FROM supplier) GROUP BY 1""",
)
def _(t):
    items = t.sql("WITH " + _ITEMS.format(s="STRING", l="{lineitem}", p="{part}") + " SELECT * FROM items")
    target = t.supplier.select(
        c("s_suppkey").alias("place_id"), F.lit("http://m/0").alias("source_url"), F.lit("house soup").alias("name"), F.lit("").alias("description"),
        F.lit(None).cast("decimal(8,2)").alias("price"), F.lit("").alias("section"), F.lit("USD").alias("currency"),
    )
    return mg.upsert_menu(target, items).groupBy("place_id").agg(F.count(F.lit(1)).alias("items"))


@query(
    "m07_comparable_keys",
    """SELECT key, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'sale:' || CASE WHEN o_orderkey % 2 = 0 THEN 'no-date' ELSE strftime(o_orderdate, '%Y-%m-%d') END || ':'
       || CASE WHEN o_orderkey % 5 = 0 THEN 'no-price' ELSE CAST(o_totalprice AS VARCHAR) END ELSE 'parcel:' || CAST(o_custkey AS VARCHAR) END AS key FROM orders) GROUP BY 1""",
)
def _(t):
    key = mg.comp_key(
        F.when(c("o_orderkey") % 3 != 0, c("o_custkey")), F.when(c("o_orderkey") % 2 != 0, c("o_orderdate")),
        F.when(c("o_orderkey") % 5 != 0, c("o_totalprice")),
    )
    return t.orders.select(key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


_LINES = """CASE o_orderkey % 9 WHEN 0 THEN 'too|many|fields|here' WHEN 1 THEN 'short line' WHEN 2 THEN CAST(o_orderkey AS STRING) || '|' || o_orderstatus || '"|no number'
           ELSE CAST(o_orderkey AS STRING) || '|' || o_orderstatus || '"|' || CAST(o_custkey AS STRING) || '.5' END"""


@query(
    "s01_roll_lines",
    """SELECT CASE WHEN o_orderkey % 9 = 1 THEN NULL ELSE o_orderkey END AS id, CASE WHEN o_orderkey % 9 = 1 THEN NULL ELSE o_orderstatus || '"' END AS status,
              CASE WHEN o_orderkey % 9 > 2 THEN o_custkey + 5e-1 END AS amount FROM orders WHERE o_orderkey % 9 <> 0""",
)
def _(t):
    lines = t.orders.selectExpr(f"{_LINES} AS line")
    good, _bad = rl.parse_roll_lines(lines, "line", "id bigint, status string, amount double")
    return good


@query("s02_snake_case_names", 'SELECT c_custkey AS parcel_number, c_name AS owner_name, c_acctbal AS "total_market_value" FROM customer')
def _(t):
    raw = t.customer.select(c("c_custkey").alias("Parcel Number"), c("c_name").alias("Owner--Name"), c("c_acctbal").alias("Total / Market-Value "))
    return rl.snake_case_columns(raw)


@query("s03_roll_import", "SELECT c_custkey AS parcel_number, c_acctbal AS assessed_value, 2025 AS roll_year FROM customer")
def _(t):
    out, _ignored = rl.import_roll(t.customer, {"c_custkey": "parcel_number", "c_acctbal": "assessed_value"}, 2025)
    return out


def _collections(t):
    p = lambda dx, dy: F.array(c("x0") + dx * c("side"), c("y0") + dy * c("side"))
    ring = F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1), p(0, 0))
    broken = F.array(p(0, 0), p(1, 0))
    shape = F.struct(F.lit("Polygon").alias("type"), F.array(F.when(c("zone_id") % 7 == 0, broken).otherwise(ring)).alias("coordinates"))
    feature = F.struct(shape.alias("geometry"), F.struct(c("zone_id").cast("string").alias("zone_id"), "zone_class").alias("properties"))
    return t.zones.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("json"))


@query(
    "s04_feature_scan",
    "SELECT zone_id, zone_class, zone_id % 7 <> 0 AS valid, CASE WHEN zone_id % 7 <> 0 THEN round(side * side * 247.105381, 6) END AS acres FROM zones",
)
def _(t):
    f = ly.read_features(_collections(t))
    area = F.when(c("valid"), F.round(gm.area(c("rings")) * 247.105381, 6))
    return f.select(c("properties.zone_id").cast("bigint").alias("zone_id"), c("properties.zone_class").alias("zone_class"), "valid", area.alias("acres"))


@query(
    "s04_feature_files",
    """SELECT zone_id, zone_class, zone_id % 7 <> 0 AS valid, CASE WHEN zone_id % 7 <> 0 THEN round(x0, 6) END AS west FROM zones""",
)
def _(t):
    # Files of several collections each, cut at closing braces as one large file is.
    folder = f"{shared_folder(t.spark)}/collections-{uuid.uuid4().hex}"
    _collections(t).write.text(folder)
    f = ly.read_feature_files(t.spark, folder)
    west = F.when(c("valid"), F.round(F.array_min(F.transform(F.flatten("rings"), lambda p: p["x"])), 6))
    return f.select(c("properties.zone_id").cast("bigint").alias("zone_id"), c("properties.zone_class").alias("zone_class"), "valid", west.alias("west"))


@query("s04_feature_counts", "SELECT count(*) FILTER (zone_id % 7 <> 0) AS loaded, count(*) FILTER (zone_id % 7 = 0) AS skipped FROM zones")
def _(t):
    return ly.feature_counts(ly.read_features(_collections(t)))


@query(
    "s05_layer_load",
    """SELECT s_suppkey AS amenity, round(radians(-122 + s_nationkey / 1e1) * 6378137.0, 4) AS x, round(ln(tan(pi() / 4 + radians(48 + s_suppkey % 10 / 1e1) / 2)) * 6378137.0, 4) AS y, 3857 AS srid FROM supplier""",
)
def _(t):
    raw = t.supplier.select(c("s_suppkey").alias("S_ID"), (-122 + c("s_nationkey") / 1e1).alias("X"), (48 + c("s_suppkey") % 10 / 1e1).alias("Y"))
    out = ly.load_layer(raw, {"s_id": "amenity"})
    return out.select("amenity", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "srid")


@query(
    "s06_attribute_merge",
    """SELECT s.s_suppkey AS d_point_id, p.p_brand AS wr_doc_nr, CAST(p.p_size AS INT) AS eventdate FROM supplier s LEFT JOIN part p ON s.s_suppkey = p.p_partkey""",
)
def _(t):
    points = t.supplier.select(c("s_suppkey").alias("d_point_id"), "s_name")
    docs = t.part.select(c("p_partkey").alias("D_POINT_ID"), c("p_brand").alias("WRDOCNR"), c("p_size").alias("CREATED_TD"))
    return ly.merge_attributes(points, docs).select("d_point_id", "wr_doc_nr", c("eventdate").cast("int").alias("eventdate"))


_HEADER = ["NAME", *fv.CENSUS_VARIABLES, "state", "county", "tract", "block group"]


@query(
    "s08_census_table",
    """SELECT c_name AS name, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey * 10e0 END AS median_income, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE 3e0 END AS median_rent,
              '53' || '057' || lpad(CAST(c_custkey AS VARCHAR), 6, '0') || CAST(c_custkey % 4 AS VARCHAR) AS geoid, 2023 AS year FROM customer""",
)
def _(t):
    text = lambda x: x.cast("string")
    income = F.when(c("c_custkey") % 5 == 0, fv.CENSUS_MISSING).otherwise(text(c("c_custkey") * 10))
    rent = F.when(c("c_custkey") % 7 == 0, "").otherwise("3")
    cells = {"NAME": c("c_name"), "B19013_001E": income, "B25064_001E": rent, "state": F.lit("53"), "county": F.lit("057"),
             "tract": F.lpad(text(c("c_custkey")), 6, "0"), "block group": text(c("c_custkey") % 4)}
    row = F.array(*[cells.get(h, F.lit("1")) for h in _HEADER])
    return rl.acs_to_table(t.customer.select(row.alias("row")), _HEADER).select("name", "median_income", "median_rent", "geoid", "year")


@query(
    "s09_zoning_rules",
    """SELECT p_brand || '-' || CAST(p_partkey AS VARCHAR) AS zone_code, p_type AS jurisdiction, CASE WHEN p_size % 3 = 0 THEN 43560e0 ELSE p_size * 100e0 END AS min_lot_size_sqft,
              CASE p_size % 4 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS allows_adu, CASE WHEN p_size % 2 = 0 THEN true ELSE false END AS allows_duplex FROM part""",
)
def _(t):
    unknown = F.lit(" unknown")
    rows = t.part.select(
        F.concat(F.lit(" "), "p_brand", F.lit("-"), c("p_partkey").cast("string")).alias("zone_code"), c("p_type").alias("jurisdiction"),
        F.when(c("p_size") % 3 == 0, unknown).otherwise((c("p_size") * 100).cast("string")).alias("min_lot_size_sqft"),
        *[unknown.alias(x) for x in ("max_lot_coverage_pct", "max_height_ft", "front_setback_ft", "side_setback_ft", "rear_setback_ft", "allows_multifamily")],
        F.when(c("p_size") % 4 == 0, "").when(c("p_size") % 4 == 1, "yes").otherwise("no").alias("allows_adu"),
        F.when(c("p_size") % 2 == 0, "T").otherwise("NONE").alias("allows_duplex"),
    )
    stale = rows.withColumn("min_lot_size_sqft", F.lit("1")).withColumn("line_no", F.lit(1))
    rows = rows.withColumn("line_no", F.lit(2)).unionByName(stale)
    return rl.load_zoning_rules(rows).select("zone_code", "jurisdiction", "min_lot_size_sqft", "allows_adu", "allows_duplex")


@query(
    "s10_place_records",
    """SELECT CAST(s_suppkey AS VARCHAR) AS place_id, s_name AS name, CAST(CASE WHEN s_suppkey % 3 = 0 THEN 0 ELSE s_suppkey END AS INT) AS review_count FROM supplier WHERE s_suppkey % 11 <> 0""",
)
def _(t):
    rec = F.struct(
        F.when(c("s_suppkey") % 11 != 0, c("s_suppkey").cast("string")).alias("place_id"), c("s_name").alias("name"),
        F.when(c("s_suppkey") % 3 != 0, F.concat(c("s_suppkey").cast("string"), F.lit(".0"))).otherwise("n/a").alias("reviews"),
    )
    flat = F.to_json(F.array(rec))
    nested = F.to_json(F.struct(F.array(F.array(rec)).alias("data")))
    docs = t.supplier.select(F.when(c("s_suppkey") % 2 == 0, flat).otherwise(nested).alias("json"))
    return rl.read_places(docs).select("place_id", "name", "review_count")
