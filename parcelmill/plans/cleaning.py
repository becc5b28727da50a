"""Queries for the text, code and number expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelmill.functions import cleaning as cl
from parcelmill.functions import codes as cd
from parcelmill.functions import fixed_values as fv
from parcelmill.functions import measures as ms
from parcelmill.functions import web as wb
from parcelmill.plans.registry import query

c = F.col


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return ", ".join(_q(v) for v in values)


def sql_prefixes(column: str, rules, otherwise: str = "NULL") -> str:
    cases = " ".join(
        "WHEN " + " OR ".join(f"starts_with({column}, {_q(p)})" for p in prefixes) + f" THEN {_q(name)}"
        for name, prefixes in rules
    )
    return f"CASE {cases} ELSE {otherwise} END"


def sql_map(column: str, table, otherwise: str = "NULL", text: bool = True) -> str:
    cases = " ".join(f"WHEN {_q(k)} THEN {_q(v) if text else v}" for k, v in table.items())
    return f"CASE {column} {cases} ELSE {otherwise} END"


@query("f01_parcel_ids", "SELECT id, regexp_replace(upper(trim(parcel_raw)), '[^A-Z0-9]', '', 'g') AS parcel FROM rawtext")
def _(t):
    return t.rawtext.select("id", cl.normalize_parcel(c("parcel_raw")).alias("parcel"))


@query(
    "f02_categories",
    f"SELECT id, CASE WHEN upper(trim(cat_raw)) NOT IN ({sql_list(fv.BLANK_CATEGORIES)}) THEN upper(trim(cat_raw)) END AS category FROM rawtext",
)
def _(t):
    return t.rawtext.select("id", cl.clean_category(c("cat_raw")).alias("category"))


@query(
    "f03_range_nulls",
    """SELECT id, CASE WHEN TRY_CAST(year_raw AS DOUBLE) BETWEEN 1700 AND 2050 THEN TRY_CAST(year_raw AS DOUBLE) END AS year_built,
              CASE WHEN TRY_CAST(year_raw AS DOUBLE) >= 1800 THEN TRY_CAST(year_raw AS DOUBLE) END AS roll_year_built,
              CASE WHEN TRY_CAST(area_raw AS DOUBLE) > 0 AND TRY_CAST(area_raw AS DOUBLE) <= 50000 THEN TRY_CAST(area_raw AS DOUBLE) END AS area
       FROM rawtext""",
)
def _(t):
    return t.rawtext.select(
        "id",
        cl.null_outside(c("year_raw"), 1700, 2050).alias("year_built"),
        cl.null_outside(c("year_raw"), 1800, None).alias("roll_year_built"),
        cl.null_outside(c("area_raw"), 0, 50000, low_open=True).alias("area"),
    )


@query(
    "f04_code_and_description",
    r"""WITH m AS (
          SELECT id, code_raw, trim(code_raw) AS tx, regexp_matches(trim(code_raw), '^\(([^)]+)\)\s*(.*)') AS hit FROM rawtext)
        SELECT id,
               nullif(regexp_extract(code_raw, '\((.*?)\)\s*(.*)', 1), '') AS raw_code,
               nullif(regexp_extract(code_raw, '\((.*?)\)\s*(.*)', 2), '') AS raw_desc,
               nullif(CASE WHEN hit THEN upper(trim(regexp_extract(tx, '^\(([^)]+)\)\s*(.*)', 1))) ELSE upper(tx) END, '') AS code,
               CASE WHEN hit THEN nullif(array_to_string(list_transform(
                   regexp_extract_all(lower(trim(regexp_extract(tx, '^\(([^)]+)\)\s*(.*)', 2))), '[a-z]+|[^a-z]+'),
                   lambda w: upper(w[1]) || w[2:]), ''), '') END AS description
        FROM m""",
)
def _(t):
    raw_code, raw_desc = cl.split_code_raw(c("code_raw"))
    code, desc = cl.split_code_desc(c("code_raw"))
    return t.rawtext.select(
        "id", raw_code.alias("raw_code"), raw_desc.alias("raw_desc"), code.alias("code"), desc.alias("description")
    )


@query("f05_digit_tokens", "SELECT id, nullif(regexp_replace(code_raw, '[^0-9]', '', 'g'), '') AS token FROM rawtext")
def _(t):
    return t.rawtext.select("id", cl.numeric_token(c("code_raw")).alias("token"))


_DISPLAY = [(v, (k,)) for k, v in fv.DISPLAY_CATEGORIES.items()]


@query(
    "f06_improvement_classes",
    f"""WITH k AS (SELECT id, type_raw AS code, {sql_map('type_raw', fv.EXACT_CODES)} AS exact_class,
                          CASE WHEN trim(type_raw) <> '' THEN {sql_prefixes('upper(trim(type_raw))', _DISPLAY)} END AS shown FROM rawtext)
        SELECT id, coalesce(exact_class, {sql_prefixes('code', fv.MASTER_PREFIXES)}, 'other') AS master_class,
               coalesce(exact_class, {sql_prefixes('code', fv.ROLL_PREFIXES)},
                        CASE shown WHEN 'garage' THEN 'garage' WHEN 'outbuilding' THEN 'outbuilding'
                                   WHEN 'home' THEN 'main_structure' ELSE 'misc' END) AS roll_class
        FROM k""",
)
def _(t):
    return t.rawtext.select(
        "id",
        cd.classify_improvement(c("type_raw"), "master").alias("master_class"),
        cd.classify_improvement(c("type_raw"), "roll").alias("roll_class"),
    )


@query(
    "f07_display_labels",
    f"""SELECT id, coalesce({sql_prefixes('upper(trim(type_raw))', _DISPLAY)}, 'other') AS category,
               CASE WHEN trim(type_raw) <> '' THEN coalesce({sql_map('upper(trim(type_raw))', fv.DISPLAY_LABELS)}, type_raw) END AS label
        FROM rawtext""",
)
def _(t):
    return t.rawtext.select(
        "id", cd.display_category(c("type_raw")).alias("category"), cd.display_label(c("type_raw")).alias("label")
    )


@query(
    "f08_code_scores",
    f"""SELECT detail_id, {sql_map('class_code', fv.QUALITY_SCORES, text=False)} AS quality_score,
               {sql_map('condition_code', fv.CONDITION_SCORES, text=False)} AS condition_score FROM improvements""",
)
def _(t):
    return t.improvements.select(
        "detail_id",
        cd.lookup(c("class_code"), fv.QUALITY_SCORES).alias("quality_score"),
        cd.lookup(c("condition_code"), fv.CONDITION_SCORES).alias("condition_score"),
    )


@query(
    "f09_bath_scores",
    f"""SELECT id, CAST(coalesce(list_sum(list_transform(string_split(plumbing_raw, ','),
               lambda w: {sql_map('upper(trim(w))', fv.MASTER_BATHS, '0', text=False)})), 0) AS DOUBLE) AS baths FROM rawtext""",
)
def _(t):
    return t.rawtext.select("id", cd.bath_score(c("plumbing_raw")).alias("baths"))


@query(
    "f10_bath_tokens",
    rf"""WITH tok AS (SELECT id, upper(trim(unnest(regexp_split_to_array(coalesce(plumbing_raw, ''), '[;,]+|\s+')))) AS k FROM rawtext),
         parts AS (SELECT id, k, regexp_extract(k, '^(\d+)([A-Z]+)', 1) AS d, regexp_extract(k, '^(\d+)([A-Z]+)', 2) AS b FROM tok),
         val AS (SELECT id, {sql_map("CASE WHEN d <> '' THEN b ELSE k END", fv.ROLL_BATHS, text=False)} AS v,
                        CASE WHEN d = '' THEN 1 WHEN length(d) = 1 AND b = 'QB' THEN 1
                             WHEN replace(d, d[1], '') = '' THEN CAST(d[1] AS INT) ELSE TRY_CAST(d AS INT) END AS n FROM parts)
         SELECT id, CAST(sum(CASE WHEN v = 1.0 THEN n ELSE 0 END) AS INT) AS full_baths,
                CAST(sum(CASE WHEN v = 0.5 THEN n ELSE 0 END) AS INT) AS half_baths,
                CAST(sum(CASE WHEN v = 0.75 THEN n ELSE 0 END) AS INT) AS quarter_baths FROM val GROUP BY id""",
)
def _(t):
    b = cd.bath_tokens(c("plumbing_raw"))
    return t.rawtext.select("id", b.alias("b")).select(
        "id", c("b.full").alias("full_baths"), c("b.half").alias("half_baths"), c("b.quarter").alias("quarter_baths")
    )


@query(
    "f11_messy_counts",
    r"""WITH m AS (SELECT id, lower(trim(count_raw)) AS s FROM rawtext),
        r AS (SELECT id, s, replace(replace(replace(replace(replace(s, '¾', '3/4'), '¼', '1/4'), '3qb', '3/4'), '3q', '3/4'), 'q', '0.25') AS k FROM m)
        SELECT id, CASE WHEN s IS NULL OR s IN ('na', 'n/a', 'none', '', '0') THEN NULL
               WHEN regexp_matches(k, '(\d+)\s*/\s*(\d+)') THEN
                    round(TRY_CAST(regexp_extract(k, '(\d+)\s*/\s*(\d+)', 1) AS DOUBLE)
                          / nullif(TRY_CAST(regexp_extract(k, '(\d+)\s*/\s*(\d+)', 2) AS DOUBLE), 0), 2)
               ELSE TRY_CAST(regexp_extract(k, '(\d+(\.\d+)?)', 1) AS DOUBLE) END AS value FROM r""",
)
def _(t):
    return t.rawtext.select("id", cl.parse_numeric(c("count_raw")).alias("value"))


@query(
    "f12_money_text",
    r"""SELECT id, coalesce(CAST(trunc(TRY_CAST(regexp_replace(money_raw, '[$,]', '', 'g') AS DOUBLE) + 0.5) AS BIGINT), 0) AS whole,
              TRY_CAST(nullif(regexp_replace(money_raw, '[^0-9.]', '', 'g'), '') AS DOUBLE) AS tax,
              TRY_CAST(regexp_replace(CASE WHEN trim(money_raw) LIKE '(%)' THEN '-' || substr(trim(money_raw), 2, length(trim(money_raw)) - 2)
                       ELSE trim(money_raw) END, '[$, ]', '', 'g') AS DOUBLE) AS amount FROM rawtext""",
)
def _(t):
    return t.rawtext.select(
        "id",
        cl.money_int(c("money_raw")).alias("whole"),
        cl.tax_amount(c("money_raw")).alias("tax"),
        cl.accounting_amount(c("money_raw")).alias("amount"),
    )


@query(
    "f13_price_text",
    r"""SELECT id, CAST(TRY_CAST(nullif(trim(regexp_replace(regexp_extract(price_raw, '\$?\s*\d+(?:[.,]\d{2})?', 0), '[$,]', '', 'g')), '')
               AS DECIMAL(10, 2)) AS DOUBLE) AS price FROM rawtext""",
)
def _(t):
    return t.rawtext.select("id", cl.price_decimal(c("price_raw")).cast("double").alias("price"))


@query(
    "f14_percent_text",
    "SELECT id, TRY_CAST(trim(regexp_replace(trim(percent_raw), '%$', '')) AS DOUBLE) AS percent FROM rawtext",
)
def _(t):
    return t.rawtext.select("id", cl.parse_percent(c("percent_raw")).alias("percent"))


@query(
    "f15_addresses",
    f"""SELECT id, CASE WHEN lower(trim(address_raw)) NOT IN ({sql_list(fv.BLANK_ADDRESSES)}) THEN trim(address_raw) END AS address,
               trim(coalesce(cat_raw, '') || ' ' || coalesce(address_raw, '') || ' ' || coalesce(code_raw, '')) AS situs FROM rawtext""",
)
def _(t):
    return t.rawtext.select(
        "id",
        cl.clean_address(c("address_raw")).alias("address"),
        cl.situs_address(c("cat_raw"), c("address_raw"), c("code_raw")).alias("situs"),
    )


@query(
    "f16_age_features",
    """WITH y AS (SELECT parcel_id, coalesce(nullif(eff_year_built, 0), nullif(year_built, 0)) AS fy, year_built + 10 AS renovated FROM parcels)
       SELECT parcel_id, fy AS improvement_year_built, CAST(greatest(2025 - fy, 0) AS DOUBLE) AS age,
              CAST(greatest(2025 - fy, 0) * greatest(2025 - fy, 0) AS DOUBLE) AS age_sq,
              CASE WHEN greatest(2025 - fy, 0) <= 10 THEN '0-10' WHEN greatest(2025 - fy, 0) <= 30 THEN '10-30'
                   WHEN greatest(2025 - fy, 0) <= 60 THEN '30-60' ELSE '60+' END AS age_bucket,
              CAST(greatest(2025 - renovated, 0) AS DOUBLE) AS renovation_age FROM y""",
)
def _(t):
    features = ms.age_features(F.lit(2025), [c("eff_year_built"), c("year_built")], c("year_built") + 10)
    return t.parcels.select("parcel_id", *[v.alias(k) for k, v in features.items()])


@query(
    "f17_market_groups",
    f"""SELECT id, CASE WHEN trim(code_raw) <> '' THEN {sql_prefixes('upper(trim(code_raw))', fv.AREAS_SHORT, "'OTHER'")} END AS area_short,
               CASE WHEN trim(code_raw) <> '' THEN {sql_prefixes('upper(trim(code_raw))', fv.AREAS_LONG, "'OTHER'")} END AS area_long FROM rawtext""",
)
def _(t):
    return t.rawtext.select(
        "id",
        cd.market_group(c("code_raw")).alias("area_short"),
        cd.market_group(c("code_raw"), fv.AREAS_LONG).alias("area_long"),
    )


@query(
    "f18_view_flags",
    "SELECT parcel_id, CASE WHEN " + " OR ".join(f"hood_code ILIKE '%{m}%'" for m in fv.VIEW_MARKS)
    + " THEN 1 ELSE 0 END AS is_view FROM parcels",
)
def _(t):
    return t.parcels.select("parcel_id", cd.is_view(c("hood_code")).alias("is_view"))


@query(
    "f19_candidate_codes",
    r"""WITH u AS (SELECT id, upper(trim(code_raw)) AS s FROM rawtext),
        l AS (SELECT id, s, nullif(regexp_extract(s, '\(([A-Z0-9]+)\)', 1), '') AS a, nullif(regexp_split_to_array(s, '[\s\-/]+')[1], '') AS b FROM u)
        SELECT id, CASE WHEN coalesce(s, '') = '' THEN ''
               ELSE s || CASE WHEN a IS NOT NULL AND a <> s THEN '|' || a ELSE '' END
                      || CASE WHEN b IS NOT NULL AND b <> s AND (a IS NULL OR b <> a) THEN '|' || b ELSE '' END END AS codes FROM l""",
)
def _(t):
    return t.rawtext.select("id", F.array_join(cl.candidate_codes(c("code_raw")), "|").alias("codes"))


@query(
    "f20_preferred_values",
    """SELECT parcel_id, coalesce(total_market_value, assessed_value) AS value,
              CAST(coalesce(eff_year_built, year_built) AS BIGINT) AS year_built FROM parcels""",
)
def _(t):
    return t.parcels.select(
        "parcel_id",
        ms.preferred(c("total_market_value"), c("assessed_value")).alias("value"),
        ms.preferred(c("eff_year_built"), c("year_built")).cast("bigint").alias("year_built"),
    )


@query(
    "f21_aspect_directions",
    """SELECT ix, iy, CASE WHEN a < 0 OR a >= 360 THEN NULL
              ELSE (['N', 'NE', 'E', 'SE', 'S', 'SW', 'W', 'NW'])[CAST(floor(((a + 22.5) % 360) / 45) AS INT) + 1] END AS direction
       FROM (SELECT ix, iy, z * 3 - 20 AS a FROM terrain)""",
)
def _(t):
    return t.terrain.select("ix", "iy", cd.aspect_direction(c("z") * 3 - 20).alias("direction"))


@query(
    "f22_yield_classes",
    """SELECT parcel_id, CASE WHEN quality_score IS NULL THEN 'UNKNOWN' WHEN quality_score * 1.1 < 1 THEN 'LOW'
              WHEN quality_score * 1.1 < 5 THEN 'MEDIUM' ELSE 'HIGH' END AS yield_class FROM parcels""",
)
def _(t):
    return t.parcels.select("parcel_id", cd.yield_class(c("quality_score") * 1.1).alias("yield_class"))


@query(
    "f23_urls",
    r"""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS s,
                          regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin,
                          regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
        SELECT page_id,
               regexp_replace(regexp_extract(s, '^([^?]*)', 1), '/+$', '')
                 || CASE WHEN strpos(s, '?') > 0 AND strpos(s, '?') < length(s) THEN substr(s, strpos(s, '?')) ELSE '' END AS normalized,
               origin || regexp_replace(CASE WHEN path = '' THEN '/' ELSE path END, '[^/]*$', '') || 'menu/lunch.pdf?x=1' AS relative,
               origin || '/a/c' AS rooted,
               regexp_extract(origin, '^([a-z]+:)', 1) || '//cdn.example.org/z' AS hosted
        FROM u""",
)
def _(t):
    url = c("url")
    return t.pages.select(
        "page_id",
        wb.normalize_url(url).alias("normalized"),
        wb.absolute_url(url, F.lit("menu/lunch.pdf?x=1")).alias("relative"),
        wb.absolute_url(url, F.lit("/a/b/../c")).alias("rooted"),
        wb.absolute_url(url, F.lit("//cdn.example.org/z")).alias("hosted"),
    )


def _contains(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(w)})" for w in words) + ")"


@query(
    "f24_menu_links",
    f"""WITH l AS (SELECT page_id, lower(trim(regexp_extract(html, '<title>([^<]*)', 1))) AS label, lower(url) AS target FROM pages)
        SELECT page_id, NOT {_contains('label', fv.OTHER_PAGE_WORDS)} AND NOT {_contains('target', fv.OTHER_PAGE_WORDS)}
               AND ({_contains('label', fv.MENU_WORDS)} OR {_contains('target', fv.MENU_WORDS)} OR suffix(target, '.pdf')) AS is_menu FROM l""",
)
def _(t):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return t.pages.select("page_id", wb.looks_like_menu(title, c("url")).alias("is_menu"))


@query(
    "f25_chain_names",
    "SELECT id, coalesce(regexp_matches(place_name, " + _q("(?i)" + "|".join(fv.CHAIN_PATTERNS)) + "), false) AS is_chain FROM rawtext",
)
def _(t):
    return t.rawtext.select("id", cd.is_franchise(c("place_name")).alias("is_chain"))


@query(
    "f26_display_numbers",
    """SELECT sale_id, round(sale_price * 1.07, 2) AS amount,
              CASE WHEN sale_price * 50 >= 1000000 THEN '$' || regexp_replace(printf('%.1f', round(sale_price * 50 / 1000000, 1)), '[.]0$', '') || 'M'
                   WHEN sale_price * 50 >= 1000 THEN '$' || regexp_replace(printf('%.1f', round(sale_price * 50 / 1000, 1)), '[.]0$', '') || 'K'
                   ELSE '$' || CAST(CAST(round(sale_price * 50, 0) AS BIGINT) AS VARCHAR) END AS short_text,
              regexp_replace(regexp_replace(printf('%.2f', floor((sale_id % 37) / 11.0 / 0.25 + 0.5) * 0.25), '0+$', ''), '[.]$', '') AS baths
       FROM sales""",
)
def _(t):
    return t.sales.select(
        "sale_id",
        ms.currency(c("sale_price") * 1.07).alias("amount"),
        ms.compact_currency(c("sale_price") * 50).alias("short_text"),
        ms.quarter_baths((c("sale_id") % 37) / 11.0).alias("baths"),
    )


@query(
    "f27_descriptions",
    """SELECT parcel_id, concat_ws(' ', address, 'Neighborhood:', hood_code, 'Land use code:', land_use_code,
              'Property type:', proptype, 'Building style:', building_style, 'Bedrooms:', bedrooms, 'Year built:', year_built) AS description
       FROM parcels""",
)
def _(t):
    text = cl.describe(
        [
            (None, c("address")),
            ("Neighborhood:", c("hood_code")),
            ("Land use code:", c("land_use_code")),
            ("Property type:", c("proptype")),
            ("Building style:", c("building_style")),
            ("Bedrooms:", c("bedrooms")),
            ("Year built:", c("year_built")),
        ]
    )
    return t.parcels.select("parcel_id", text.alias("description"))


@query(
    "f28_price_features",
    """SELECT sale_id, round(ln(1 + sale_price), 6) AS log_price, round(CASE WHEN living_area > 0 THEN sale_price / living_area END, 6) AS price_per_sqft
       FROM sales s JOIN parcels p ON s.parcel_id = p.parcel_id""",
)
def _(t):
    return t.sales.join(t.parcels, "parcel_id").select(
        "sale_id",
        F.round(F.log1p("sale_price"), 6).alias("log_price"),
        F.round(ms.price_per_sqft(c("sale_price"), c("living_area")), 6).alias("price_per_sqft"),
    )
