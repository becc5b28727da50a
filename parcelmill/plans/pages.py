"""Queries for page text, links and tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv
from parcelmill.functions import web as wb
from parcelmill.operators import pages as pg
from parcelmill.operators import summaries as sm
from parcelmill.plans.cleaning import _contains
from parcelmill.plans.registry import query

c = F.col


def _clean_sql(column: str) -> str:
    text = f"regexp_replace({column}, '(?is)<!--.*?-->', ' ', 'g')"
    for tag in fv.NON_CONTENT_TAGS:
        text = rf"regexp_replace({text}, '(?is)<{tag}\b[^>]*>.*?</{tag}\s*>', ' ', 'g')"
    text = f"regexp_replace({text}, '(?s)<[^>]*>', ' ', 'g')"
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


@query("h01_clean_text", f"SELECT page_id, {_clean_sql('html')} AS text FROM pages")
def _(t):
    return t.pages.select("page_id", wb.clean_html(c("html")).alias("text"))


@query(
    "h02_menu_links",
    rf"""WITH a AS (SELECT page_id, url, unnest(regexp_extract_all(html || '<a href="/menu/' || page_id || '.pdf#top">Lunch</a><a href=''/contact''>Menu</a>', '(?is)<a\b[^>]*>.*?</a>')) AS a FROM pages),
        p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract(a, '(?is)href\s*=\s*["'']([^"'']*)["'']', 1) AS href,
              lower(trim(regexp_replace(regexp_replace(a, '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g'))) AS label FROM a)
        SELECT DISTINCT page_id, CASE WHEN starts_with(href, '/') THEN regexp_replace(regexp_replace(origin || href, '#.*$', ''), '/+$', '') ELSE href END AS link FROM p
        WHERE href <> '' AND NOT {_contains('label', fv.OTHER_PAGE_WORDS)} AND NOT {_contains('lower(href)', fv.OTHER_PAGE_WORDS)}
          AND ({_contains('label', fv.MENU_WORDS)} OR {_contains('lower(href)', fv.MENU_WORDS)} OR suffix(lower(href), '.pdf'))""",
)
def _(t):
    more = F.concat(c("html"), F.lit('<a href="/menu/'), c("page_id").cast("string"), F.lit(""".pdf#top">Lunch</a><a href='/contact'>Menu</a>"""))
    return pg.page_links(t.pages.withColumn("html", more))


def _occ(word: str) -> str:
    return f"(length(text) - length(replace(text, '{word}', ''))) / {len(word)}"


@query(
    "h03_price_list_scores",
    rf"""WITH x AS (SELECT page_id, html, lower(regexp_replace(html, '(?s)<[^>]*>', '', 'g')) AS text FROM pages)
        SELECT page_id, CAST(2 * ({_occ('$')}) + {' + '.join(_occ(w) for w in fv.MENU_SCORE_WORDS)} + len(regexp_extract_all(text, '\$?\s*\d+(?:[.,]\d{{2}})?'))
               + CASE WHEN regexp_matches(html, '(?i)class\s*=\s*["''][^"'']*(menu|item|price|dish)') THEN 10 ELSE 0 END AS INT) AS score FROM x""",
)
def _(t):
    return t.pages.select("page_id", wb.menu_score(c("html")).alias("score"))


def _history_pages(t):
    cell = lambda tag, x: F.concat(F.lit(f"<{tag}>"), x, F.lit(f"</{tag}>"))
    line = F.concat(
        F.lit("<tr class=r>"), cell("td", c("value_year").cast("string")), cell("td", F.concat(F.lit(" $"), F.format_string("%.2f", c("market_total")))),
        F.when(c("value_year") % 4 == 0, F.lit("")).otherwise(cell("td", F.lit("A&amp;B"))), F.lit("</tr>"),
    )
    lines = t.history.select("parcel_id", line.alias("line")).groupBy("parcel_id").agg(F.array_join(F.collect_list("line"), "\n").alias("body"))
    html = F.concat(
        F.lit("<html><table><tr><td>x</td></tr></table><table border=1><tr><th>Account History For Parcel P</th></tr><tr><td>note</td></tr>"
              "<tr><td>VALUE YEAR</td><td>MARKET TOTAL</td><td>NOTE</td></tr>"), c("body"), F.lit("</table></html>"),
    )
    return lines.select("parcel_id", html.alias("html"))


@query(
    "h04_history_tables",
    """SELECT parcel_id, CAST(value_year AS VARCHAR) AS year, '$' || printf('%.2f', market_total) AS total, 'A&B' AS note FROM history WHERE value_year % 4 <> 0""",
)
def _(t):
    rows = pg.table_rows(_history_pages(t)).select("parcel_id", F.explode("rows").alias("r"))
    return rows.select("parcel_id", c("r")["VALUE YEAR"].alias("year"), c("r")["MARKET TOTAL"].alias("total"), c("r")["NOTE"].alias("note"))


@query(
    "h04_tables_to_values",
    """SELECT parcel_id, CAST(value_year AS BIGINT) AS value_year, CAST(floor(round(market_total, 2) + 0.5) AS BIGINT) AS total FROM history WHERE value_year % 4 <> 0""",
)
def _(t):
    return sm.explode_history(pg.table_rows(_history_pages(t))).select("parcel_id", c("value_year").cast("bigint").alias("value_year"), "total")


@query("h05_token_costs", "SELECT doc_id, round(length(text) / 4.0 / 1000.0 * 0.00015 * 1e6, 6) AS micro_usd FROM documents")
def _(t):
    return t.documents.select("doc_id", F.round(wb.estimate_cost(c("text"), fv.TOKEN_RATES["gpt-4o-mini"]) * 1e6, 6).alias("micro_usd"))


@query(
    "t05_changed_pages",
    """WITH s AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS site, TIMESTAMP '2024-01-01' + INTERVAL 1 DAY * CAST(page_id % 200 AS INT) AS fetched_at, sha256(html) AS hash FROM pages),
            r AS (SELECT *, row_number() OVER w AS rn, lead(hash) OVER w AS prev FROM s WINDOW w AS (PARTITION BY site ORDER BY fetched_at DESC, page_id DESC))
       SELECT site, page_id, hash, coalesce(hash <> prev, true) AS changed, fetched_at < TIMESTAMP '2024-06-01' - INTERVAL 90 DAY AS fetch_again FROM r WHERE rn = 1""",
)
def _(t):
    fetched = F.date_add(F.lit(dt.date(2024, 1, 1)), (c("page_id") % 200).cast("int")).cast("timestamp")
    shots = t.pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("site"), fetched.alias("fetched_at"), "html")
    return pg.changed_pages(shots, dt.datetime(2024, 6, 1), 90)
