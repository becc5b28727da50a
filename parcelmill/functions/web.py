"""Column expressions for URLs and page text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv

_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(c, _SPLIT, group)


def normalize_url(c: Column) -> Column:
    """Scheme, host and path without trailing slashes, then the query; no fragment."""
    base = F.regexp_replace(F.concat(_part(c, 1), F.lit("://"), _part(c, 2), _part(c, 3)), "/+$", "")
    query = _part(c, 4)
    return F.when(query != "", F.concat(base, F.lit("?"), query)).otherwise(base)


def _squeeze(path: Column) -> Column:
    """Resolve `.` and `..` segments of an absolute path."""
    segments = F.slice(F.split(path, "/"), 2, 1_000_000)
    tail = F.when(path.rlike(r"/\.{0,2}$"), F.lit("/")).otherwise(F.lit(""))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(
        segments,
        empty,
        lambda acc, s: F.when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(empty))
        .when(s.isin("."), acc)
        .otherwise(F.array_append(acc, s)),
    )
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    return F.when(joined.endswith("/"), joined).otherwise(F.concat(joined, F.when(path.rlike(r"/\.{1,2}$"), tail).otherwise(F.lit(""))))


def absolute_url(base: Column, link: Column) -> Column:
    """Resolve a link found on the page `base`."""
    origin = F.concat(_part(base, 1), F.lit("://"), _part(base, 2))
    base_path = F.when(_part(base, 3) == "", F.lit("/")).otherwise(_part(base, 3))
    base_query = F.when(_part(base, 4) != "", F.concat(F.lit("?"), _part(base, 4))).otherwise(F.lit(""))
    link_path = _part(link, 3)
    rest = F.substr(link, F.length(link_path) + 1)
    folder = F.regexp_replace(base_path, "[^/]*$", "")
    full = F.when(link_path.startswith("/"), link_path).otherwise(F.concat(folder, link_path))
    squeezed = F.when(full.rlike(r"(^|/)\.\.?(/|$)"), _squeeze(full)).otherwise(full)
    return (
        F.when(_part(link, 1) != "", link)
        .when(link == "", base)
        .when(link.startswith("//"), F.concat(_part(base, 1), F.lit(":"), link))
        .when(link.startswith("#"), F.concat(origin, _part(base, 3), base_query, link))
        .when(link.startswith("?"), F.concat(origin, _part(base, 3), link))
        .otherwise(F.concat(origin, squeezed, rest))
    )


def _has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def looks_like_menu(text: Column, href: Column) -> Column:
    """Link that leads to a price list: no veto word, then a menu word or a PDF."""
    label = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    target = F.lower(F.coalesce(href, F.lit("")))
    veto = _has_any(label, fv.OTHER_PAGE_WORDS) | _has_any(target, fv.OTHER_PAGE_WORDS)
    wanted = _has_any(label, fv.MENU_WORDS) | _has_any(target, fv.MENU_WORDS) | target.endswith(".pdf")
    return ~veto & wanted


def clean_html(c: Column) -> Column:
    """Page text without scripts, styles, navigation and tags; blanks collapsed."""
    text = F.regexp_replace(c, r"(?is)<!--.*?-->", " ")
    for tag in fv.NON_CONTENT_TAGS:
        text = F.regexp_replace(text, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    text = F.regexp_replace(text, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _occurrences(text: Column, word: str) -> Column:
    gone = F.length(F.replace(text, F.lit(word), F.lit("")))
    return ((F.length(text) - gone) / len(word)).cast("int")


def page_text(c: Column) -> Column:
    """All text between tags, in lower case."""
    return F.lower(F.regexp_replace(c, r"(?s)<[^>]*>", ""))


def menu_score(c: Column) -> Column:
    """Score of a page as a price list: dollar signs, dish words, prices, class hints."""
    text = page_text(F.coalesce(c, F.lit("")))
    score = _occurrences(text, "$") * 2 + F.regexp_count(text, F.lit(fv.PRICE_PATTERN))
    for word in fv.MENU_SCORE_WORDS:
        score = score + _occurrences(text, word)
    hint = c.rlike(r"""(?i)class\s*=\s*["'][^"']*(menu|item|price|dish)""")
    return score + F.when(hint, 10).otherwise(0)


def estimate_cost(c: Column, rate: float = fv.TOKEN_RATE_DEFAULT) -> Column:
    """Cost of sending the text to a model: four characters per token, rate per 1000."""
    return F.length(F.coalesce(c, F.lit(""))) / 4.0 / 1000.0 * rate
