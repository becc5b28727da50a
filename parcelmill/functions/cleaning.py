"""Column expressions that clean and parse raw roll text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv


def null_if_blank(c: Column) -> Column:
    return F.when(c != "", c)


def normalize_parcel(c: Column) -> Column:
    """Upper case, letters and digits only."""
    return F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]", "")


def clean_category(c: Column) -> Column:
    text = F.upper(F.trim(c))
    return F.when(~text.isin(*fv.BLANK_CATEGORIES), text)


def null_outside(c: Column, low: float | None, high: float | None, low_open: bool = False) -> Column:
    """Numeric value of `c`, NULL when outside [low, high] (or at `low` when open)."""
    number = c.try_cast("double")
    ok = F.lit(True)
    if low is not None:
        ok = ok & ((number > low) if low_open else (number >= low))
    if high is not None:
        ok = ok & (number <= high)
    return F.when(ok, number)


def title_words(c: Column) -> Column:
    """Lower case with every run of letters capitalized."""
    pieces = F.split(F.lower(c), r"(?<=\P{L})")
    return F.array_join(
        F.transform(pieces, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), ""
    )


def split_code_raw(c: Column) -> tuple[Column, Column]:
    """Code and description of the first "(code) description" found in the text."""
    pattern = r"\((.*?)\)\s*(.*)"
    return null_if_blank(F.regexp_extract(c, pattern, 1)), null_if_blank(F.regexp_extract(c, pattern, 2))


def split_code_desc(c: Column) -> tuple[Column, Column]:
    """Upper-case code and title-case description; plain text is all code."""
    text = F.trim(c)
    pattern = r"^\(([^)]+)\)\s*(.*)"
    found = text.rlike(pattern)
    code = F.when(found, F.upper(F.trim(F.regexp_extract(text, pattern, 1)))).otherwise(F.upper(text))
    desc = F.when(found, title_words(F.trim(F.regexp_extract(text, pattern, 2))))
    return null_if_blank(code), null_if_blank(desc)


def numeric_token(c: Column) -> Column:
    return null_if_blank(F.regexp_replace(c, "[^0-9]", ""))


def parse_numeric(c: Column) -> Column:
    """Room count from messy text: fractions, quarter marks, first number."""
    text = F.lower(F.trim(c))
    marked = text
    for mark, value in (("¾", "3/4"), ("¼", "1/4"), ("3qb", "3/4"), ("3q", "3/4"), ("q", "0.25")):
        marked = F.replace(marked, F.lit(mark), F.lit(value))
    fraction = r"(\d+)\s*/\s*(\d+)"
    top = F.regexp_extract(marked, fraction, 1).try_cast("double")
    bottom = F.regexp_extract(marked, fraction, 2).try_cast("double")
    number = F.regexp_extract(marked, r"(\d+(\.\d+)?)", 1).try_cast("double")
    return F.when(
        ~text.isin(*fv.BLANK_COUNTS),
        F.when(marked.rlike(fraction), F.round(F.try_divide(top, bottom), 2)).otherwise(number),
    )


def money_int(c: Column) -> Column:
    """Whole money from text, rounded half up; anything unreadable is 0."""
    number = F.regexp_replace(c, "[$,]", "").try_cast("double")
    return F.coalesce((number + 0.5).cast("bigint"), F.lit(0).cast("bigint"))


def tax_amount(c: Column) -> Column:
    """Digits and dots of the text as a number."""
    return null_if_blank(F.regexp_replace(c, "[^0-9.]", "")).try_cast("double")


def accounting_amount(c: Column) -> Column:
    """Money text where parentheses mean a negative amount."""
    text = F.trim(c)
    signed = F.when(text.rlike(r"^\(.*\)$"), F.concat(F.lit("-"), F.regexp_replace(text, r"^\(|\)$", ""))).otherwise(text)
    return F.regexp_replace(signed, "[$, ]", "").try_cast("double")


def price_decimal(c: Column) -> Column:
    """First price in the text."""
    found = F.trim(F.regexp_replace(F.regexp_extract(c, fv.PRICE_PATTERN, 0), "[$,]", ""))
    return null_if_blank(found).try_cast("decimal(10,2)")


def parse_percent(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(c), "%$", "")).try_cast("double")


def clean_address(c: Column) -> Column:
    text = F.trim(c)
    return F.when(~F.lower(text).isin(*fv.BLANK_ADDRESSES), text)


def situs_address(*parts: Column) -> Column:
    return F.trim(F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts]))


def candidate_codes(c: Column) -> Column:
    """Spellings under which a neighborhood may be stored, best first."""
    text = F.upper(F.trim(c))
    inside = null_if_blank(F.regexp_extract(text, r"\(([A-Z0-9]+)\)", 1))
    first = null_if_blank(F.split(text, r"[\s\-/]+")[0])
    return F.when(
        F.coalesce(text, F.lit("")) != "", F.array_distinct(F.array_compact(F.array(text, inside, first)))
    ).otherwise(F.array().cast("array<string>"))


def describe(parts: list[tuple[str | None, Column]]) -> Column:
    """Label and value words joined by blanks; NULL values drop out, labels stay."""
    words: list[Column] = []
    for label, value in parts:
        if label:
            words.append(F.lit(label))
        words.append(value.cast("string"))
    return F.concat_ws(" ", *words)


def pick_keys(c: Column, keys: tuple[str, ...]) -> Column:
    """First value that reads as a percent among alternative keys of a map."""
    return F.coalesce(*[parse_percent(F.try_element_at(c, F.lit(k))) for k in keys])
