"""Column expressions that turn assessor codes into classes and scores."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelmill.functions import fixed_values as fv


def norm(c: Column) -> Column:
    return F.upper(F.trim(c))


def lookup(c: Column, table: Mapping[str, object]) -> Column:
    """Value of a literal map; NULL for keys it does not hold."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), c)


def starts_with_any(c: Column, prefixes: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def first_prefix(c: Column, rules: Iterable[tuple[str, tuple[str, ...]]], otherwise: Column | None = None) -> Column:
    """Name of the first rule with a matching prefix."""
    out = None
    for name, prefixes in rules:
        hit = starts_with_any(c, prefixes)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out.otherwise(otherwise) if otherwise is not None else out


def display_category(c: Column) -> Column:
    code = norm(c)
    rules = [(category, (prefix,)) for prefix, category in fv.DISPLAY_CATEGORIES.items()]
    return F.coalesce(F.when(code != "", first_prefix(code, rules)), F.lit("other"))


def display_label(c: Column) -> Column:
    code = norm(c)
    return F.when(code != "", F.coalesce(lookup(code, fv.DISPLAY_LABELS), c))


def type_label(c: Column) -> Column:
    code = norm(c)
    return F.when(code.startswith("MA"), F.lit(fv.DISPLAY_LABELS["MA"])).otherwise(display_label(c))


def classify_improvement(c: Column, ruleset: str = "master") -> Column:
    """Improvement class of a code under the `master` or the `roll` rule set."""
    exact = lookup(c, fv.EXACT_CODES)
    if ruleset == "master":
        return F.coalesce(exact, first_prefix(c, fv.MASTER_PREFIXES), F.lit("other"))
    if ruleset != "roll":
        raise ValueError(f"unknown rule set {ruleset}")
    shown = display_category(c)
    fallback = (
        F.when(shown == "garage", "garage")
        .when(shown == "outbuilding", "outbuilding")
        .when(shown == "home", "main_structure")
        .otherwise("misc")
    )
    return F.coalesce(exact, first_prefix(c, fv.ROLL_PREFIXES), fallback)


def is_main_structure(c: Column) -> Column:
    return starts_with_any(c, fv.MAIN_PREFIXES)


def bath_score(c: Column, values: Mapping[str, float] = fv.MASTER_BATHS) -> Column:
    """Sum of the values of comma-separated bath tokens."""
    tokens = F.transform(F.split(F.coalesce(c, F.lit("")), ","), norm)
    return F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + F.coalesce(lookup(t, values), F.lit(0.0)))


def bath_tokens(c: Column) -> Column:
    """Struct of full, half and quarter baths named by tokens such as ``2FB``."""
    pattern = r"^(\d+)([A-Z]+)"

    # Each step names its results in a struct, so nothing is evaluated twice.
    def parse(token: Column) -> Column:
        return F.struct(
            token.alias("t"), F.regexp_extract(token, pattern, 1).alias("d"), F.regexp_extract(token, pattern, 2).alias("b")
        )

    def weigh(e: Column) -> Column:
        digits, first = e["d"], F.substring(e["d"], 1, 1)
        many = (
            F.when(digits == "", F.lit(1))
            .when((F.length(digits) == 1) & (e["b"] == "QB"), F.lit(1))
            .when(F.length(F.replace(digits, first, F.lit(""))) == 0, first.try_cast("int"))
            .otherwise(digits.try_cast("int"))
        )
        name = F.when(digits == "", e["t"]).otherwise(e["b"])
        return F.struct(lookup(name, fv.ROLL_BATHS).alias("v"), F.coalesce(many, F.lit(1)).alias("n"))

    def add(acc: Column, e: Column) -> Column:
        return F.struct(
            *[
                (acc[name] + F.when(e["v"] == size, e["n"]).otherwise(F.lit(0))).alias(name)
                for name, size in (("full", 1.0), ("half", 0.5), ("quarter", 0.75))
            ]
        )

    tokens = F.transform(F.split(F.coalesce(c, F.lit("")), r"[;,]+|\s+"), norm)
    weighed = F.transform(F.transform(tokens, parse), weigh)
    zero = F.struct(F.lit(0).alias("full"), F.lit(0).alias("half"), F.lit(0).alias("quarter"))
    return F.aggregate(weighed, zero, add)


def market_group(c: Column, areas=fv.AREAS_SHORT) -> Column:
    """Market area of a hood code; blank gives NULL, unknown gives OTHER."""
    code = norm(c)
    return F.when(code != "", first_prefix(code, areas, F.lit("OTHER")))


def is_view(c: Column) -> Column:
    hits = [F.contains(F.upper(c), F.lit(mark)) for mark in fv.VIEW_MARKS]
    return F.when(reduce(lambda a, b: a | b, hits), 1).otherwise(0)


def is_franchise(c: Column) -> Column:
    return F.coalesce(c.rlike("(?i)" + "|".join(fv.CHAIN_PATTERNS)), F.lit(False))


def aspect_direction(c: Column) -> Column:
    """Eight-way compass point of degrees; values outside [0, 360) give NULL."""
    degrees = F.when((c >= 0) & (c < 360), c)
    return (
        F.when((degrees >= 337.5) | (degrees < 22.5), "N")
        .when(degrees < 67.5, "NE")
        .when(degrees < 112.5, "E")
        .when(degrees < 157.5, "SE")
        .when(degrees < 202.5, "S")
        .when(degrees < 247.5, "SW")
        .when(degrees < 292.5, "W")
        .when(degrees < 337.5, "NW")
    )


def yield_class(c: Column) -> Column:
    return F.when(c.isNull(), "UNKNOWN").when(c < 1, "LOW").when(c < 5, "MEDIUM").otherwise("HIGH")
