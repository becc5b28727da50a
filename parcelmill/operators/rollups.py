"""Improvement rows rolled up to parcels: one aggregate per rule set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelmill.functions import codes as cd
from parcelmill.functions import fixed_values as fv
from parcelmill.functions.cleaning import clean_category, null_outside, title_words
from parcelmill.operators.joins import keep_first

c = F.col
KEY = "parcel_id"


def clean_improvements(df: DataFrame) -> DataFrame:
    """Cleaned codes, ranges, class, scores and bath value of the master rules."""
    return df.select(
        KEY,
        "detail_id",
        clean_category(c("type_code")).alias("type_code"),
        clean_category(c("class_code")).alias("class_code"),
        clean_category(c("condition_code")).alias("condition_code"),
        "plumbing",
        null_outside(c("area"), 0, 50000, low_open=True).alias("area"),
        null_outside(c("year_built"), 1700, 2050).cast("int").alias("year_built"),
        null_outside(c("eff_year_built"), 1700, 2050).cast("int").alias("eff_year_built"),
    )


def dedupe_improvements(df: DataFrame) -> DataFrame:
    """First row per parcel, type, area and both years; NULLs count as equal."""
    return keep_first(df, [KEY, "type_code", "area", "year_built", "eff_year_built"], [c("detail_id")])


def _sum_where(cond: Column, value: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))


def rollup_improvements(df: DataFrame) -> DataFrame:
    """Per-parcel areas, counts, flags, baths, years and primary structure.

    `df` holds cleaned, deduplicated rows. Every column comes from one aggregate,
    so the input is read and shuffled once, with partial sums before the shuffle.
    """
    kind = cd.classify_improvement(c("type_code"), "master")
    rows = df.select(
        "*",
        kind.alias("kind"),
        cd.lookup(c("class_code"), fv.QUALITY_SCORES).alias("quality_score"),
        cd.lookup(c("condition_code"), fv.CONDITION_SCORES).alias("condition_score"),
        cd.bath_score(c("plumbing")).alias("bath_value"),
    )
    main = c("kind") == "main_structure"
    rank = F.struct("area", "year_built", (-c("detail_id")).alias("d"))
    primary = F.max(
        F.when(main, F.struct(rank.alias("r"), "quality_score", "condition_score", "eff_year_built"))
    ).alias("primary")
    area = c("area")
    out = rows.groupBy(KEY).agg(
        F.sum("bath_value").alias("total_baths"),
        F.max("year_built").alias("year_built_max"),
        F.min("year_built").alias("year_built_min"),
        _sum_where(c("kind").isin("main_structure", "basement"), area).alias("total_living_area"),
        _sum_where(c("kind") == "garage", area).alias("total_garage_area"),
        _sum_where(c("kind") == "deck", area).alias("total_deck_area"),
        _sum_where(c("kind") == "porch", area).alias("total_porch_area"),
        _sum_where(c("kind") == "basement", area).alias("total_basement_area"),
        _sum_where(c("kind") == "shop", area).alias("total_shop_area"),
        F.count_if(c("kind") == "shop").alias("total_shop_count"),
        F.count_if(c("kind") == "shed").alias("total_shed_count"),
        _sum_where(c("kind") == "shed", area).alias("total_shed_area"),
        F.bool_or(c("kind") == "pool").alias("has_pool"),
        F.count_if(main).alias("main_structure_count"),
        primary,
    )
    return out.select(
        *[x for x in out.columns if x != "primary"],
        (c("main_structure_count") > 1).alias("flag_multi_structure"),
        c("primary.quality_score").alias("quality_score"),
        c("primary.condition_score").alias("condition_score"),
        c("primary.eff_year_built").alias("effective_year_built"),
    )


def accumulate_parcels(df: DataFrame) -> DataFrame:
    """Per-parcel facts of the roll rules in one aggregate.

    Values without evidence stay NULL: value sum without any value, baths
    without tokens, finished basement without a basement.
    """
    code = F.regexp_replace(F.upper(F.trim(c("type_code"))), r"\s+", "")
    rows = df.select(
        KEY,
        code.alias("code"),
        F.coalesce(F.nullif(c("area"), F.lit(0.0)), F.lit(0.0)).alias("a"),
        c("value").cast("bigint").alias("v"),
        F.inline(F.array(cd.bath_tokens(c("plumbing")))).alias("full", "half", "quarter"),
        cd.lookup(cd.norm(c("class_code")), fv.QUALITY_SCORES).alias("q"),
        cd.norm(c("condition_code")).alias("cc"),
        cd.lookup(cd.norm(c("condition_code")), fv.CONDITION_SCORES).alias("cs"),
        "eff_year_built",
        "year_built",
        "new_const_year",
        "fireplaces",
    ).where(c("code") != "")
    rows = rows.withColumn("k", cd.classify_improvement(c("code"), "roll")).withColumn(
        "w", F.when(cd.is_main_structure(c("code")), 2).otherwise(1)
    )
    outbuilding = c("k").isin("shop", "shed", "outbuilding")
    basement = c("k") == "basement"
    finished = F.bool_or(basement & cd.starts_with_any(c("code"), fv.FINISHED_BASEMENT_PREFIXES))
    value_rank = F.coalesce(c("v"), F.lit(0))
    best_condition = F.min(F.when(c("cs").isNotNull(), F.struct((-c("cs")).alias("s"), (-c("w")).alias("w"), "cc", "cs")))
    best_effective = F.max(F.when(c("eff_year_built").isNotNull(), F.struct(value_rank.alias("v"), "eff_year_built")))
    best_actual = F.max(F.when(c("year_built").isNotNull(), F.struct(value_rank.alias("v"), "year_built")))
    out = rows.groupBy(KEY).agg(
        _sum_where(outbuilding, c("a")).alias("total_outbuilding_area"),
        _sum_where(c("k") == "deck", c("a")).alias("total_deck_area"),
        _sum_where(c("k") == "porch", c("a")).alias("total_porch_area"),
        _sum_where(c("k") == "garage", c("a")).alias("total_garage_area"),
        _sum_where(basement, c("a")).alias("total_basement_area"),
        (_sum_where(c("k") == "main_structure", c("a")) + _sum_where(basement, c("a"))).alias("calculated_sqft"),
        F.sum("v").alias("total_improvement_value"),
        F.count_if(c("k") == "shed").alias("number_of_sheds"),
        F.count_if(c("k") == "shop").alias("number_of_shops"),
        F.count_if(outbuilding | (c("k") == "garage")).alias("number_of_outbuildings"),
        F.coalesce(F.sum("fireplaces"), F.lit(0)).alias("number_of_fireplaces"),
        F.bool_or(c("k") == "pool").alias("has_pool"),
        F.bool_or(c("k") == "shop").alias("has_shop"),
        F.bool_or((c("k") == "deck") & (c("a") > 0)).alias("has_deck"),
        F.when(finished, True).when(F.bool_or(basement), False).alias("has_finished_basement"),
        F.sum("full").alias("bf"),
        F.sum("half").alias("bh"),
        F.sum("quarter").alias("bq"),
        (F.sum(c("q") * c("w")) / F.sum(F.when(c("q").isNotNull(), c("w")))).alias("quality_score"),
        best_condition.alias("bc"),
        F.coalesce(best_effective["eff_year_built"], best_actual["year_built"]).alias("improvement_year_built"),
        F.max("new_const_year").alias("new_construction_year"),
    )
    seen = (c("bf") + c("bh") + c("bq")) > 0
    return out.select(
        *[x for x in out.columns if x not in ("bf", "bh", "bq", "bc")],
        F.when(seen, c("bf") + c("bh") * 0.5 + c("bq") * 0.25).alias("bathrooms"),
        F.when(seen, c("bf")).alias("full_bathrooms"),
        F.when(seen, c("bh")).alias("half_bathrooms"),
        c("bc.cc").alias("condition_code"),
        c("bc.cs").alias("condition_score"),
    )


def quality_condition_simple(df: DataFrame) -> DataFrame:
    """Plain mean quality and best condition over main-area rows; default code U."""
    code = cd.norm(c("type_code"))
    cc = cd.norm(c("condition_code"))
    rows = df.where(cd.starts_with_any(code, fv.MAIN_AREA_PREFIXES)).select(
        KEY,
        cd.lookup(cd.norm(c("class_code")), fv.QUALITY_SCORES).alias("q"),
        cc.alias("cc"),
        cd.lookup(cc, fv.CONDITION_SCORES).alias("cs"),
    )
    best = F.min(F.when(c("cs").isNotNull(), F.struct((-c("cs")).alias("s"), "cc", "cs")))
    return rows.groupBy(KEY).agg(F.avg("q").alias("quality_score"), best.alias("b")).select(
        KEY,
        "quality_score",
        F.coalesce(c("b.cc"), F.lit("U")).alias("condition_code"),
        F.coalesce(c("b.cs"), F.lit(fv.CONDITION_SCORES["U"])).alias("condition_score"),
    )


def bath_totals(df: DataFrame) -> DataFrame:
    """Bath sum per parcel over home-type rows with a plumbing code."""
    home = cd.starts_with_any(F.upper(c("type_code")), fv.HOME_PREFIXES)
    rows = df.where(home & (F.trim(c("plumbing")) != ""))
    return rows.groupBy(KEY).agg(F.sum(cd.bath_score(c("plumbing"), fv.HOME_BATHS)).alias("bathrooms"))


def detail_order() -> list[Column]:
    """Order of detail rows: id, then newest years (unknown first), value and row id."""
    return [
        c("improvement_id").asc_nulls_last(),
        c("eff_year_built").desc_nulls_first(),
        c("year_built").desc_nulls_first(),
        c("value").desc_nulls_first(),
        c("detail_id").desc(),
    ]


def dedupe_details(df: DataFrame) -> DataFrame:
    """Best row per parcel, improvement id and type; rows without an id all stay.

    One pass over the rows: those without an id get a key of their own.
    """
    known = c("improvement_id").isNotNull() & (c("improvement_id") != 0)
    keyed = df.withColumns({"__t": F.coalesce(cd.norm(c("type_code")), F.lit("")), "__own": F.when(~known, F.monotonically_increasing_id())})
    order = W.partitionBy(KEY, "improvement_id", "__t", "__own").orderBy(*detail_order())
    return keyed.withColumn("__rn", F.row_number().over(order)).where(c("__rn") == 1).drop("__rn", "__t", "__own")


def display_rollup(df: DataFrame) -> DataFrame:
    """Compact description of a parcel's buildings from deduplicated detail rows.

    Rows shrink to one line per parcel, code, quality and condition; these are dealt by parcel once, and
    all else is found there. So rows are read once, and lists are bounded by the number of codes, not by the rows.
    """
    code = cd.norm(c("type_code"))
    main = code.startswith("MA")
    suffix = F.replace(F.substr(c("code"), F.lit(3)), F.lit("_"), F.lit("."))
    story = F.when(suffix.try_cast("double").isNotNull(), suffix).otherwise(F.lit("1"))
    position = F.struct(
        c("improvement_id").isNull().alias("a"),
        c("improvement_id").alias("b"),
        c("eff_year_built").isNotNull().alias("c"),
        (-c("eff_year_built")).alias("d"),
        c("year_built").isNotNull().alias("e"),
        (-c("year_built")).alias("f"),
        (-c("value")).alias("g"),
        (-c("detail_id")).alias("h"),
    )
    rows = df.select(
        KEY,
        code.alias("code"),
        F.coalesce(c("area"), F.lit(0.0)).alias("area"),
        F.when(main, F.nullif(cd.norm(c("class_code")), F.lit(""))).alias("qc"),
        F.when(main, F.nullif(cd.norm(c("condition_code")), F.lit(""))).alias("cc"),
        F.when(F.trim(c("building_style")) != "", F.struct(position.alias("p"), "building_style")).alias("st"),
    ).where(c("code") != "")

    lines = rows.groupBy(KEY, "code", "qc", "cc").agg(F.sum("area").alias("area"), F.count(F.lit(1)).alias("n"), F.min("st").alias("st"))
    is_main = c("code").startswith("MA")
    total = lambda value, *keys: F.sum(value).over(W.partitionBy(KEY, *keys))
    summed = lines.repartition(KEY).withColumns({"main": is_main, "story": F.when(is_main, story)}).withColumns({
        "code_area": total("area", "code"), "code_n": total("n", "code"), "story_area": total("area", "main", "story"),
        "quality_n": total("n", "qc"), "condition_n": total("n", "cc"),
    })
    weights = F.coalesce(cd.lookup(c("qc"), fv.QUALITY_WEIGHTS), F.lit(0))
    rank = F.coalesce(cd.lookup(c("cc"), fv.CONDITION_ORDER), F.lit(-1))
    story_line = F.struct("story", F.round("story_area").cast("int").alias("sqft"))
    component = F.struct((-c("code_area")).alias("o"), "code", c("code_n").alias("n"), F.round("code_area").cast("int").alias("sqft"))
    stories = F.sort_array(F.collect_set(F.when(c("main") & (c("story_area") != 0), story_line)))
    joined = summed.groupBy(KEY).agg(
        F.min("st")["building_style"].alias("style_raw"),
        _sum_where(c("main"), c("area")).alias("main_area"),
        F.min(F.when(c("main"), F.struct((-c("code_area")).alias("a"), "code")))["code"].alias("main_code"),
        F.sort_array(F.collect_set(F.when(~c("main"), component))).alias("others"),
        F.when(F.size(stories) > 0, stories).alias("by_story"),
        F.min(F.when(c("qc").isNotNull(), F.struct((-weights).alias("w"), (-c("quality_n")).alias("n"), "qc")))["qc"].alias("quality_code"),
        F.min(F.when(c("cc").isNotNull(), F.struct((-c("condition_n")).alias("n"), (-rank).alias("w"), "cc")))["cc"].alias("condition_code"),
    )
    # Rows without a parcel are one line without what was found per story, quality and condition.
    joined = joined.withColumns({x: F.when(c(KEY).isNotNull(), c(x)) for x in ("by_story", "quality_code", "condition_code")})
    fallback = c("main_code").isNull()
    kept = F.when(fallback & (F.size("others") > 0), F.slice(c("others"), 2, F.greatest(F.size("others") - 1, F.lit(1)))).otherwise(c("others"))
    primary = F.coalesce(c("main_code"), F.try_element_at(c("others"), F.lit(1))["code"])
    primary_area = F.when(fallback, F.try_element_at(c("others"), F.lit(1))["sqft"]).otherwise(F.round("main_area").cast("int"))
    return joined.select(
        KEY,
        title_words(c("style_raw")).alias("style"),
        "quality_code",
        cd.lookup(c("quality_code"), fv.QUALITY_LABELS).alias("quality"),
        "condition_code",
        cd.lookup(c("condition_code"), fv.CONDITION_LABELS).alias("condition"),
        F.round("main_area").cast("int").alias("main_sqft"),
        F.map_from_entries(c("by_story")).alias("by_story"),
        F.transform(
            kept,
            lambda x: F.struct(
                x["code"].alias("code"), cd.display_label(x["code"]).alias("label"), x["n"].alias("count"),
                x["sqft"].alias("total_sqft"), cd.display_category(x["code"]).alias("category"),
            ),
        ).alias("components"),
        primary.alias("primary_code"),
        F.coalesce(cd.display_label(primary), title_words(c("style_raw")), F.lit("Home")).alias("primary_label"),
        F.nullif(primary_area, F.lit(0)).alias("primary_sqft"),
    )
