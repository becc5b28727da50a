"""Snapshot merges: each returns the next state of a table as a plan.

Keyed rows meet in one full outer join, so both sides shuffle once on the key
and nothing is updated in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.functions.cleaning import price_decimal

c = F.col


def one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = (), last: bool = True) -> DataFrame:
    """One row per key: the last (or first) by `order`, ties by the other columns in their order."""
    rest = [x for x in df.columns if x not in keys]
    if not rest:
        return df.distinct()
    by = [(F.col(x) if isinstance(x, str) else x).alias(f"__o{i}") for i, x in enumerate(order)]
    ranked = F.struct(*by, F.struct(*rest).alias("__row"))
    return df.groupBy(*keys).agg((F.max if last else F.min)(ranked)["__row"].alias("__row")).select(*keys, "__row.*").select(*df.columns)


def _paired(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    old = target.select(*keys, F.struct(*[x for x in target.columns if x not in keys]).alias("__old"))
    new = source.select(*keys, F.struct(*[x for x in source.columns if x not in keys]).alias("__new"))
    return old.join(new, list(keys), "full_outer")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """Source values replace the target's given columns; unknown keys are added.

    Of source rows with one key the last by `order` counts (ties: by the other columns).
    """
    given = [x for x in source.columns if x not in keys]
    both = _paired(target, one_per_key(source, keys, order), keys)
    out = []
    for x in target.columns:
        if x in keys:
            out.append(c(x))
        elif x in given:
            out.append(F.when(c("__new").isNotNull(), c(f"__new.{x}")).otherwise(c(f"__old.{x}")).alias(x))
        else:
            out.append(c(f"__old.{x}").alias(x))
    return both.select(*out)


def insert_new(target: DataFrame, source: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """Target plus the source rows whose key it does not hold.

    Of source rows with one key the first by `order` counts (ties: by the other columns).
    """
    fresh = one_per_key(source, keys, order, last=False).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh, allowMissingColumns=True)


def truthy(x: Column, kind: str) -> Column:
    if kind == "string":
        return x != ""
    if kind == "boolean":
        return x
    return x != 0


def merge_changed(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """Overwrite only with truthy values that differ; `action` tells what happened.

    Of source rows with one key the last by `order` counts (ties: by the other columns).
    """
    kinds = {f.name: f.dataType.typeName() for f in target.schema.fields}
    both = _paired(target, one_per_key(source, keys, order), keys)
    changes, out = [], []
    for x in target.columns:
        if x in keys:
            out.append(c(x))
            continue
        old, new = c(f"__old.{x}"), c(f"__new.{x}") if x in source.columns else F.lit(None)
        if x in columns:
            change = F.coalesce(truthy(new, kinds[x]), F.lit(False)) & ~new.eqNullSafe(old)
            changes.append(change)
            out.append(F.when(c("__old").isNull() | change, new).otherwise(old).alias(x))
        else:
            out.append(F.when(c("__old").isNull(), new).otherwise(old).alias(x))
    changed = changes[0]
    for x in changes[1:]:
        changed = changed | x
    action = (
        F.when(c("__old").isNull(), "created").when(c("__new").isNotNull() & changed, "updated").otherwise("kept")
    )
    return both.select(*out, action.alias("action"))


def replace_scope(target: DataFrame, source: DataFrame, scope: Column) -> DataFrame:
    """Drop the target rows inside the scope and add the source rows."""
    return target.where(~F.coalesce(scope, F.lit(False))).unionByName(source, allowMissingColumns=True)


def undo_run(df: DataFrame, run_id: str | None = None) -> DataFrame:
    """Rows without the given run, or without the newest one."""
    if run_id is not None:
        return df.where(c("run_id") != run_id)
    newest = df.agg(F.max(F.struct("created_at", "run_id"))["run_id"]).scalar()
    return df.where(c("run_id") != newest)


def menu_items(items: DataFrame) -> DataFrame:
    """Trimmed, length-limited items with a parsed price; names need two letters.

    The limits are part of the format; `was_cut` marks rows that lost text to them.
    """
    name, text, section = (F.trim(F.coalesce(c(x), F.lit(""))) for x in ("name", "description", "section"))
    return items.where(F.length(name) >= 2).select(
        "place_id",
        "source_url",
        F.substring(name, 1, 255).alias("name"),
        F.substring(text, 1, 1000).alias("description"),
        price_decimal(c("price_text")).cast("decimal(8,2)").alias("price"),
        F.substring(section, 1, 255).alias("section"),
        F.lit("USD").alias("currency"),
        ((F.length(name) > 255) | (F.length(text) > 1000) | (F.length(section) > 255)).alias("was_cut"),
    )


def upsert_menu(target: DataFrame, items: DataFrame) -> DataFrame:
    keys = ["place_id", "source_url", "name"]
    return upsert(target, menu_items(items), keys)


def comp_key(parcel: Column, sale_date: Column, sale_price: Column) -> Column:
    """Identity of a comparable: its parcel, else its sale date and price."""
    date = F.coalesce(F.date_format(sale_date, "yyyy-MM-dd"), F.lit("no-date"))
    price = F.coalesce(sale_price.cast("string"), F.lit("no-price"))
    by_sale = F.concat(F.lit("sale:"), date, F.lit(":"), price)
    return F.coalesce(F.concat(F.lit("parcel:"), F.nullif(parcel.cast("string"), F.lit(""))), by_sale)
