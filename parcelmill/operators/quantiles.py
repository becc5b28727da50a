"""Exact quantiles per group that never gather a whole group in one task.

Values are first reduced to (group, value, count), spread by group *and* value.
A monotone bucket of the value gives a small histogram per group; running totals
over that histogram tell which bucket holds the wanted ranks, and only rows of
those buckets are ranked. A group that owns a third of the table is therefore
split over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STEPS_PER_OCTAVE = 256


def value_bucket(value: Column) -> Column:
    """Monotone bucket of a double: fixed relative width on both sides of zero."""
    size = F.floor(F.log2(F.abs(value)) * STEPS_PER_OCTAVE) + 1_000_000
    return F.when(value > 0, size).when(value < 0, -size - 1).otherwise(F.lit(0)).cast("bigint")


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join per-group columns onto rows; groups with a NULL key match too.

    Without keys `right` is a single row and is read as a scalar subquery.
    """
    if not keys:
        row = right.select(F.struct(*right.columns)).scalar()
        return left.select("*", *[row[x].alias(x) for x in right.columns])
    marked = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(marked, cond, how).drop(*[f"__{k}" for k in keys])


def _ranked(counts: DataFrame, keys: list[str], probs: Sequence[float], discrete: bool) -> DataFrame:
    """Quantiles of (keys, __v, __n) rows as columns q0, q1, ..."""
    rows = counts.withColumn("__b", value_bucket(F.col("__v")))
    by_group = W.partitionBy(*keys)
    running = by_group.orderBy("__b").rowsBetween(W.unboundedPreceding, W.currentRow)
    hist = (
        rows.groupBy(*keys, "__b")
        .agg(F.sum("__n").alias("__bn"))
        .withColumn("__start", F.sum("__bn").over(running) - F.col("__bn"))
        .withColumn("__total", F.sum("__bn").over(by_group))
    )

    def ranks(p: float) -> tuple[Column, Column, Column]:
        if discrete:
            low = F.greatest(F.ceil(F.lit(p) * F.col("__total")) - 1, F.lit(0))
            return low, low, F.lit(0.0)
        position = F.lit(p) * (F.col("__total") - 1)
        low = F.floor(position)
        return low, F.ceil(position), position - low

    wanted = []
    for p in probs:
        low, high, _ = ranks(p)
        wanted.append(low.between(F.col("__start"), F.col("__start") + F.col("__bn") - 1))
        wanted.append(high.between(F.col("__start"), F.col("__start") + F.col("__bn") - 1))
    hits = hist.where(reduce(lambda a, b: a | b, wanted)).drop("__bn")
    inside = attach(rows, hits, [*keys, "__b"], "inner")
    order = W.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = inside.withColumn("__end", F.col("__start") + F.sum("__n").over(order)).withColumn(
        "__first", F.col("__end") - F.col("__n")
    )
    aggs: list[Column] = []
    for i, p in enumerate(probs):
        low, high, _ = ranks(p)
        for name, rank in (("lo", low), ("hi", high)):
            holds = rank.between(F.col("__first"), F.col("__end") - 1)
            aggs.append(F.max(F.when(holds, F.col("__v"))).alias(f"__{name}{i}"))
    out = placed.groupBy(*keys, "__total").agg(*aggs)
    picks = []
    for i, p in enumerate(probs):
        _, _, share = ranks(p)
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        picks.append((low + (high - low) * share).alias(f"q{i}"))
    return out.select(*keys, *picks)


def group_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    weight: str | None = None,
    discrete: bool = False,
) -> DataFrame:
    """Exact quantiles of `value` per group; `probs` maps output names to probabilities.

    Interpolates between neighbors like PERCENTILE_CONT unless `discrete`.
    `weight` names a count column when rows are already reduced.
    """
    keys = list(keys)
    work = df.where(F.col(value).isNotNull()).withColumn("__v", F.col(value).cast("double"))
    if not keys:
        work = work.withColumn("__all", F.lit(0))
    by = keys or ["__all"]
    n = F.sum(weight) if weight else F.count(F.lit(1))
    counts = work.groupBy(*by, "__v").agg(n.alias("__n"))
    out = _ranked(counts, by, list(probs.values()), discrete)
    return out.select(*keys, *[F.col(f"q{i}").alias(name) for i, name in enumerate(probs)])


def metric_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    discrete: bool = False,
) -> DataFrame:
    """Quantiles of several columns in one pass: output name -> (column, probability)."""
    keys = list(keys)
    columns = list(dict.fromkeys(col for col, _ in wanted.values()))
    probs = sorted({p for _, p in wanted.values()})
    pairs = F.array(*[F.struct(F.lit(m).alias("__m"), F.col(m).cast("double").alias("__v")) for m in columns])
    base = df if keys else df.withColumn("__all", F.lit(0))
    by = keys or ["__all"]
    long = base.select(*by, F.inline(pairs)).where(F.col("__v").isNotNull())
    counts = long.groupBy(*by, "__m", "__v").agg(F.count(F.lit(1)).alias("__n"))
    tall = _ranked(counts, [*by, "__m"], probs, discrete)
    aggs = [
        F.max(F.when(F.col("__m") == col, F.col(f"q{probs.index(p)}"))).alias(name)
        for name, (col, p) in wanted.items()
    ]
    return tall.groupBy(*by).agg(*aggs).drop("__all")
