"""The k nearest point features of many points, by tiles.

A tile is the smallest cell of a grid of halved sides that still holds a few features of
the key asked for, so it is small where features are dense. Its own features bound how far
the k nearest can lie; only cells within that bound hand their features to the tile. Points
and features of a tile meet in one task, which measures them in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmill.session import cut_lineage, stored

c = F.col
BOUNDS = ("f_x0", "f_y0", "f_x1", "f_y1")
#: A full cell has as many features at least, or k.
FULL_ROWS = 4
MAX_DEPTH = 26
#: Points of a tile beyond so many are dealt to several tasks.
CHUNK_POINTS = 8192
#: A tile that needs more features is left to the caller.
MAX_TILE_FEATURES = 20_000
#: Cells along one side of what a tile looks at, about.
SPAN = 6
BLOCK = 1_000_000
GROUP = ("__kid", "__tile", "__part")
#: Rows that one call measures, about: many tiles share a call.
BUCKET_ROWS = 65_536
#: Tables of so many keys are broadcast.
FEW_KEYS = 4096


def _cell(lv: Column, ix: Column, iy: Column) -> Column:
    """Level and place as one number."""
    return lv.cast("long") * F.lit(1 << 54) + ix * F.lit(1 << 27) + iy


def _up(axis: str, own: str, lv: str) -> Column:
    return F.expr(f"shiftright({axis}, {own} - {lv})")


def _apart(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(a0 - b1, b0 - a1, F.lit(0.0))


def _reach(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.abs(a1 - b0), F.abs(b1 - a0))


def _length(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def measured(px: np.ndarray, py: np.ndarray, fx: np.ndarray, fy: np.ndarray, k: int, within: float | None) -> tuple[np.ndarray, ...]:
    """(row of a point, row of a feature, distance, rank): the k nearest features of each point, ties to the lower row."""
    found = []
    step = max(1, BLOCK // len(fx))
    for s in range(0, len(px), step):
        dx, dy = px[s : s + step, None] - fx, py[s : s + step, None] - fy
        d = np.sqrt(dx * dx + dy * dy)
        if k == 1:
            col = d.argmin(axis=1)
            row = np.arange(len(d))
            dist, rank = d[row, col], np.ones(len(d), dtype=np.int32)
            keep = dist <= (np.inf if within is None else within)
        else:
            lim = np.partition(d, k - 1, axis=1)[:, k - 1] if k < len(fx) else np.full(len(d), np.inf)
            row, col = np.nonzero(d <= (lim if within is None else np.minimum(lim, within))[:, None])
            dist = d[row, col]
            order = np.lexsort((col, dist, row))
            row, col, dist = row[order], col[order], dist[order]
            rank = (np.arange(len(row)) - np.searchsorted(row, row) + 1).astype(np.int32)
            keep = rank <= k
        found.append((row[keep] + s, col[keep], dist[keep], rank[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _ends(table: pa.Table) -> dict[tuple, tuple[int, int]]:
    """First row and end of every tile in a table sorted by them."""
    numbers = np.stack([table.column(x).to_numpy() for x in GROUP])
    first = np.flatnonzero(np.r_[True, (numbers[:, 1:] != numbers[:, :-1]).any(axis=0)])
    return {tuple(numbers[:, a]): (a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), numbers.shape[1]], strict=True)}


def _meet(left: list[str], right: list[str], feature_id: str, k: int, within: float | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def of_bucket(points: pa.Table, features: pa.Table) -> pa.Table:
        found = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0), np.empty(0, dtype=np.int32))]
        if points.num_rows and features.num_rows:
            points = points.sort_by([(x, "ascending") for x in GROUP])
            features = features.sort_by([(x, "ascending") for x in (*GROUP, feature_id)])
            px, py, fx, fy = (t.column(x).to_numpy() for t, x in ((points, "x"), (points, "y"), (features, "f_x0"), (features, "f_y0")))
            given = _ends(features)
            for tile, (a, b) in _ends(points).items():
                if tile in given:
                    u, v = given[tile]
                    rows, cols, dist, rank = measured(px[a:b], py[a:b], fx[u:v], fy[u:v], k, within)
                    found.append((rows + a, cols + u, dist, rank))
        rows, cols, dist, rank = (np.concatenate(x) for x in zip(*found, strict=True))
        one, other = points.select(left).take(rows), features.select(right).take(cols)
        columns = [*one.columns, *other.columns, pa.array(dist), pa.array(rank, pa.int32())]
        return pa.table(columns, names=[*left, *right, "distance", "rank"])

    return of_bucket


def nearest_points(
    points: DataFrame, features: DataFrame, k: int, feature_id: str, by: Sequence[str], per: str | None, within: float | None, max_kinds: int,
    max_tile: int | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """(found, left over): the k nearest of each point, and points of tiles that would need too many features.

    Points and features as for `grid.nearest`; `features` are read several times. What is left
    over are rows of the point columns and `per`, one for each value that is still to be found.
    """
    max_tile = max_tile or MAX_TILE_FEATURES
    by, fkeys = list(by), [*by, *([per] if per else [])]
    placed = lambda df, x, y: df.where((F.abs(x) < math.inf) & (F.abs(y) < math.inf))
    features = placed(features, c("f_x0"), c("f_y0")).dropna(subset=fkeys) if fkeys else placed(features, c("f_x0"), c("f_y0"))
    points = placed(points, c("x"), c("y"))
    spark = points.sparkSession
    facts = features.agg(F.count(F.lit(1)).alias("n"), F.min("f_x0").alias("x0"), F.min("f_y0").alias("y0"), F.max("f_x0").alias("x1"), F.max("f_y0").alias("y1")).first()
    kinds_type = features.schema[per].dataType if per else None
    kept = [x for x in features.columns if x not in (*by, *BOUNDS)]
    out = T.StructType([
        *points.schema.fields, *[features.schema[x] for x in kept], T.StructField("distance", T.DoubleType()), T.StructField("rank", T.IntegerType()),
    ])
    if not facts["n"]:
        return spark.createDataFrame([], out), None
    x0, y0 = facts["x0"], facts["y0"]
    extent = max(facts["x1"] - x0, facts["y1"] - y0, 1e-9) * 1.0000001
    full_rows = max(k, FULL_ROWS)

    # Keys get a number; the grid goes deeper while one cell holds many features.
    if fkeys:
        keys = cut_lineage(features.select(*fkeys).distinct()).withColumn("__kid", F.monotonically_increasing_id())
    else:
        keys = spark.range(1).select(c("id").alias("__kid"))
    n_keys = keys.count() if fkeys else 1
    if per and not by and n_keys > max_kinds:
        raise ValueError(f"{n_keys} values of {per}; name it in `by` and give the points that column")
    few = n_keys <= FEW_KEYS

    def tagged(df: DataFrame, names: Sequence[str], table: DataFrame) -> DataFrame:
        if not names:
            return df.crossJoin(F.broadcast(table))
        return df.join(F.broadcast(table) if few else table.hint("merge"), list(names))

    def in_grid(df: DataFrame, x: str, y: str, lv: Column) -> DataFrame:
        side = F.lit(extent) / F.pow(F.lit(2.0), lv)
        top = F.pow(F.lit(2.0), lv).cast("long") - 1
        place = [F.least(F.greatest(F.floor((c(a) - o) / side), F.lit(0)), top) for a, o in ((x, x0), (y, y0))]
        return df.withColumns({"__ix": place[0], "__iy": place[1]})

    own = tagged(features, fkeys, keys)
    least = min(MAX_DEPTH, max(0, math.floor(math.log2(extent / within)))) if within and within < extent else 0
    depth = min(MAX_DEPTH, max(1, least, math.ceil(math.log(max(facts["n"] / full_rows, 1), 4)) + 1))
    while depth < MAX_DEPTH:
        crowd = in_grid(own, "f_x0", "f_y0", F.lit(depth)).groupBy("__kid", "__ix", "__iy").count().agg(F.max("count")).first()[0]
        if crowd <= max(16 * full_rows, 256):
            break
        depth = min(MAX_DEPTH, depth + 2)
    own = in_grid(own, "f_x0", "f_y0", F.lit(depth)).withColumn("__depth", F.lit(depth))

    # Cells of every level with their features' number and bounds.
    sums = [F.min("f_x0").alias("f_x0"), F.min("f_y0").alias("f_y0"), F.max("f_x1").alias("f_x1"), F.max("f_y1").alias("f_y1")]
    smallest = own.withColumns({"f_x1": c("f_x0"), "f_y1": c("f_y0")}).groupBy("__kid", "__depth", "__ix", "__iy").agg(F.count(F.lit(1)).alias("__n"), *sums)
    levels = smallest.withColumn("__lv", F.explode(F.sequence(F.lit(0), F.lit(depth))))
    cell = _cell(c("__lv"), _up("__ix", "__depth", "__lv"), _up("__iy", "__depth", "__lv"))
    cells = cut_lineage(levels.groupBy("__kid", "__lv", cell.alias("__cell")).agg(F.sum("__n").alias("__n"), *sums))
    full = cells.where((c("__n") >= full_rows) | (c("__lv") == 0))
    finest = full.groupBy("__kid").agg(F.greatest(F.max("__lv"), F.lit(least)).alias("__lm"))
    keys = cut_lineage(keys.join(finest, "__kid"))

    # The tile of a point: its smallest full cell, but with `within` no larger than twice that.
    spots = in_grid(tagged(points, by, keys.select(*fkeys, "__kid", "__lm")), "x", "y", c("__lm"))
    asked = spots.select("__kid", "__lm", "__ix", "__iy").distinct().withColumn("__lv", F.explode(F.sequence(F.lit(0), c("__lm"))))
    asked = asked.withColumn("__cell", _cell(c("__lv"), _up("__ix", "__lm", "__lv"), _up("__iy", "__lm", "__lv")))
    level = asked.join(full.select("__kid", "__cell").hint("merge"), ["__kid", "__cell"]).groupBy("__kid", "__ix", "__iy").agg(
        F.greatest(F.max("__lv"), F.lit(least)).alias("__lv")
    )
    spots = spots.join(level.hint("merge"), ["__kid", "__ix", "__iy"])
    spots = spots.withColumn("__tile", _cell(c("__lv"), _up("__ix", "__lm", "__lv"), _up("__iy", "__lm", "__lv")))
    spots = stored(spots.select(*points.columns, *([per] if per else []), "__kid", "__lv", "__tile"), "spots")

    tiles = spots.groupBy("__kid", "__lv", "__tile").agg(
        F.min("x").alias("q_x0"), F.min("y").alias("q_y0"), F.max("x").alias("q_x1"), F.max("y").alias("q_y1"), F.count(F.lit(1)).alias("__np")
    )
    bounds = cells.select("__kid", c("__cell").alias("__tile"), "__n", *BOUNDS)
    far = _length(_reach(c("q_x0"), c("q_x1"), c("f_x0"), c("f_x1")), _reach(c("q_y0"), c("q_y1"), c("f_y0"), c("f_y1")))
    lim = F.least(F.when(c("__n") >= k, far), F.lit(within).cast("double"))
    tiles = tiles.join(bounds.hint("merge"), ["__kid", "__tile"], "left").withColumn("__lim", lim).drop("__n", *BOUNDS)
    tiles = cut_lineage(tiles.withColumn("__parts", F.ceil(c("__np") / CHUNK_POINTS).cast("int")).drop("__np"))

    # The cells a tile looks at, on a level where there are few of them.
    wide = c("__lim") * (1 + 1e-9) + extent * 1e-12
    side = lambda lv: F.lit(extent) / F.pow(F.lit(2.0), lv)
    span = F.greatest(c("q_x1") - c("q_x0"), c("q_y1") - c("q_y0")) + 2 * wide
    coarser = F.greatest(F.ceil(F.log2(span / (SPAN * side(c("__lv"))))), F.lit(0))
    at = F.when(c("__lim").isNull(), F.lit(0)).otherwise(F.greatest(c("__lv") - F.coalesce(coarser, F.lit(0)), F.lit(0)).cast("int"))
    looks = tiles.withColumn("__at", at)

    def reached(lo: str, hi: str, o: float) -> Column:
        top = F.pow(F.lit(2.0), c("__at")).cast("long") - 1
        ends = [F.least(F.greatest(F.floor((v - o) / side(c("__at"))), F.lit(0)), top) for v in (c(lo) - wide, c(hi) + wide)]
        return F.when(c("__lim").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(*ends))

    looks = looks.withColumn("__cx", F.explode(reached("q_x0", "q_x1", x0))).withColumn("__cy", F.explode(reached("q_y0", "q_y1", y0)))
    looks = looks.withColumn("__cell", _cell(c("__at"), c("__cx"), c("__cy"))).join(cells.drop("__lv").hint("merge"), ["__kid", "__cell"])
    near = _length(_apart(c("q_x0"), c("q_x1"), c("f_x0"), c("f_x1")), _apart(c("q_y0"), c("q_y1"), c("f_y0"), c("f_y1")))
    looks = looks.where(c("__lim").isNull() | (near <= c("__lim"))).select("__kid", "__tile", "__parts", "__at", "__cell", "__n")
    looks = cut_lineage(looks)
    crowded = looks.groupBy("__kid", "__tile").agg(F.sum("__n").alias("__n")).where(c("__n") > max_tile).select("__kid", "__tile")
    rest = None
    if not crowded.isEmpty():
        crowded = cut_lineage(crowded)
        rest = spots.join(crowded.hint("merge"), ["__kid", "__tile"], "left_semi").select(*points.columns, *([per] if per else []))
        looks, spots = (df.join(crowded.hint("merge"), ["__kid", "__tile"], "left_anti") for df in (looks, spots))

    # Features by the levels that tiles of their key look at.
    used = cut_lineage(looks.groupBy("__kid").agg(F.collect_set("__at").alias("__levels")))
    given = own.select(*kept, "f_x0", "f_y0", "__kid", "__ix", "__iy", "__depth").join(F.broadcast(used) if few else used.hint("merge"), "__kid")
    given = given.withColumn("__at", F.explode("__levels")).withColumn("__cell", _cell(c("__at"), _up("__ix", "__depth", "__at"), _up("__iy", "__depth", "__at")))
    given = given.select(*kept, "f_x0", "f_y0", "__kid", "__cell").join(looks.select("__kid", "__tile", "__parts", "__cell").hint("merge"), ["__kid", "__cell"])
    given = given.withColumn("__part", F.explode(F.sequence(F.lit(0), c("__parts") - 1))).select(*kept, "f_x0", "f_y0", "__kid", "__tile", "__part")
    parts = tiles.where(c("__parts") > 1).select("__kid", "__tile", "__parts")
    spots = spots.join(F.broadcast(parts), ["__kid", "__tile"], "left")  # one row for many thousand points
    spots = spots.withColumn("__part", F.pmod(F.xxhash64("x", "y", *[x for x in points.columns if x not in ("x", "y")]), F.coalesce(c("__parts"), F.lit(1))).cast("int"))
    spots = spots.select(*points.columns, "__kid", "__tile", "__part")

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = (looks.agg(F.sum(c("__n") * c("__parts"))).first()[0] or 0) + spots.count()
    bucket = F.pmod(F.xxhash64(*GROUP), F.lit(max(n, math.ceil(rows / BUCKET_ROWS)))).alias("__bucket")
    sides = [df.select("*", bucket).repartition(n, "__bucket").groupBy("__bucket") for df in (spots, given)]
    return sides[0].cogroup(sides[1]).applyInArrow(_meet(points.columns, kept, feature_id, k, within), out), rest
