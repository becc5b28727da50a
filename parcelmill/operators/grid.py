"""Joins of geometries by grid cell, and exact nearest neighbors.

`cell_pairs` finds pairs whose boxes meet. Every box lives on the grid level that
matches its size, so it touches at most four cells there, however large it is.
Cells that hold very many rows are salted.

`nearest` finds point features by tiles (`near`). For boxes and shapes, and where a tile
would need very many features, it walks down a pyramid of cell bounds, opening a cell only
while it holds many features. There it works on groups of query points that share a block,
keeps only cells that can still hold one of the k nearest, and compares points with features
only in the cells left at the end.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelmill.operators.near import nearest_points
from parcelmill.operators.windows import first_by
from parcelmill.session import cut_lineage

c = F.col
BOX = ("x0", "y0", "x1", "y1")
HOT_CELL_ROWS = 500_000
FANOUT = 8
MAX_LEAF_ROWS = 1024
SMALL_CELL_ROWS = 64
MAX_KINDS = 1000
#: A side of so many rows is never broadcast. Rows carry shapes, so tables are far larger than the files by which Spark judges them.
BROADCAST_ROWS = 4096


def box_of(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}{n}": v.cast("double") for n, v in zip(BOX, (x0, y0, x1, y1))})


def _level(prefix: str, cell: float) -> Column:
    size = F.greatest(c(f"{prefix}x1") - c(f"{prefix}x0"), c(f"{prefix}y1") - c(f"{prefix}y0"))
    return F.greatest(F.ceil(F.log2(F.greatest(size, F.lit(cell)) / cell) / 2), F.lit(0)).cast("int")


def _to_cells(df: DataFrame, prefix: str, cell: float, own: Sequence[int], other: Sequence[int]) -> DataFrame:
    """One row per box, level at which it may meet a box of the other side, and cell touched there.

    Boxes meet on the coarser of their levels: on a box's own where the other side has a box
    as small, and on each coarser level of the other side.
    """
    meets = {lv: sorted({lv} & {lv for o in other if o <= lv} | {o for o in other if o > lv}) for lv in own}
    rows = df.withColumn(f"{prefix}lv", _level(prefix, cell))
    if any(at != [lv] for lv, at in meets.items()):
        chosen = F.lit(None).cast("array<int>")
        for lv, at in meets.items():
            chosen = F.when(c(f"{prefix}lv") == lv, F.array(*map(F.lit, at)).cast("array<int>")).otherwise(chosen)
        rows = rows.withColumn("lv", F.explode(chosen))
    else:
        rows = rows.withColumn("lv", c(f"{prefix}lv"))
    size = F.pow(F.lit(4.0), c("lv")) * cell
    for axis in ("x", "y"):
        rows = rows.withColumn(f"{prefix}c{axis}", F.floor(c(f"{prefix}{axis}0") / size))
    return rows.withColumn(
        "cx", F.explode(F.sequence(c(f"{prefix}cx"), F.floor(c(f"{prefix}x1") / size)))
    ).withColumn("cy", F.explode(F.sequence(c(f"{prefix}cy"), F.floor(c(f"{prefix}y1") / size))))


def _shuffled(df: DataFrame, rows: int) -> DataFrame:
    """A join side that both sides are dealt by key for, unless it is proven small."""
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def _in_blocks(
    a: DataFrame, b: DataFrame, keys: Sequence[str], left: Sequence[str], right: Sequence[str], hot_rows: int, rows: int
) -> DataFrame:
    """Join of cells where a cell crowded on either side is cut into blocks of both; every pair of blocks is one key."""
    sizes = [df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / hot_rows).cast("int").alias(n)).where(c(n) > 1) for df, n in ((a, "__sa"), (b, "__sb"))]
    salts = cut_lineage(sizes[0].join(sizes[1], list(keys), "full_outer").na.fill(1, ["__sa", "__sb"]))
    if salts.isEmpty():
        return _shuffled(a, rows).join(b, keys)
    salts = F.broadcast(salts)  # a crowded cell has over `hot_rows` rows, so there are few

    def blocks(df: DataFrame, columns: Sequence[str], own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64(*columns), F.coalesce(c(f"__{own}"), F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(c(f"__{other}"), F.lit(1)) - 1))
        return df.join(salts, list(keys), "left").withColumn(own, part).withColumn(other, every).drop("__sa", "__sb")

    return _shuffled(blocks(a, left, "sa", "sb"), rows).join(blocks(b, right, "sb", "sa"), [*keys, "sa", "sb"])


def cell_pairs(
    left: DataFrame, right: DataFrame, cell: float, equal: Sequence[str] = (), hot_rows: int = HOT_CELL_ROWS
) -> DataFrame:
    """Pairs whose boxes meet; boxes are columns l_x0.. on the left, r_x0.. on the right.

    `equal` names columns both sides share and must agree on. Each pair appears
    once, in the lowest cell both boxes touch on the coarser of their levels.
    """
    # At most about forty levels and one count of each side.
    (left_levels, left_rows), (right_levels, right_rows) = [
        df.agg(F.collect_set(_level(p, cell)), F.count(F.lit(1))).first() for df, p in ((left, "l_"), (right, "r_"))
    ]
    a = _to_cells(left, "l_", cell, left_levels, right_levels)
    b = _to_cells(right, "r_", cell, right_levels, left_levels)
    keys = [*equal, "lv", "cx", "cy"]
    if max(left_rows, right_rows) <= hot_rows:  # a box has one row per cell, so no cell can be crowded
        joined = _shuffled(a, min(left_rows, right_rows)).join(b, keys)
    else:
        joined = _in_blocks(a, b, keys, left.columns, right.columns, hot_rows, min(left_rows, right_rows))
    meets = (
        (c("l_x0") <= c("r_x1")) & (c("r_x0") <= c("l_x1")) & (c("l_y0") <= c("r_y1")) & (c("r_y0") <= c("l_y1"))
    )
    once = (
        (c("lv") == F.greatest("l_lv", "r_lv"))
        & (c("cx") == F.greatest("l_cx", "r_cx"))
        & (c("cy") == F.greatest("l_cy", "r_cy"))
    )
    return joined.where(meets & once).drop("lv", "cx", "cy", "sa", "sb", "l_lv", "r_lv", "l_cx", "l_cy", "r_cx", "r_cy")


def _gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(a0 - b1, b0 - a1, F.lit(0.0))


def _reach(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.abs(a1 - b0), F.abs(b1 - a0))


def nearest(
    points: DataFrame,
    features: DataFrame,
    k: int = 1,
    point_id: str = "point_id",
    feature_id: str = "feature_id",
    by: Sequence[str] = (),
    per: str | None = None,
    distance: Column | None = None,
    point_features: bool = True,
    query_box: Sequence[str] | None = None,
    ceiling: Column | None = None,
    within: float | None = None,
) -> DataFrame:
    """The k nearest features of every point, ties to the lower feature id.

    Points have columns x and y; for shapes these are any place inside and `query_box` names the
    columns of their bounds (x0, y0, x1, y1), which `distance` must respect. Features have f_x0, f_y0, f_x1, f_y1 bounds and any
    columns `distance` needs (default: distance to the bounds). `by` columns must
    agree on both sides. `per` is a feature column: k neighbors are found for each
    of its values. With `ceiling`, an upper bound of the distance of a pair, distances are not
    measured: all pairs that can still be the nearest (k = 1) are returned, by the gap of
    their bounds. Else returns the point columns, the feature columns (without bounds for point
    features), `distance` and `rank`. With `within`, only pairs up to that distance are returned.
    """
    by = list(by)
    extra = [per] if per else []
    fkeys = [*by, *extra]
    if point_features and distance is None and ceiling is None:
        # At one spot only the k lowest ids can ever be among the nearest.
        features = cut_lineage(first_by(features, [*fkeys, "f_x0", "f_y0", "f_x1", "f_y1"], [c(feature_id)], k))
        found, rest = nearest_points(points, features, k, feature_id, by, per, within, MAX_KINDS)
        if rest is None:
            return found
        more = _descend(rest, features, k, point_id, feature_id, fkeys, None, None, None, None)
        return found.unionByName((more if within is None else more.where(c("distance") <= within)).select(*found.columns))
    found = _descend(points, features, k, point_id, feature_id, by, per, distance, query_box, ceiling)
    return found if within is None or ceiling is not None else found.where(c("distance") <= within)


def _descend(
    points: DataFrame, features: DataFrame, k: int, point_id: str, feature_id: str, by: Sequence[str], per: str | None, distance: Column | None,
    query_box: Sequence[str] | None, ceiling: Column | None,
) -> DataFrame:
    """`nearest` by the pyramid of cells."""
    by = list(by)
    extra = [per] if per else []
    fkeys = [*by, *extra]
    exact = distance if distance is not None else F.sqrt(
        F.pow(_gap(c("x"), c("x"), c("f_x0"), c("f_x1")), 2) + F.pow(_gap(c("y"), c("y"), c("f_y0"), c("f_y1")), 2)
    )
    features = cut_lineage(features)  # read by the extent, every occupancy check, the pyramid and the last join

    facts = features.agg(
        F.count(F.lit(1)).alias("n"), F.min("f_x0").alias("x0"), F.min("f_y0").alias("y0"),
        F.max("f_x1").alias("x1"), F.max("f_y1").alias("y1"),
    ).first()
    if not facts["n"]:
        empty = points.join(features.drop(*by), F.lit(False)).withColumn("distance", F.lit(0.0)).withColumn("rank", F.lit(1))
        return empty
    x0, y0 = facts["x0"], facts["y0"]
    extent = max(facts["x1"] - x0, facts["y1"] - y0, 1e-9) * 1.0000001
    depth = max(1, math.ceil(math.log(max(facts["n"] / 4, 1), FANOUT * FANOUT)))
    small = max(SMALL_CELL_ROWS, 2 * k)
    mid_x, mid_y = (c("f_x0") + c("f_x1")) / 2, (c("f_y0") + c("f_y1")) / 2

    def leaves(levels: int) -> DataFrame:
        size = extent / FANOUT**levels
        return features.withColumn("ix", F.floor((mid_x - x0) / size)).withColumn("iy", F.floor((mid_y - y0) / size))

    while depth < 9:
        fullest = leaves(depth).groupBy(*fkeys, "ix", "iy").count().agg(F.max("count")).first()[0]
        if fullest <= MAX_LEAF_ROWS:
            break
        depth += 1
    placed = leaves(depth)

    # Cells of every level; a cell is opened further only while it holds many features.
    bounds = [F.min("f_x0").alias("f_x0"), F.min("f_y0").alias("f_y0"), F.max("f_x1").alias("f_x1"), F.max("f_y1").alias("f_y1")]
    parent = [F.floor(c(a) / FANOUT) for a in ("ix", "iy")]
    level = placed.groupBy(*fkeys, "ix", "iy").agg(*bounds, F.count(F.lit(1)).alias("n"))
    pyramid = [level]
    for _ in range(depth):
        level = level.withColumns({"ix": parent[0], "iy": parent[1]}).groupBy(*fkeys, "ix", "iy").agg(*bounds, F.sum("n").alias("n"))
        pyramid.append(level)
    opened = []
    for lv, cells in enumerate(pyramid[:-1]):
        marked = cells.withColumns({"px": parent[0], "py": parent[1]})
        total = F.sum("n").over(W.partitionBy(*fkeys, "px", "py"))
        opened.append(marked.withColumn("pn", total).where(c("pn") > small).withColumn("lv", F.lit(lv)).drop("pn"))
    top = pyramid[-1].withColumn("lv", F.lit(depth))
    tables = [top.select(*fkeys, "lv", "ix", "iy", "n")] + [t.select(*fkeys, "lv", "ix", "iy", "n") for t in opened]
    every = tables[0]
    for t in tables[1:]:
        every = every.unionByName(t)
    last = every.where((c("n") <= small) | (c("lv") == 0)).drop("n")
    path = F.array(*[F.struct(F.lit(j).alias("lv"), F.floor(c("ix") / FANOUT**j).alias("ix"), F.floor(c("iy") / FANOUT**j).alias("iy")) for j in range(depth + 1)])
    spread = placed.withColumn("path", path).drop("ix", "iy")
    housed = spread.select(*[x for x in spread.columns if x != "path"], F.inline("path")).join(last, [*fkeys, "lv", "ix", "iy"])

    block = extent / FANOUT**depth
    located = points.withColumn("qx", F.floor((c("x") - x0) / block)).withColumn("qy", F.floor((c("y") - y0) / block))
    groups = located.groupBy(*by, "qx", "qy").agg(
        *[f(x).alias(f"q_{n}") for f, x, n in zip((F.min, F.min, F.max, F.max), query_box or ("x", "y", "x", "y"), BOX, strict=True)]
    )
    qkeys = [*fkeys, "qx", "qy"]
    box = [f"q_{n}" for n in BOX]
    low = F.sqrt(F.pow(_gap(c("q_x0"), c("q_x1"), c("f_x0"), c("f_x1")), 2) + F.pow(_gap(c("q_y0"), c("q_y1"), c("f_y0"), c("f_y1")), 2))
    high = F.sqrt(F.pow(_reach(c("q_x0"), c("q_x1"), c("f_x0"), c("f_x1")), 2) + F.pow(_reach(c("q_y0"), c("q_y1"), c("f_y0"), c("f_y1")), 2))
    start = top.select(*fkeys, "lv", "ix", "iy", "n", "f_x0", "f_y0", "f_x1", "f_y1")
    if by:
        cand = groups.join(start, by)
    else:
        # One top cell, or one per value of `per`: read as a scalar subquery.
        kinds = start.count() if per else 1
        if kinds > MAX_KINDS:
            raise ValueError(f"{kinds} values of {per}; name it in `by` and give the points that column")
        tops = start.agg(F.collect_list(F.struct(*start.columns))).scalar()
        cand = groups.withColumn("tops", tops).select(*groups.columns, F.inline("tops"))
    cand = cand.withColumns({"lo": low, "hi": high})
    own = ["lv", "ix", "iy", "n", "lo", "hi"]
    for depth_left, cells in enumerate(reversed(opened)):
        child = cells.select(*fkeys, "px", "py", "lv", "ix", "iy", "n", "f_x0", "f_y0", "f_x1", "f_y1").withColumn("plv", c("lv") + 1)
        if not fkeys and depth_left < 2:
            child = F.broadcast(child)  # at most 64 then 4096 cells exist on the two levels below the top
        else:
            child = _shuffled(child, facts["n"])
        named = child.select(*fkeys, *[c(x).alias(f"k_{x}") for x in ("lv", "ix", "iy", "n")], "f_x0", "f_y0", "f_x1", "f_y1",
                             c("px").alias("ix"), c("py").alias("iy"), c("plv").alias("lv"))
        step = cand.select(*qkeys, *box, *own).join(named, [*fkeys, "lv", "ix", "iy"], "left")
        deeper = c("k_lv").isNotNull()
        # Cells that are not opened stay as they are.
        step = step.select(
            *qkeys, *box, *[F.when(deeper, c(f"k_{x}")).otherwise(c(x)).alias(x) for x in ("lv", "ix", "iy", "n")],
            F.when(deeper, low).otherwise(c("lo")).alias("lo"), F.when(deeper, high).otherwise(c("hi")).alias("hi"),
        )
        whole = W.partitionBy(*qkeys)
        if k == 1:
            kept = step.withColumn("lim", F.min("hi").over(whole))
        else:
            running = F.sum("n").over(whole.orderBy("hi").rowsBetween(W.unboundedPreceding, W.currentRow))
            kept = step.withColumn("run", running).withColumn("lim", F.min(F.when(c("run") >= k, c("hi"))).over(whole))
        cand = kept.where(c("lim").isNull() | (c("lo") <= c("lim")))
    chosen = _shuffled(cand.select(*qkeys, "lv", "ix", "iy"), facts["n"])
    pairs = located.join(chosen, [*by, "qx", "qy"]).join(_shuffled(housed, facts["n"]), [*fkeys, "lv", "ix", "iy"])
    if ceiling is not None:
        qb = query_box or ("x", "y", "x", "y")
        floor = F.hypot(_gap(c(qb[0]), c(qb[2]), c("f_x0"), c("f_x1")), _gap(c(qb[1]), c(qb[3]), c("f_y0"), c("f_y1")))
        bounded = pairs.withColumn("__lim", F.min(ceiling).over(W.partitionBy(point_id, *extra)))
        return bounded.where(floor <= c("__lim")).drop("__lim", "lv", "ix", "iy", "qx", "qy")
    measured = pairs.withColumn("distance", exact)
    order = W.partitionBy(point_id, *fkeys).orderBy("distance", feature_id)
    ranked = measured.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k)
    return ranked.drop("lv", "ix", "iy", "qx", "qy")


def point_box(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Feature bounds of plain points."""
    return df.withColumns({"f_x0": c(x), "f_y0": c(y), "f_x1": c(x), "f_y1": c(y)})

