"""Joins of shapes by tile: both sides of a tile meet in one task, which judges all its pairs at once.

Shapes travel as bytes, a few times each: a tile is as large as a task can take, so few shapes
touch two. No pair of shapes is ever a row before it is known to count. A tile crowded on either
side is cut into blocks of both sides by a hash of the row.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelmill.functions import flat
from parcelmill.operators import grid as gr
from parcelmill.operators.pieces import MAX_CORNERS, cut_polygon
from parcelmill.session import cut_lineage, stored

c = F.col
SHAPE, CORNERS, UNKNOWN, WHOLE, PIECE, ROW = "__shape", "__corners", "__unknown", "__whole", "__piece", "__row"
#: Bounds and first point of a packed shape.
PLACE = tuple(f"__{x}" for x in (*gr.BOX, "x", "y"))
#: A polygon of more corners is cut into pieces of at most MAX_CORNERS.
CUT_CORNERS = 512
#: Rows of a tile as the average row sees it, of a block of a crowded tile, and of a call.
TILE_ROWS, BLOCK_ROWS, BUCKET_ROWS = 4096, 16_384, 16_384
#: Bytes of shapes handed on at a time.
_BYTES = 1 << 25
#: (rows of the left side, rows of the right side, value of each pair or None)
Found = tuple[np.ndarray, np.ndarray, np.ndarray | None]
Judge = Callable[[flat.Shapes, flat.Shapes, pa.Table, pa.Table, Iterator[tuple[np.ndarray, np.ndarray]]], Found]


def packed(df: DataFrame, rings: str = "rings") -> DataFrame:
    """The table with its rings as bytes, a row number, bounds, first point and number of points, stored; shapes without a place are left out."""
    others = [*[x for x in df.columns if x != rings], ROW]
    kept = df.withColumn(ROW, F.monotonically_increasing_id()).select(*others, rings)  # no filter, which would make shapes before they are dealt
    extra = [T.StructField(SHAPE, T.BinaryType()), T.StructField(CORNERS, T.LongType()), T.StructField(UNKNOWN, T.BooleanType()), *[T.StructField(x, T.DoubleType()) for x in PLACE]]
    schema = T.StructType([*[kept.schema[x] for x in others], *extra])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            corners = np.diff(column.values.offsets.to_numpy()[column.offsets.to_numpy()])
            for part in flat.slices(corners, _BYTES // 16):
                some = batch.slice(part.start, part.stop - part.start)
                shapes, box, corner, points = flat.written(some.column(some.num_columns - 1))
                missing = flat.read(shapes).unknown
                columns = [*some.columns[:-1], shapes, pa.array(points), pa.array(missing), *[pa.array(x) for x in (*box.T.copy(), *corner.T.copy())]]
                out = pa.RecordBatch.from_arrays(columns, schema.names)
                known = ~np.isnan(box).any(axis=1)
                yield out if known.all() else out.filter(pa.array(known))

    return stored(kept.mapInArrow(pack, schema), "shapes")


def in_pieces(df: DataFrame, only: str | None = None) -> tuple[DataFrame, bool]:
    """A packed table with very large polygons cut into pieces (`__whole`, `__piece`), and whether any shape is large.

    `only` names a column that tells which shapes may be cut.
    """
    # A large shape with missing coordinates is cut as well: its pieces are what is known of it.
    large = ((c(CORNERS) > CUT_CORNERS) | ((c(CORNERS) > MAX_CORNERS) & c(UNKNOWN))) & (F.lit(True) if only is None else c(only))
    large = F.coalesce(large, F.lit(False))
    facts = df.agg(F.max(CORNERS), F.count_if(large)).first()
    named = df.withColumns({WHOLE: F.xxhash64(SHAPE), PIECE: F.lit(0)})
    if not facts[1]:
        return named, (facts[0] or 0) > MAX_CORNERS
    at, names = df.columns.index(SHAPE), named.columns
    schema = T.StructType([named.schema[x] for x in names])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                rings = list(cut_polygon(flat.read(batch.column(at).slice(row, 1)).edges, MAX_CORNERS))
                if not rings:
                    continue
                point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
                held = pa.array([[[{"x": x, "y": y} for x, y in r] for r in p] for p in rings], pa.list_(pa.list_(point)))
                shapes, box, corner, points = flat.written(held)
                new = {SHAPE: shapes, CORNERS: pa.array(points), PIECE: pa.array(np.arange(len(rings)), pa.int32())}
                new |= {x: pa.array(v) for x, v in zip(PLACE, (*box.T.copy(), *corner.T.copy()), strict=True)}
                same = batch.slice(row, 1).take(pa.array(np.zeros(len(rings), np.int64)))
                yield pa.RecordBatch.from_arrays([new.get(x, same.column(i)) for i, x in enumerate(names)], names)

    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(facts[1] / 1000))
    pieces = named.where(large).repartition(tasks, F.xxhash64(SHAPE)).mapInArrow(cut, schema)
    return stored(named.where(~large).unionByName(pieces), "pieces"), True


def side(df: DataFrame, prefix: str, grow: float = 0.0) -> tuple[DataFrame, bool]:
    """A packed side of a join: prefixed bounds (grown), shape, whole and piece; and whether a shape is large."""
    pieces, large = in_pieces(packed(df))
    return named_side(pieces, prefix, F.lit(grow)), large


def named_side(pieces: DataFrame, prefix: str, grow: Column) -> DataFrame:
    boxes = {f"{prefix}{x}": c(f"__{x}") + (grow if x.endswith("1") else -grow) for x in gr.BOX}
    return pieces.withColumns(boxes).withColumnsRenamed({x: f"{x}_{prefix}" for x in (SHAPE, WHOLE, PIECE)}).drop(CORNERS, UNKNOWN, ROW, *PLACE)


def _tile(sides: Sequence[tuple[DataFrame, str]], cell: float) -> float:
    """Side of the largest tiles, by doublings of a cell, of which the average row sees few rows."""
    spark = sides[0][0].sparkSession
    corners = [df.select(*[F.floor(c(f"{p}{x}0") / cell).alias(f"c{x}") for x in "xy"]) for df, p in sides]
    cells = corners[0].unionByName(corners[1]).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    levels = cells.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(16))))
    up = levels.groupBy("j", F.expr("shiftright(cx, j)").alias("cx"), F.expr("shiftright(cy, j)").alias("cy")).agg(F.sum("n").alias("n"))
    seen = up.groupBy("j").agg((F.sum(c("n") * 1.0 * c("n")) / F.sum("n")).alias("seen"), F.sum("n").alias("n")).collect()
    if not seen:
        return cell
    most = min(max(seen[0]["n"] / (8 * spark.sparkContext.defaultParallelism), 256), TILE_ROWS)
    return cell * 2 ** max([r["j"] for r in seen if r["seen"] <= most], default=0)


def _by_tile(left: DataFrame, right: DataFrame, tile: float, equal: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str], int]:
    """Both sides with the tiles they touch, the columns of a tile, and rows."""
    (left_levels, n), (right_levels, m) = [df.agg(F.collect_set(gr._level(p, tile)), F.count(F.lit(1))).first() for df, p in ((left, "l_"), (right, "r_"))]
    a = gr._to_cells(left, "l_", tile, left_levels, right_levels)
    b = gr._to_cells(right, "r_", tile, right_levels, left_levels)
    keys = [*equal, "lv", "cx", "cy"]
    blocks = {"sa": F.lit(0), "sb": F.lit(0)}
    if max(n, m) > BLOCK_ROWS:
        sizes = [df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias(x)).where(c(x) > 1) for df, x in ((a, "__sa"), (b, "__sb"))]
        salts = cut_lineage(sizes[0].join(sizes[1], keys, "full_outer").na.fill(1, ["__sa", "__sb"]))
        if not salts.isEmpty():
            def dealt(df: DataFrame, columns: Sequence[str], own: str, other: str) -> DataFrame:
                part = F.pmod(F.xxhash64(*columns), F.coalesce(c(f"__{own}"), F.lit(1))).cast("int")
                every = F.explode(F.sequence(F.lit(0), F.coalesce(c(f"__{other}"), F.lit(1)) - 1))
                return df.join(F.broadcast(salts), keys, "left").withColumn(own, part).withColumn(other, every).drop("__sa", "__sb")

            return dealt(a, left.columns, "sa", "sb"), dealt(b, right.columns, "sb", "sa"), [*keys, "sa", "sb"], n + m
    return a.withColumns(blocks), b.withColumns(blocks), [*keys, "sa", "sb"], n + m


def _numbers(left: pa.Table, right: pa.Table, keys: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A number for the tile of every row, the same on both sides."""
    both = pa.concat_tables([t.select(keys) for t in (left, right)])
    number = np.zeros(both.num_rows, np.int64)
    for key in keys:
        own = both.column(key).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        number = np.unique(number * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    return number[: left.num_rows], number[left.num_rows :]


def joined(
    left: DataFrame, right: DataFrame, cell: float, judge: Judge, left_columns: Sequence[str], right_columns: Sequence[str], value: str | None = None,
    equal: Sequence[str] = (), reach: str | None = None, grow: float = 0.0, distinct: bool = False, order: str | None = None,
    needs: Sequence[str] = (),
) -> DataFrame:
    """Pairs that `judge` finds among those whose boxes meet, each judged once: columns of both sides, and its value.

    Sides come from `side` or `named_side`. Boxes hold `grow`, or the left side's `reach` column, already. `equal`
    names columns both sides share and must agree on; `order` a right column by which the right rows of a call are
    sorted. `distinct` drops repeated rows of a call, `needs` are right columns that only `judge` reads.
    """
    tile = _tile([(left, "l_"), (right, "r_")], cell)
    a, b, keys, rows = _by_tile(left, right, tile, equal)
    spark = left.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    buckets = max(2 * spark.sparkContext.defaultParallelism, math.ceil(rows / BUCKET_ROWS))
    place = lambda p: [f"{p}lv", f"{p}cx", f"{p}cy", f"{SHAPE}_{p}"]
    left_names = list(dict.fromkeys([*left_columns, *keys, *place("l_"), *([reach] if reach else [])]))
    right_names = list(dict.fromkeys([*right_columns, *needs, *keys, *place("r_"), *([order] if order else [])]))
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("__bucket")
    sides = [df.select(*names, bucket).repartition(min(n, buckets), "__bucket").groupBy("__bucket") for df, names in ((a, left_names), (b, right_names))]
    out = T.StructType([
        *[left.schema[x] for x in left_columns], *[right.schema[x] for x in right_columns], *([T.StructField(value, T.DoubleType())] if value else []),
    ])
    simple = not any(isinstance(f.dataType, T.ArrayType | T.MapType | T.StructType) for f in out.fields)

    def of_bucket(one: pa.Table, other: pa.Table) -> pa.Table:
        found: Found = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        if one.num_rows and other.num_rows:
            if order:
                other = other.take(pc.sort_indices(other, [(order, "ascending")], null_placement="at_start"))
            one, other = one.combine_chunks(), other.combine_chunks()
            tiles, others = _numbers(one, other, keys)
            x, y = (flat.read(t.column(f"{SHAPE}_{p}").combine_chunks()) for t, p in ((one, "l_"), (other, "r_")))
            far = one.column(reach).to_numpy() if reach else np.full(one.num_rows, grow)
            found = judge(x, y, one, other, _once(one, other, x, y, flat.candidates(x, y, tiles, others, far)))
        rows, cols, values = found
        columns = [*one.select(left_columns).take(rows).columns, *other.select(right_columns).take(cols).columns, *([pa.array(values)] if value else [])]
        table = pa.table(columns, names=out.names)
        return table.group_by(out.names).aggregate([]).select(out.names) if distinct and simple else table

    return sides[0].cogroup(sides[1]).applyInArrow(of_bucket, out)


def _once(one: pa.Table, other: pa.Table, x: flat.Shapes, y: flat.Shapes, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs in the lowest cell both boxes touch on the coarser of their levels."""
    at = [one.column(k).to_numpy() for k in ("lv", "cx", "cy")]
    own = [[t.column(f"{p}{k}").to_numpy() for k in ("lv", "cx", "cy")] for t, p in ((one, "l_"), (other, "r_"))]
    for u, v in pairs:
        i, j = x.part_row[u], y.part_row[v]
        keep = np.ones(len(u), bool)
        for k in range(3):
            keep &= at[k][i] == np.maximum(own[0][k][i], own[1][k][j])
        yield u[keep], v[keep]


def _pairs_of_rows(found: list[tuple[np.ndarray, ...]], values: Sequence[Callable]) -> tuple[np.ndarray, ...]:
    """Pairs of parts put together to pairs of rows, each value by its function (a ufunc)."""
    columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.empty(0, np.int64)] * 2 + [np.empty(0)] * len(values)
    order = np.lexsort((columns[1], columns[0]))
    columns = [x[order] for x in columns]
    if not len(order):
        return tuple(columns)
    first = np.flatnonzero(np.r_[True, (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])])
    return (columns[0][first], columns[1][first], *[f.reduceat(x, first) for f, x in zip(values, columns[2:], strict=True)])


def meeting(x: flat.Shapes, y: flat.Shapes, one: pa.Table, other: pa.Table, pairs: Iterator) -> Found:
    """Shapes that share a point."""
    found = []
    for u, v in pairs:
        met = flat.together(x, y, u, v)
        found.append((x.part_row[u[met]], y.part_row[v[met]]))
    return (*_pairs_of_rows(found, ()), None)


def within(distance: float) -> Judge:
    """Shapes no farther apart than a distance."""

    def judge(x: flat.Shapes, y: flat.Shapes, one: pa.Table, other: pa.Table, pairs: Iterator) -> Found:
        found, near = [], np.zeros(one.num_rows, bool)
        for u, v in pairs:
            rest = ~near[x.part_row[u]]  # one feature is enough
            u, v = u[rest], v[rest]
            met = flat.together(x, y, u, v)
            rest = ~met & ~x.unknown[x.part_row[u]] & ~y.unknown[y.part_row[v]]
            met[rest] = flat.gaps(x, y, u[rest], v[rest], np.full(int(rest.sum()), distance * (1 + 1e-9))) <= distance
            near[x.part_row[u[met]]] = True
            found.append((x.part_row[u[met]], y.part_row[v[met]]))
        return (*_pairs_of_rows(found, ()), None)

    return judge


def overlapping(slow: Callable[[np.ndarray, np.ndarray], float], few: int) -> Judge:
    """Shapes that share a point, with the area they share.

    `slow` is for shapes that are not valid polygons, and for right ones of `few` edges, which it clips by.
    """

    def judge(x: flat.Shapes, y: flat.Shapes, one: pa.Table, other: pa.Table, pairs: Iterator) -> Found:
        (sign_x, good_x), (sign_y, good_y) = flat.signs(x), flat.signs(y)
        good_y &= np.bincount(y.part_row, y.part_edges, other.num_rows)[y.part_row] > few
        found = []
        for u, v in pairs:
            met = flat.together(x, y, u, v)
            u, v = u[met], v[met]
            area, good = np.zeros(len(u)), good_x[u] & good_y[v]
            area[good] = flat.shared(x, sign_x, y, sign_y, u[good], v[good])
            for k in np.flatnonzero(~good).tolist():
                e, f = (s.edges[s.part_first[p] : s.part_first[p] + s.part_edges[p]] for s, p in ((x, u[k]), (y, v[k])))
                area[k] = slow(e, f)
            found.append((x.part_row[u], y.part_row[v], area))
        return _pairs_of_rows(found, [np.add])

    return judge


def nearest(filled: str, reach: str) -> Judge:
    """The nearest right row of each left row, ties to the first; `filled` and `reach` name their columns."""

    def judge(x: flat.Shapes, y: flat.Shapes, one: pa.Table, other: pa.Table, pairs: Iterator) -> Found:
        full = other.column(filled).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        best = one.column(reach).to_numpy().copy()
        found = []
        for u, v in pairs:
            i, j = x.part_row[u], y.part_row[v]
            box, of = x.part_box[u], y.part_box[v]
            apart = np.hypot(*[np.maximum(np.maximum(box[:, k] - of[:, k + 2], of[:, k] - box[:, k + 2]), 0.0) for k in (0, 1)])
            near = apart <= best[i]
            u, v, i, j, apart = u[near], v[near], i[near], j[near], apart[near]
            gap = np.full(len(u), np.inf)
            close = np.flatnonzero(apart == 0)
            met = close[flat.together(x, y, u[close], v[close], full)]
            gap[met] = 0.0
            best[i[met]] = 0.0
            unknown = x.unknown[i] | y.unknown[j]
            rest = np.flatnonzero((gap > 0) & ~unknown & (apart <= best[i]))
            gap[rest] = flat.gaps(x, y, u[rest], v[rest], best[i[rest]])
            gap[(gap > 0) & unknown] = np.nan
            np.fmin.at(best, i, gap * (1 + 1e-9))
            keep = ~np.isinf(gap)
            found.append((i[keep], j[keep], gap[keep]))
        # Of a row's parts the nearest counts, but a distance that is not known makes the rest unknown unless shapes meet.
        rows, cols, gap, known = _pairs_of_rows([(*f, np.where(np.isnan(f[2]), np.inf, f[2])) for f in found], [np.minimum, np.minimum])
        gap = np.where(known == 0, 0.0, gap)
        order = np.lexsort((cols, gap, rows))  # unknown ones last
        rows, cols, gap = rows[order], cols[order], gap[order]
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else rows
        return rows[first], cols[first], gap[first]

    return judge


def largest_grown(shape: np.ndarray, slow: Callable[[np.ndarray, np.ndarray], float]) -> Judge:
    """The largest area that each left row shares with one right row grown by a shape, where there is any.

    Convex features are grown as a whole. Others go to `slow` one by one, those with the largest
    common box first, until no other can exceed what is found.
    """

    def judge(x: flat.Shapes, y: flat.Shapes, one: pa.Table, other: pa.Table, pairs: Iterator) -> Found:
        size = np.abs(shape).max()
        area, is_convex = flat.convex(y)
        sign, good = flat.signs(x)
        part_of = np.repeat(np.arange(len(y.part_row)), y.part_rings)
        parts = np.bincount(y.part_row, minlength=other.num_rows)
        plain = is_convex[y.part_ring] & (y.part_rings == 1) & (parts[y.part_row] == 1) if len(part_of) else np.zeros(0, bool)
        number = np.cumsum(plain) - 1
        wide = flat.grown(y, y.part_ring[plain], shape, area) if plain.any() else None
        sign_wide = flat.signs(wide)[0] if plain.any() else None
        easy, hard = [], []
        whole = np.ones(one.num_rows, bool)
        whole[x.part_row[~good]] = False
        for u, v in pairs:
            i, j = x.part_row[u], y.part_row[v]
            quick = plain[v] & whole[i]
            if quick.any():
                easy.append((i[quick], j[quick], flat.shared(x, sign, wide, sign_wide, u[quick], number[v[quick]])))
            u, v = u[~quick], v[~quick]
            box, of = x.part_box[u], y.part_box[v]
            common = [np.minimum(box[:, k + 2], of[:, k + 2] + size) - np.maximum(box[:, k], of[:, k] - size) for k in (0, 1)]
            hard.append((i[~quick], j[~quick], np.maximum(common[0], 0.0) * np.maximum(common[1], 0.0)))
        best = np.zeros(one.num_rows)
        rows, _, found = _pairs_of_rows(easy, [np.add])
        np.maximum.at(best, rows, found)
        rows, cols, bound = _pairs_of_rows(hard, [np.add])
        order = np.lexsort((-bound, rows))
        of = lambda s, r: s.edges[np.concatenate([np.arange(s.part_first[p], s.part_first[p] + s.part_edges[p]) for p in spans[id(s)][r]])]
        spans = {id(s): {} for s in (x, y)}
        for s, wanted in ((x, np.unique(rows)), (y, np.unique(cols))):
            at = np.argsort(s.part_row, kind="stable")
            held = s.part_row[at]
            for r, lo, hi in zip(wanted.tolist(), np.searchsorted(held, wanted).tolist(), np.searchsorted(held, wanted, side="right").tolist(), strict=True):
                spans[id(s)][r] = at[lo:hi]
        for k in order.tolist():
            r, q = int(rows[k]), int(cols[k])
            if bound[k] * (1 + 1e-9) > best[r]:
                best[r] = max(best[r], slow(of(x, r), of(y, q)))
        rows = np.flatnonzero(best > 0)
        return rows, np.zeros(len(rows), np.int64), best[rows]

    return judge
