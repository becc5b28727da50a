"""Overlay facts: what lies on, near or around a parcel."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelmill.functions import geometry as gm
from parcelmill.functions.codes import yield_class
from parcelmill.operators import grid as gr
from parcelmill.operators import tiles as tl
from parcelmill.operators.joins import latest_valid_sale
from parcelmill.operators.pieces import MAX_CORNERS, PIECE, WHOLE, corner_count, path_chunks, subdivide
from parcelmill.operators.windows import first_by
from parcelmill.session import cut_lineage, stored

c = F.col
SQFT_PER_ACRE = 43560.0
KEY = "parcel_id"
#: A point whose nearest corner is so many cells away is searched for by the pyramid.
FAR_CELLS = 16
#: A polygon of so many edges is clipped by.
CLIP_EDGES = 8


def as_points(df: DataFrame, key: str = KEY, x: str = "x", y: str = "y", keep: Sequence[str] = ()) -> DataFrame:
    """Left side of a join: points with a zero-size box."""
    base = df.where(c(x).isNotNull() & c(y).isNotNull()).select(key, c(x).alias("px"), c(y).alias("py"), *keep)
    return gr.box_of(base, c("px"), c("py"), c("px"), c("py"), "l_")


def as_polygons(df: DataFrame, prefix: str, rings: str = "rings", grow: float = 0.0) -> DataFrame:
    """Polygons with their edge list and (grown) box; the rings column is dropped."""
    box = gm.bbox(c(rings))
    base = df.withColumn(f"{prefix}edges", gm.edges(c(rings))).withColumn("__b", box)
    return gr.box_of(
        base, c("__b.x0") - grow, c("__b.y0") - grow, c("__b.x1") + grow, c("__b.y1") + grow, prefix
    ).drop("__b", rings)


def contains_join(points: DataFrame, layer: DataFrame, cell: float) -> DataFrame:
    """(point, polygon) pairs where the polygon holds the point; a point lies in one piece of a large polygon."""
    pairs = gr.cell_pairs(as_points_keep(points), as_polygons(subdivide(layer)[0], "r_"), cell)
    return pairs.where(gm.contains_point(c("r_edges"), c("px"), c("py"))).drop(*_shapes())


def as_points_keep(points: DataFrame) -> DataFrame:
    return points if "l_x0" in points.columns else as_points(points)


def _boxes() -> list[str]:
    return [f"{p}{n}" for p in ("l_", "r_") for n in gr.BOX]


def _shapes() -> list[str]:
    return [*_boxes(), "l_edges", "r_edges", WHOLE, PIECE]


def _own(df: DataFrame) -> list[str]:
    return [x for x in df.columns if x != "rings"]


def intersecting(parcels: DataFrame, layer: DataFrame, cell: float) -> DataFrame:
    """Columns of pairs that meet; a pair may come several times, or once for several pairs with the same columns."""
    (left, _), (right, _) = tl.side(parcels, "l_"), tl.side(layer, "r_")
    return tl.joined(left, right, cell, tl.meeting, _own(parcels), _own(layer), distinct=True)


def intersects(parcels: DataFrame, layer: DataFrame, cell: float) -> DataFrame:
    """Every parcel with `val` = true, or NULL where nothing meets it."""
    hits = intersecting(parcels.select(KEY, "rings"), layer.select("rings"), cell).select(KEY).distinct()
    return parcels.select(KEY).join(hits.withColumn("val", F.lit(True)), KEY, "left")


def _facts(parcels: DataFrame, values: DataFrame) -> DataFrame:
    return parcels.select(KEY).join(values, KEY, "left")


def intersects_attr(parcels: DataFrame, layer: DataFrame, column: str, order_by: str, cell: float) -> DataFrame:
    """Attribute of the first intersecting feature by an order column."""
    hits = intersecting(parcels.select(KEY, "rings"), layer.select("rings", column, c(order_by).alias("__o")), cell)
    best = hits.groupBy(KEY).agg(F.min(F.struct("__o", column))[column].alias("val"))
    return _facts(parcels, best)


def intersects_list(parcels: DataFrame, layer: DataFrame, column: str, cell: float) -> DataFrame:
    """Sorted distinct attribute values of the intersecting features."""
    hits = intersecting(parcels.select(KEY, "rings"), layer.select("rings", column), cell).select(KEY, column).distinct()
    return _facts(parcels, hits.groupBy(KEY).agg(F.sort_array(F.collect_list(column)).alias("val")))


def _clip(subject: list, clip: list) -> list:
    """Part of polygon `subject` inside the convex counter-clockwise polygon `clip`."""
    out = subject
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1]):
        if not out:
            return []
        inside = [(bx - ax) * (y - ay) - (by - ay) * (x - ax) for x, y in out]
        nxt = []
        for i, (x, y) in enumerate(out):
            j = i - 1
            if (inside[i] >= 0) != (inside[j] >= 0):
                t = inside[j] / (inside[j] - inside[i])
                px, py = out[j]
                nxt.append((px + t * (x - px), py + t * (y - py)))
            if inside[i] >= 0:
                nxt.append((x, y))
        out = nxt
    return out


def _signed(ring: list) -> float:
    return sum(x * v - u * y for (x, y), (u, v) in zip(ring, ring[1:] + ring[:1])) / 2.0


def _is_convex(ring: list) -> bool:
    """Does a counter-clockwise ring never turn right?"""
    n = len(ring)
    for i in range(n):
        (ax, ay), (bx, by), (px, py) = ring[i], ring[(i + 1) % n], ring[(i + 2) % n]
        if (bx - ax) * (py - by) - (by - ay) * (px - bx) < -1e-12:
            return False
    return True


def _outline(edge_list) -> list[list]:
    """Open rings of an edge list."""
    rings, ring, last = [], [], None
    for e in edge_list:
        a, b = (e["ax"], e["ay"]), (e["bx"], e["by"])
        if last is not None and a != last:
            rings.append(ring)
            ring = []
        ring.append(a)
        last = b
        if ring and b == ring[0]:
            rings.append(ring)
            ring, last = [], None
    if ring:
        rings.append(ring)
    return rings


def _triangles(ring: list) -> list[list]:
    """Fan of signed triangles from the first corner; their signed areas add up to the ring."""
    return [[ring[0], ring[i], ring[i + 1]] for i in range(1, len(ring) - 1)]


def clip_area(a, b) -> float:
    """Overlap area of two polygons given as edge lists, holes and concave rings included.

    Rings of the second polygon that are not convex are taken as a fan of signed
    triangles, each of them convex.
    """
    total = 0.0
    for ring_b in _outline(b):
        sign_b = 1.0 if _signed(ring_b) > 0 else -1.0
        ccw = ring_b if sign_b > 0 else ring_b[::-1]
        parts = [ccw] if _is_convex(ccw) else _triangles(ccw)
        for part in parts:
            s = _signed(part)
            if s == 0:
                continue
            convex = part if s > 0 else part[::-1]
            weight = sign_b * (1.0 if s > 0 else -1.0)
            for ring_a in _outline(a):
                total += weight * _signed(_clip(ring_a, convex)) if len(ring_a) > 2 else 0.0
    return abs(total)


def _has_specks(edges: np.ndarray) -> bool:
    """Is some edge so short, next to the whole, that its direction is rounding?"""
    size = np.hypot(edges[:, 2] - edges[:, 0], edges[:, 3] - edges[:, 1])
    return bool((size < 1e-9 * np.ptp(edges[:, :2], axis=0).max(initial=0.0)).any())


def polygon_overlap(a, b) -> float:
    """Overlap area of two polygons given as edge lists: by clipping, or by slabs where an edge has no sure direction."""
    second = _edge_array(b)
    return area_within(_edge_array(a), [second]) if len(second) > CLIP_EDGES or _has_specks(second) else clip_area(a, b)


def _edge_dicts(edges: np.ndarray) -> list[dict]:
    return [dict(zip(("ax", "ay", "bx", "by"), e, strict=True)) for e in edges.tolist()]


def _slow_overlap(a: np.ndarray, b: np.ndarray) -> float:
    return polygon_overlap(_edge_dicts(a), _edge_dicts(b))


def overlap_pairs(parcels: DataFrame, layer: DataFrame, cell: float) -> DataFrame:
    """Intersecting pairs with their overlap area.

    With large polygons areas are summed per pair; rows that repeat shape and columns then count once.
    """
    (left, large_left), (right, large_right) = tl.side(parcels, "l_"), tl.side(layer, "r_")
    own = [*_own(parcels), *_own(layer)]
    if not (large_left or large_right):
        return tl.joined(left, right, cell, tl.overlapping(_slow_overlap, CLIP_EDGES), _own(parcels), _own(layer), "overlap")
    whole, piece = ([f"{x}_{p}" for p in ("l_", "r_")] for x in (WHOLE, PIECE))
    pairs = tl.joined(left, right, cell, tl.overlapping(_slow_overlap, CLIP_EDGES), [*_own(parcels), whole[0], piece[0]], [*_own(layer), whole[1], piece[1]], "overlap")
    once = pairs.groupBy(*own, *whole, *piece).agg(F.max("overlap").alias("overlap"))
    return once.groupBy(*own, *whole).agg(F.sum("overlap").alias("overlap")).drop(*whole)


def box_overlap_pairs(parcels: DataFrame, layer: DataFrame, cell: float) -> DataFrame:
    """The same for layers of rectangles, fully as expressions; sides are l_ and r_ boxes."""
    pairs = gr.cell_pairs(parcels, layer, cell)
    sides = [tuple(c(f"{p}{n}") for n in gr.BOX) for p in ("l_", "r_")]
    return pairs.withColumn("overlap", gm.box_overlap(*sides))


def overlap_area(parcels: DataFrame, layer: DataFrame, cell: float) -> DataFrame:
    """Largest single overlap area per parcel."""
    hits = overlap_pairs(parcels.select(KEY, "rings"), layer.select("rings"), cell)
    return _facts(parcels, hits.groupBy(KEY).agg(F.max("overlap").alias("val")))


def overlap_pct(parcels: DataFrame, layer: DataFrame, cell: float) -> DataFrame:
    """Largest single overlap as a share of the parcel area."""
    sized = parcels.select(KEY, F.nullif(gm.area(c("rings")), F.lit(0.0)).alias("a"))
    return overlap_area(parcels, layer, cell).join(sized, KEY).select(KEY, (c("val") / c("a")).alias("val"))


def buffer_overlap_area(parcels: DataFrame, layer: DataFrame, distance: float, cell: float, corners: int = 32, square: bool = False) -> DataFrame:
    """Largest overlap of a parcel with one feature grown by a distance.

    A feature is grown by a regular polygon of `corners` corners, or by an upright square,
    whatever its shape: it is its own area together with what each of its edges sweeps. A parcel that only lies in the
    hull of a bent feature has no overlap.
    """
    # Grown pieces would overlap one another, so shapes stay whole here.
    left, right = (tl.named_side(tl.packed(df.select(*own, "rings")), p, F.lit(g)) for df, own, p, g in ((parcels, [KEY], "l_", 0.0), (layer, [], "r_", distance)))
    angle = 2 * np.pi * np.arange(corners) / corners
    shape = distance * (np.array([(1, 1), (-1, 1), (-1, -1), (1, -1)], float) if square else np.stack([np.cos(angle), np.sin(angle)], axis=1))
    hits = tl.joined(left, right, cell, tl.largest_grown(shape, lambda a, b: _grown_area(a, b, shape)), [KEY], [], "overlap", grow=distance)
    return _facts(parcels, hits.groupBy(KEY).agg(F.max("overlap").alias("val")))


def _edge_array(edge_list) -> np.ndarray:
    return np.array([(e["ax"], e["ay"], e["bx"], e["by"]) for e in edge_list], float).reshape(-1, 4)


def _swept(edges: np.ndarray, box: np.ndarray, shape: np.ndarray) -> list[np.ndarray]:
    """What a convex shape covers that moves along each edge near a box: convex rings, as edges."""
    distance = np.abs(shape).max()
    out = []
    for ax, ay, bx, by in edges:
        if min(ax, bx) - distance > box[2] or max(ax, bx) + distance < box[0] or min(ay, by) - distance > box[3] or max(ay, by) + distance < box[1]:
            continue
        hull = np.array(convex_hull([tuple(p) for p in np.concatenate([shape + (ax, ay), shape + (bx, by)])]))
        out.append(np.concatenate([hull, np.roll(hull, -1, axis=0)], axis=1))
    return out


def _crossings(edges: np.ndarray) -> np.ndarray:
    """x of the points where edges cross."""
    d = edges[:, 2:] - edges[:, :2]
    cross = d[:, None, 0] * d[None, :, 1] - d[:, None, 1] * d[None, :, 0]
    gap = edges[None, :, :2] - edges[:, None, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[:, :, 0] * d[None, :, 1] - gap[:, :, 1] * d[None, :, 0]) / cross
        u = (gap[:, :, 0] * d[:, None, 1] - gap[:, :, 1] * d[:, None, 0]) / cross
    hit = (np.abs(cross) > 1e-300) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
    i, j = np.nonzero(np.triu(hit))
    return edges[i, 0] + t[i, j] * d[i, 0]


def _strips(edges: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper ends of the inside of a polygon (even-odd) on vertical lines; empty ones are infinite."""
    low, high = np.minimum(edges[:, 0], edges[:, 2]), np.maximum(edges[:, 0], edges[:, 2])
    on = (x[:, None] > low) & (x[:, None] < high)
    with np.errstate(divide="ignore", invalid="ignore"):
        y = edges[:, 1] + (x[:, None] - edges[:, 0]) / (edges[:, 2] - edges[:, 0]) * (edges[:, 3] - edges[:, 1])
    y = np.sort(np.where(on, y, np.inf), axis=1)
    if y.shape[1] % 2:
        y = np.concatenate([y, np.full((len(y), 1), np.inf)], axis=1)
    return y[:, 0::2], y[:, 1::2]


def grown_overlap(a, b, shape: np.ndarray) -> float:
    """Overlap area of polygon `a` with polygon `b` grown by a convex shape."""
    return _grown_area(_edge_array(a), _edge_array(b), shape)


def _grown_area(first: np.ndarray, second: np.ndarray, shape: np.ndarray) -> float:
    box = np.array([first[:, 0].min(), first[:, 1].min(), first[:, 0].max(), first[:, 1].max()])
    return area_within(first, [second, *_swept(second, box, shape)])


def area_within(first: np.ndarray, parts: list[np.ndarray]) -> float:
    """Area of a polygon that a union of polygons covers, all given as edges, from vertical slabs.

    Between two neighboring corners or crossings all borders are straight, so the length of
    the overlap on the middle line times the width is the exact area of a slab. Rings may run
    either way round.
    """
    edges = np.concatenate([first, *parts])
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    n = len(first)
    if n == len(edges) or not n:
        return 0.0
    start, end = np.maximum(low[:n].min(axis=0), low[n:].min(axis=0)), np.minimum(high[:n].max(axis=0), high[n:].max(axis=0))
    if (start >= end).any():
        return 0.0
    near = ((low <= end) & (high >= start)).all(axis=1)
    x = np.concatenate([edges[:, 0], _crossings(edges[near]), [start[0], end[0]]])
    x = np.unique(x[(x >= start[0]) & (x <= end[0])])
    middle, width = (x[1:] + x[:-1]) / 2, np.diff(x)
    here = lambda e: e[(np.minimum(e[:, 0], e[:, 2]) < end[0]) & (np.maximum(e[:, 0], e[:, 2]) > start[0])]
    ends = [_strips(here(p), middle) for p in parts]
    low, high = np.concatenate([e[0] for e in ends], axis=1), np.concatenate([e[1] for e in ends], axis=1)
    total = np.zeros(len(middle))
    for floor, roof in zip(*(side.T[:, :, None] for side in _strips(here(first), middle)), strict=True):
        lo, hi = np.clip(low, floor, roof), np.clip(high, floor, roof)
        if lo.shape[1] > 1:
            order = np.argsort(lo, axis=1, kind="stable")
            lo, hi = np.take_along_axis(lo, order, 1), np.take_along_axis(hi, order, 1)
            before = np.concatenate([np.full((len(lo), 1), -np.inf), np.maximum.accumulate(hi, axis=1)[:, :-1]], axis=1)
            lo = np.maximum(lo, before)
        with np.errstate(invalid="ignore"):
            length = np.nan_to_num(hi - lo, nan=0.0, posinf=0.0)
        total += np.where(np.isfinite(floor[:, 0]), np.maximum(length, 0.0).sum(axis=1), 0.0)
    return float((total * width).sum())


def convex_hull(points: list) -> list:
    """Counter-clockwise hull (monotone chain), without repeating the first point."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        chain: list = []
        for p in seq:
            while len(chain) >= 2 and (
                (chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1]) - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0]) <= 0
            ):
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return half(pts) + half(pts[::-1])


def within(
    points: DataFrame, layer: DataFrame, distance: float, cell: float, where: Column | None = None, measure: Column | None = None
) -> DataFrame:
    """Point and feature pairs no farther apart than `distance`.

    `measure` is the distance by columns of the layer, where these state it (a rectangle's corner and side);
    it then decides pairs whose distance by edges differs from the limit in rounding only.
    """
    kept = layer if where is None else layer.where(where)
    pieces, cut = subdivide(kept)
    reach = distance if measure is None else distance * (1 + 1e-6) + 1e-9
    pairs = gr.cell_pairs(as_points_keep(points), as_polygons(pieces, "r_", grow=reach), cell)
    near = pairs.withColumn("distance", gm.point_distance(c("r_edges"), c("px"), c("py"))).where(c("distance") <= reach)
    if cut:
        own = [x for x in near.columns if x not in ("r_edges", "distance", PIECE, *_boxes())]
        near = near.groupBy(own).agg(F.min("distance").alias("distance"))
    if measure is not None:
        near = near.withColumn("distance", measure).where(c("distance") <= distance)
    return near.drop(*_shapes())


def parcels_within(parcels: DataFrame, layer: DataFrame, distance: float, cell: float, where: Column | None = None) -> DataFrame:
    """Every parcel with `val` = true when a feature lies within the distance of its polygon."""
    kept = layer if where is None else layer.where(where)
    (left, _), (right, _) = tl.side(parcels.select(KEY, "rings"), "l_"), tl.side(kept.select("rings"), "r_", grow=distance)
    near = tl.joined(left, right, cell, tl.within(distance), [KEY], [], grow=distance, distinct=True).distinct()
    return _facts(parcels, near.withColumn("val", F.lit(True)))


def nearest_fact(
    points: DataFrame, layer: DataFrame, feature_id: str, column: str | None = None, where: Column | None = None
) -> DataFrame:
    """Distance to the nearest point feature, and optionally one of its attributes."""
    kept = layer if where is None else layer.where(where)
    extra = [c(column).alias("attribute")] if column else []
    features = gr.point_box(kept.select(c(feature_id).alias("feature_id"), "x", "y", *extra)).drop("x", "y")
    found = gr.nearest(points.select(KEY, "x", "y"), features, 1, point_id=KEY)
    return points.select(KEY).join(found.select(KEY, "feature_id", "distance", *(["attribute"] if column else [])), KEY, "left")


def nearest_polygon(points: DataFrame, layer: DataFrame, feature_id: str) -> DataFrame:
    """Distance to the nearest polygon, 0 inside.

    The nearest corner bounds how far the nearest polygon can lie, so only polygons whose box
    lies within that reach of a point are measured.
    """
    pieces, _ = subdivide(layer.select(c(feature_id).alias("feature_id"), "rings"))
    shaped = pieces.select("feature_id", gm.edges(c("rings")).alias("edges"), gm.starts(c("rings"))[0].alias("one"), gm.bbox(c("rings")).alias("b"))
    polygons = cut_lineage(gr.box_of(shaped, c("b.x0"), c("b.y0"), c("b.x1"), c("b.y1"), "r_").drop("b"))
    corners = gr.point_box(polygons.select("feature_id", c("one.x").alias("x"), c("one.y").alias("y"))).drop("x", "y")
    reach = c("distance") * (1 + 1e-9) + (F.abs("x") + F.abs("y")) * 1e-12
    reached = cut_lineage(gr.nearest(points.select(KEY, "x", "y"), corners, 1, point_id=KEY).select(KEY, "x", "y", reach.alias("reach")))
    sides = polygons.agg(F.avg(F.greatest(c("r_x1") - c("r_x0"), c("r_y1") - c("r_y0")))).first()[0] or 0.0
    cell = max(sides, 2 * (reached.agg(F.percentile_approx("reach", 0.5)).first()[0] or 0.0)) or 1.0
    # The square around a point far from every corner would hold very many polygons.
    far = c("reach") > FAR_CELLS * cell
    close = reached.where(~far)
    squares = gr.box_of(close, c("x") - c("reach"), c("y") - c("reach"), c("x") + c("reach"), c("y") + c("reach"), "l_")
    met = gr.cell_pairs(squares, polygons.drop("one"), cell)
    gap = F.hypot(F.greatest(c("r_x0") - c("x"), c("x") - c("r_x1"), F.lit(0.0)), F.greatest(c("r_y0") - c("y"), c("y") - c("r_y1"), F.lit(0.0)))
    d = gm.point_distance(c("edges"), c("x"), c("y"))
    measured = met.where(gap <= c("reach")).select(KEY, "feature_id", d.alias("distance"))
    found = first_by(measured, [KEY], [c("distance"), c("feature_id")])
    away = reached.where(far).select(KEY, "x", "y")
    if away.isEmpty():
        return found
    features = gr.box_of(polygons.select("feature_id", "edges", "r_x0", "r_y0", "r_x1", "r_y1"), c("r_x0"), c("r_y0"), c("r_x1"), c("r_y1"), "f_")
    more = gr.nearest(away, features, 1, point_id=KEY, distance=d)
    return found.unionByName(more.select(KEY, "feature_id", "distance"))


def shape_features(features: DataFrame, feature_id: str, filled: Column | bool, *keep: Column) -> DataFrame:
    """Features of any kind for `nearest_shapes`, from `rings` (lists of points).

    A point is a ring of one place, a line an open ring, a polygon a closed one; `filled`
    tells whether the inside belongs to the feature.
    """
    named = features.select(c(feature_id).alias("feature_id"), *keep, (F.lit(filled) if isinstance(filled, bool) else filled).alias("f_filled"), "rings")
    # Long lines go in chunks, large polygons in pieces; they keep the id of their feature.
    line = ~c("f_filled") & (corner_count(c("rings")) > MAX_CORNERS)
    short = named.withColumn("rings", F.explode(F.when(line, path_chunks(c("rings"))).otherwise(F.array("rings"))))
    paths = F.transform("rings", lambda r: F.when(F.size(r) == 1, F.concat(r, r)).otherwise(r))
    return tl.in_pieces(tl.packed(short.withColumn("rings", paths)), only="f_filled")[0].drop(WHOLE, PIECE)


def nearest_shapes(parcels: DataFrame, features: DataFrame, per: str | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(parcel, feature_id, distance): the nearest feature of each parcel polygon, 0 where they meet.

    `features` come from `shape_features`; `per` finds one for each value of a feature column,
    `keep` names feature columns to return as well. The nearest first corner bounds how far the
    nearest feature can lie, so only features whose box lies within that reach are measured.
    """
    extra = [per] if per else []
    pieces = tl.in_pieces(tl.packed(parcels.select(KEY, "rings")))[0].drop(WHOLE, PIECE).withColumnRenamed(tl.ROW, "s_row")
    corners = gr.point_box(features.select("feature_id", *extra, c("__x").alias("x"), c("__y").alias("y"))).drop("x", "y")
    found = gr.nearest(pieces.select("s_row", c("__x").alias("x"), c("__y").alias("y")), corners, 1, point_id="s_row", per=per)
    reach = c("distance") * (1 + 1e-9) + (F.abs("x") + F.abs("y")) * 1e-12
    asked = stored(pieces.join(found.select("s_row", *extra, reach.alias("reach")).hint("merge"), "s_row"), "asked")
    sides = features.agg(F.avg(F.greatest(c("__x1") - c("__x0"), c("__y1") - c("__y0")))).first()[0] or 0.0
    cell = max(sides, 2 * (asked.agg(F.percentile_approx("reach", 0.5)).first()[0] or 0.0)) or 1.0
    left, right = tl.named_side(asked, "l_", c("reach")), tl.named_side(features, "r_", F.lit(0.0))
    near = tl.joined(
        left, right, cell, tl.nearest("f_filled", "reach"), [KEY, *extra], ["feature_id", *keep], "distance",
        equal=extra, reach="reach", order="feature_id", needs=["f_filled"],
    )
    # All pieces of a parcel are ranked together.
    return first_by(near.select(KEY, *extra, "feature_id", "distance", *keep), [KEY, *extra], [c("distance"), c("feature_id")])


def shape_distances(parcels: DataFrame, features: DataFrame, classes: Sequence, per: str = "cls") -> DataFrame:
    """Distance of each parcel polygon to the nearest feature of every class, one column per class."""
    found = nearest_shapes(parcels, features.where(c(per).isin(*classes)), per)
    wide = found.groupBy(KEY).agg(*[F.min(F.when(c(per) == v, c("distance"))).alias(f"dist_{v}") for v in classes])
    return parcels.select(KEY).join(wide, KEY, "left")


def nearest_shape_fact(
    parcels: DataFrame, layer: DataFrame, feature_id: str, column: str | None = None, where: Column | None = None, filled: Column | bool | None = None
) -> DataFrame:
    """Distance of each parcel polygon to the nearest line or polygon, and optionally one of its attributes.

    `filled` tells whether the inside belongs to a feature; None takes it from whether its rings are closed.
    """
    kept = layer if where is None else layer.where(where)
    if filled is None:
        filled = F.forall("rings", lambda r: (F.size(r) > 3) & (F.element_at(r, 1) == F.element_at(r, -1)))
    extra = [c(column).alias("attribute")] if column else []
    names = ["attribute"] if column else []
    found = nearest_shapes(parcels, shape_features(kept, feature_id, filled, *extra), keep=names)
    return parcels.select(KEY).join(found.select(KEY, "feature_id", "distance", *names), KEY, "left")


def nearest_yield_class(parcels: DataFrame, wells: DataFrame, feature_id: str, flow: str, where: Column | None = None) -> DataFrame:
    """Yield class of the nearest point, or of the nearest line or polygon where the layer has rings."""
    nearest = nearest_shape_fact if "rings" in wells.columns else nearest_fact
    found = nearest(parcels, wells, feature_id, flow, where)
    return found.select(KEY, F.when(c("feature_id").isNotNull(), yield_class(c("attribute"))).alias("val"))


def amenity_distances(points: DataFrame, features: DataFrame, classes: Sequence, feature_id: str, class_column: str) -> DataFrame:
    """Distance to the nearest feature of every class, one column per class.

    All classes descend the same pyramid in one pass.
    """
    kept = features.where(c(class_column).isin(*classes))
    shaped = gr.point_box(kept.select(c(feature_id).alias("feature_id"), c(class_column).alias("cls"), "x", "y")).drop("x", "y")
    found = gr.nearest(points.select(KEY, "x", "y"), shaped, 1, point_id=KEY, per="cls")
    wide = found.groupBy(KEY).agg(*[F.min(F.when(c("cls") == v, c("distance"))).alias(f"dist_{v}") for v in classes])
    return points.select(KEY).join(wide, KEY, "left")


def density_per_acre(parcels: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """Points inside each parcel per acre of its area (square feet)."""
    sized = parcels.select(KEY, F.nullif(gm.area(c("rings")) / SQFT_PER_ACRE, F.lit(0.0)).alias("acres"))
    hits = contains_join(points, parcels.select(KEY, "rings"), cell).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"))
    return sized.join(hits, KEY, "left").select(KEY, (F.coalesce(c("n"), F.lit(0)) / c("acres")).alias("val"))


def nearby(df: DataFrame, lat: float, lon: float, radius: float = 1000.0, limit: int = 50) -> DataFrame:
    """Parcels around a position: a degree box prunes the scan, then exact metres."""
    dlat = math.degrees(radius / gm.EARTH_RADIUS_M) * 1.001
    dlon = dlat / max(math.cos(math.radians(lat)), 1e-6) * 1.01
    near = df.where(c("latitude").between(lat - dlat, lat + dlat) & c("longitude").between(lon - dlon, lon + dlon))
    metres = gm.haversine(F.lit(lat), F.lit(lon), c("latitude"), c("longitude"))
    return near.withColumn("distance_meters", metres).where(c("distance_meters") <= radius).orderBy("distance_meters", KEY).limit(limit)


def water_facts(
    parcels: DataFrame, places_of_use: DataFrame, diversions: DataFrame, cell: float, radius_m: float = 5000.0
) -> DataFrame:
    """Rights on the parcel and the nearest diversion within a radius (metres on the sphere).

    Parcels carry rings plus latitude and longitude; diversions latitude, longitude,
    right number and date.
    """
    rights = intersects_list(parcels.select(KEY, "rings"), places_of_use.select("rings", "right_no"), "right_no", cell)
    # The nearest on a plane bounds how far the nearest on the sphere can lie; only that circle is searched.
    flat = lambda lon, lat: (lon * math.cos(math.radians(47.5)), lat)
    x, y = flat(c("longitude"), c("latitude"))
    wells = diversions.select(F.monotonically_increasing_id().alias("feature_id"), x.alias("x"), y.alias("y"), c("latitude").alias("f_lat"), c("longitude").alias("f_lon"))
    spots = parcels.select(KEY, "latitude", "longitude", x.alias("x"), y.alias("y"))
    first = gr.nearest(spots, gr.point_box(wells).drop("x", "y"), 1, point_id=KEY)
    bound = gm.haversine(c("latitude"), c("longitude"), c("f_lat"), c("f_lon")) * (1 + 1e-9) + 1e-3
    reach = first.select(KEY, c("longitude").alias("px"), c("latitude").alias("py"), F.least(bound, F.lit(radius_m)).alias("reach"))
    lat_step = c("reach") / 111_000.0
    lon_step = lat_step / F.greatest(F.cos(F.radians(F.abs(c("py")) + lat_step)), F.lit(0.01))
    circles = gr.box_of(reach, c("px") - lon_step, c("py") - lat_step, c("px") + lon_step, c("py") + lat_step, "l_")
    spots = gr.box_of(diversions.select("latitude", "longitude", "right_no", "event_date"), c("longitude"), c("latitude"), c("longitude"), c("latitude"), "r_")
    pairs = gr.cell_pairs(circles, spots, radius_m / 111_000.0 / 16)
    metres = gm.haversine(c("py"), c("px"), c("latitude"), c("longitude"))
    near = pairs.withColumn("m", metres).where(c("m") <= c("reach")).groupBy(KEY).agg(
        F.min(F.struct("m", "right_no", "event_date")).alias("d")
    )
    return rights.join(near, KEY, "left").select(
        KEY, c("val").isNotNull().alias("has_right"), c("val").alias("rights"), c("d.right_no").alias("nearest_right"),
        c("d.m").alias("nearest_m"), c("d.event_date").alias("nearest_date"),
    )


def filter_intersecting(layer: DataFrame, boundary: DataFrame, cell: float, key: str) -> DataFrame:
    """Features that meet any boundary polygon."""
    hit = intersecting(layer.select(key, "rings"), boundary.select("rings"), cell).select(key).distinct()
    return layer.join(hit, key, "left_semi")


def sales_in_view(
    parcels: DataFrame, sales: DataFrame, bbox: tuple[float, float, float, float], subject: tuple[float, float], n: int = 60
) -> DataFrame:
    """Parcels with a valid sale inside a map view, nearest to the subject first."""
    x0, y0, x1, y1 = bbox
    seen = parcels.where(c("x").between(x0, x1) & c("y").between(y0, y1))
    sold = latest_valid_sale(sales.join(seen.select(KEY), KEY, "left_semi")).where("last_sale_price > 0")
    far = F.hypot(c("x") - subject[0], c("y") - subject[1])
    return seen.join(sold, KEY).withColumn("distance", far).orderBy("distance", KEY).limit(n)


def _hulls_by_group(group: str):
    """Per task: one hull per group over all its rows, kept small while reading."""

    def run(batches):
        kept: dict = {}
        for pdf in batches:
            for key, part in pdf.groupby(group, dropna=False):
                kept[key] = convex_hull(kept.get(key, []) + list(zip(part["x"], part["y"])))
        rows = [(key, x, y) for key, hull in kept.items() for x, y in hull]
        yield pd.DataFrame(rows, columns=[group, "x", "y"])

    return run


def hood_outline(points: DataFrame, group: str, x: str = "x", y: str = "y", pad: float = 25.0, salts: int = 32) -> DataFrame:
    """Convex hull per neighborhood; points and lines are padded to an area.

    Every task first reduces its rows to hull corners, then salted parts of a
    group are merged, then the parts; no task ever holds a whole neighborhood.
    """
    kind = points.schema[group].dataType.simpleString()
    schema = f"{group} {kind}, x double, y double"
    spots = points.where(c(x).isNotNull() & c(y).isNotNull()).select(group, c(x).cast("double").alias("x"), c(y).cast("double").alias("y"))
    corners = spots.mapInPandas(_hulls_by_group(group), schema)
    salted = corners.withColumn("s", F.pmod(F.xxhash64("x", "y"), F.lit(salts)))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull(list(zip(pdf["x"], pdf["y"])))
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(hull), "x": [p[0] for p in hull], "y": [p[1] for p in hull]})

    def close(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull(list(zip(pdf["x"], pdf["y"])))
        if len(hull) < 3:
            steps = [math.pi / 8 * i for i in range(16)]
            hull = convex_hull([(px + pad * math.cos(a), py + pad * math.sin(a)) for px, py in hull for a in steps])
        ring = [{"x": px, "y": py} for px, py in [*hull, hull[0]]]
        return pd.DataFrame({group: [pdf[group].iloc[0]], "rings": [[ring]]})

    parts = salted.groupBy(group, "s").applyInPandas(merge, schema)
    return parts.groupBy(group).applyInPandas(close, f"{group} {kind}, rings array<array<struct<x:double,y:double>>>")


def assign_zone(hits: DataFrame, by_source: bool = False) -> DataFrame:
    """Zone of each parcel by largest overlap, or by source rank, then overlap, then id."""
    order = [c("overlap").desc(), c("zone_id")]
    if by_source:
        rank = F.when(c("source") == "ManualOverride", 3).when(c("source") == "CityGIS", 2).when(c("source") == "WAZA", 1).otherwise(0)
        order = [rank.desc(), *order]
    return first_by(hits, [KEY], order)
