"""Meetings, distances and overlap areas of very many pairs of shapes, in flat NumPy arrays.

A shape is a list of rings. Rings whose boxes do not touch are parts of their own, so a
polygon of two far squares is compared by two small boxes. A pair of parts is judged by the
edges that come near the other part's box; no Python code runs per pair, except for shapes
that are not valid polygons.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from parcelmill.functions.shapes import _far, _meet

#: Pairs of parts, or of edges, held at a time.
AT_ONCE = 500_000
#: A shape of more rings is not taken apart.
MAX_RINGS = 256


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner and position of every item, where owner i has counts[i] items."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def slices(sizes: np.ndarray, most: int = AT_ONCE) -> Iterator[slice]:
    """Runs of items whose sizes add up to `most` at most, or one item."""
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + most, side="right")))
        yield slice(at, end)
        at = end


def written(rings: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Shapes as bytes (number of rings, points of each, points; all as doubles), their bounds, first points and numbers of points."""
    first, n = rings.offsets.to_numpy().astype(np.int64), len(rings)
    held = rings.values
    point_at = held.offsets.to_numpy().astype(np.int64)
    place = dict(zip([f.name for f in held.values.type], held.values.flatten(), strict=True))
    p = np.stack([place[x].to_numpy(zero_copy_only=False).astype(float) for x in "xy"], axis=1) if len(held.values) else np.empty((0, 2))
    k, size = np.diff(first), np.diff(point_at)[first[0] : first[-1]]
    points = point_at[first[1:]] - point_at[first[:-1]]
    length = 1 + k + 2 * points
    begin = np.cumsum(length) - length
    out = np.empty(int(length.sum()))
    out[begin] = k
    row, j = ragged(k)
    out[begin[row] + 1 + j] = size
    row, j = ragged(2 * points)
    out[begin[row] + 1 + k[row] + j] = p[point_at[first[0]] : point_at[first[-1]]].ravel()
    box, corner = np.full((n, 4), np.nan), np.full((n, 2), np.nan)
    if (some := points > 0).any():
        at = (np.cumsum(points) - points)[some]
        own = p[point_at[first[0]] : point_at[first[-1]]]
        box[some] = np.concatenate([np.fmin.reduceat(own, at, axis=0), np.fmax.reduceat(own, at, axis=0)], axis=1)
        corner[some] = own[at]
    if held.null_count:
        box[ragged(k)[0][held.is_null().to_numpy(zero_copy_only=False)[first[0] : first[-1]]]] = np.nan
    offsets = np.concatenate([begin, [out.size]]) * 8
    blob = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(out)])
    return blob, box, corner, points


@dataclass
class Shapes:
    """Edges of many shapes by ring, rings by part, parts by row."""

    edges: np.ndarray
    ring_first: np.ndarray
    ring_edges: np.ndarray
    ring_box: np.ndarray
    part_row: np.ndarray
    part_ring: np.ndarray
    part_rings: np.ndarray
    part_first: np.ndarray
    part_edges: np.ndarray
    part_box: np.ndarray
    unknown: np.ndarray  # rows with a missing coordinate

    def __post_init__(self) -> None:
        e = self.edges
        self.low = [np.ascontiguousarray(np.minimum(e[:, i], e[:, i + 2])) for i in (0, 1)]
        self.high = [np.ascontiguousarray(np.maximum(e[:, i], e[:, i + 2])) for i in (0, 1)]
        self.ay, self.by = np.ascontiguousarray(e[:, 1]), np.ascontiguousarray(e[:, 3])


def _labels(row: np.ndarray, box: np.ndarray, rows: int) -> np.ndarray:
    """The first ring of the part of every ring."""
    rings = np.bincount(row, minlength=rows)
    label = np.arange(len(row))
    first = np.cumsum(rings) - rings
    crowd = rings[row] > MAX_RINGS
    label[crowd] = first[row[crowd]]
    n = np.where((rings > 1) & (rings <= MAX_RINGS), rings, 0)[row]
    links = [(first[:0], first[:0])]
    for part in slices(n):
        owner, t = ragged(n[part])
        i = owner + part.start
        j = first[row[i]] + t
        near = (i < j) & (box[i, :2] <= box[j, 2:]).all(axis=1) & (box[j, :2] <= box[i, 2:]).all(axis=1)
        links.append((i[near], j[near]))
    i, j = (np.concatenate(x) for x in zip(*links, strict=True))
    while (label[i] != label[j]).any():
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
    return label


def read(column: pa.Array) -> Shapes:
    """Shapes from their bytes."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    flat = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].copy().view(np.float64)
    begin = (offsets[:-1] - offsets[0]) // 8
    k = flat[begin].astype(np.int64)
    row, j = ragged(k)
    size = flat[begin[row] + 1 + j].astype(np.int64)
    before = np.cumsum(2 * size) - 2 * size
    start = begin[row] + 1 + k[row] + before - before[np.minimum(np.cumsum(k) - k, max(len(before) - 1, 0))[row]]
    real = size > 1
    row, start, size = row[real], start[real], size[real]
    ring, t = ragged(size)
    points = flat[(start[ring] + 2 * t)[:, None] + np.arange(2)]
    at = np.cumsum(size) - size
    empty = np.empty((0, 4))
    box = np.concatenate([np.fmin.reduceat(points, at, axis=0), np.fmax.reduceat(points, at, axis=0)], axis=1) if len(at) else empty
    label = _labels(row, box, n)
    order = np.argsort(label, kind="stable")
    row, start, size, box, label = row[order], start[order], size[order], box[order], label[order]
    ring, t = ragged(size - 1)
    edges = flat[(start[ring] + 2 * t)[:, None] + np.arange(4)]
    ring_first = np.cumsum(size - 1) - (size - 1)
    first = np.flatnonzero(np.r_[True, label[1:] != label[:-1]]) if len(label) else np.empty(0, np.int64)
    rings = np.diff(np.r_[first, len(label)])
    part_edges = np.add.reduceat(size - 1, first) if len(first) else np.empty(0, np.int64)
    part_box = np.concatenate([np.fmin.reduceat(box[:, :2], first, axis=0), np.fmax.reduceat(box[:, 2:], first, axis=0)], axis=1) if len(first) else empty
    unknown = np.bincount(row[ring], np.isnan(edges).any(axis=1), n) > 0
    return Shapes(edges, ring_first, size - 1, box, row[first], first, rings, ring_first[first], part_edges, part_box, unknown)


def candidates(a: Shapes, b: Shapes, tile_a: np.ndarray, tile_b: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of parts of one tile whose boxes come within the reach of a's row."""
    ta, tb = tile_a[a.part_row], tile_b[b.part_row]
    by_a, by_b = np.argsort(ta, kind="stable"), np.lexsort((b.part_box[:, 0], tb))
    ta, tb = ta[by_a], tb[by_b]
    for tile in np.intersect1d(ta, tb).tolist():
        i = by_a[np.searchsorted(ta, tile) : np.searchsorted(ta, tile, side="right")]
        j = by_b[np.searchsorted(tb, tile) : np.searchsorted(tb, tile, side="right")]
        far = reach[a.part_row[i]]
        left, box = b.part_box[j, 0], a.part_box[i]
        widest = np.nanmax(b.part_box[j, 2] - left, initial=0.0)
        lo = np.searchsorted(left, box[:, 0] - far - widest * (1 + 1e-9) - 1e-300)
        n = np.maximum(np.searchsorted(left, box[:, 2] + far, side="right") - lo, 0)
        for part in slices(n):
            owner, t = ragged(n[part])
            own = owner + part.start
            u, v = i[own], j[lo[own] + t]
            keep = np.ones(len(u), bool)
            for x in (0, 1):
                keep &= (a.part_box[u, x] - far[own] <= b.part_box[v, x + 2]) & (b.part_box[v, x] <= a.part_box[u, x + 2] + far[own])
            yield u[keep], v[keep]


def _close(s: Shapes, first: np.ndarray, count: np.ndarray, box: np.ndarray, reach: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(owner, edge) of the edges whose boxes come within a reach of the owner's box."""
    owner, t = ragged(count)
    edge = first[owner] + t
    box = np.stack([box[:, 0] - reach, box[:, 1] - reach, box[:, 2] + reach, box[:, 3] + reach])
    for axis in (0, 1):
        keep = (s.low[axis][edge] <= box[axis + 2][owner]) & (s.high[axis][edge] >= box[axis][owner])
        owner, edge = owner[keep], edge[keep]
    return owner, edge


def _product(n: int, ja: np.ndarray, ea: np.ndarray, jb: np.ndarray, eb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(owner, edge of a, edge of b) for all pairs of edges of one owner; both lists are sorted by owner."""
    nb = np.bincount(jb, minlength=n)
    first = np.cumsum(nb) - nb
    for part in slices(nb[ja]):
        own, t = ragged(nb[ja[part]])
        own += part.start
        yield ja[own], ea[own], eb[first[ja[own]] + t]


def _holds(s: Shapes, first: np.ndarray, count: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Does a list of edges hold a place (even-odd)?"""
    out = np.zeros(len(places), bool)
    for part in slices(count):
        owner, t = ragged(count[part])
        edge = first[part][owner] + t
        y = places[part, 1][owner]
        spans = (s.ay[edge] > y) != (s.by[edge] > y)
        owner, e, p = owner[spans], s.edges[edge[spans]], places[part][owner[spans]]
        with np.errstate(divide="ignore", invalid="ignore"):
            at = (e[:, 2] - e[:, 0]) * (p[:, 1] - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]
        out[part] = np.bincount(owner[p[:, 0] < at], minlength=len(out[part])) % 2 == 1
    return out


def _ring_held(a: Shapes, pa_: np.ndarray, b: Shapes, pb: np.ndarray) -> np.ndarray:
    """Does a part of b hold the first corner of a ring of a part of a? Of rings with missing coordinates all corners are asked."""
    owner, t = ragged(a.part_rings[pa_])
    edge = a.ring_first[a.part_ring[pa_][owner] + t]
    if (some := np.flatnonzero(a.unknown[a.part_row[pa_]])).size:
        own, t = ragged(a.part_edges[pa_[some]])
        owner, edge = np.concatenate([owner, some[own]]), np.concatenate([edge, a.part_first[pa_[some]][own] + t])
    corner = a.edges[edge, :2]
    box = b.part_box[pb][owner]
    near = (corner >= box[:, :2]).all(axis=1) & (corner <= box[:, 2:]).all(axis=1)
    owner, corner = owner[near], corner[near]
    held = _holds(b, b.part_first[pb][owner], b.part_edges[pb][owner], corner)
    return np.bincount(owner[held], minlength=len(pa_)) > 0


def together(a: Shapes, b: Shapes, u: np.ndarray, v: np.ndarray, filled: np.ndarray | None = None) -> np.ndarray:
    """Do pairs of parts share a point? `filled` tells of b's rows whether their inside belongs to them."""
    out = np.zeros(len(u), bool)
    for part in slices(a.part_edges[u] + b.part_edges[v]):
        x, y = u[part], v[part]
        ja, ea = _close(a, a.part_first[x], a.part_edges[x], b.part_box[y])
        jb, eb = _close(b, b.part_first[y], b.part_edges[y], a.part_box[x])
        met = np.zeros(len(x), bool)
        for own, e, f in _product(len(x), ja, ea, jb, eb):
            box = (a.low[0][e] <= b.high[0][f]) & (b.low[0][f] <= a.high[0][e]) & (a.low[1][e] <= b.high[1][f]) & (b.low[1][f] <= a.high[1][e])
            own, e, f = own[box], e[box], f[box]
            met[own[_meet(a.edges[e], b.edges[f])]] = True
        # A ring that meets no border lies inside or outside as a whole.
        rest = np.flatnonzero(~met)
        met[rest] |= _ring_held(b, y[rest], a, x[rest])
        if filled is not None:
            rest = rest[filled[b.part_row[y[rest]]]]
        met[rest] |= _ring_held(a, x[rest], b, y[rest])
        out[part] = met
    return out


def gaps(a: Shapes, b: Shapes, u: np.ndarray, v: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """Distances of pairs of parts that do not meet, infinite beyond the reach."""
    out = np.full(len(u), np.inf)
    for part in slices(a.part_edges[u] + b.part_edges[v]):
        x, y, far = u[part], v[part], reach[part]
        ja, ea = _close(a, a.part_first[x], a.part_edges[x], b.part_box[y], far)
        jb, eb = _close(b, b.part_first[y], b.part_edges[y], a.part_box[x], far)
        found = out[part]
        for own, e, f in _product(len(x), ja, ea, jb, eb):
            p, q = a.edges[e], b.edges[f]
            np.minimum.at(found, own, np.minimum.reduce([_far(q, p[:, :2]), _far(q, p[:, 2:]), _far(p, q[:, :2]), _far(p, q[:, 2:])]))
    return out


def convex(s: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Signed areas of rings, and which are closed and convex."""
    e, n = s.edges, len(s.ring_first)
    if not n:
        return np.zeros(0), np.zeros(0, bool)
    owner, t = ragged(s.ring_edges)
    origin = e[s.ring_first][owner, :2]
    area = np.add.reduceat((e[:, 0] - origin[:, 0]) * (e[:, 3] - origin[:, 1]) - (e[:, 2] - origin[:, 0]) * (e[:, 1] - origin[:, 1]), s.ring_first) / 2
    d = e[:, 2:] - e[:, :2]
    after = np.where(t + 1 < s.ring_edges[owner], np.arange(len(e)) + 1, s.ring_first[owner])
    size = np.hypot(d[:, 0], d[:, 1])
    cross, dot = d[:, 0] * d[after, 1] - d[:, 1] * d[after, 0], (d * d[after]).sum(axis=1)
    flat = 1e-12 * size * size[after]
    turn = np.add.reduceat(np.arctan2(cross, dot), s.ring_first)
    every = lambda x: np.logical_and.reduceat(x, s.ring_first)
    one_way = every(cross >= -flat) | every(cross <= flat)
    closed = (e[s.ring_first, :2] == e[s.ring_first + s.ring_edges - 1, 2:]).all(axis=1)
    return area, closed & one_way & every(size > 0) & (np.abs(np.abs(turn) - 2 * np.pi) < 1e-6) & (area != 0)


def signs(s: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """+1 for edges with the inside below them, -1 above; and which parts are valid polygons, for which this holds."""
    area, is_convex = convex(s)
    rings = np.arange(len(area))
    good = (s.edges[s.ring_first, :2] == s.edges[s.ring_first + s.ring_edges - 1, 2:]).all(axis=1) & np.isfinite(area)
    # Rings that turn both ways must not touch themselves.
    bent = np.flatnonzero(good & ~is_convex)
    n = s.ring_edges[bent]
    owner, t = ragged(n)
    for part in slices(n[owner]):
        own, k = ragged(n[owner[part]])
        own += part.start
        i, ring = t[own], owner[own]
        apart = (k > i + 1) & ~((i == 0) & (k == n[ring] - 1))
        e, f, ring = s.ring_first[bent[ring]][apart] + i[apart], s.ring_first[bent[ring]][apart] + k[apart], ring[apart]
        box = (s.low[0][e] <= s.high[0][f]) & (s.low[0][f] <= s.high[0][e]) & (s.low[1][e] <= s.high[1][f]) & (s.low[1][f] <= s.high[1][e])
        good[bent[ring[box][_meet(s.edges[e[box]], s.edges[f[box]])]]] = False
    # Rings of one part must not touch one another; depth tells holes from outlines.
    depth = np.zeros(len(rings), np.int64)
    part_of = np.repeat(np.arange(len(s.part_row)), s.part_rings)
    crowd = s.part_rings > MAX_RINGS
    n = np.where((s.part_rings > 1) & ~crowd, s.part_rings, 0)[part_of]
    for part in slices(n, AT_ONCE // 16):
        owner, k = ragged(n[part])
        i = owner + part.start
        j = s.part_ring[part_of[i]] + k
        near = (i != j) & (s.ring_box[i, :2] <= s.ring_box[j, 2:]).all(axis=1) & (s.ring_box[j, :2] <= s.ring_box[i, 2:]).all(axis=1)
        i, j = i[near], j[near]
        half = i < j
        x, y = i[half], j[half]
        for some in slices(s.ring_edges[x] + s.ring_edges[y]):
            p, q = x[some], y[some]
            ja, ea = _close(s, s.ring_first[p], s.ring_edges[p], s.ring_box[q])
            jb, eb = _close(s, s.ring_first[q], s.ring_edges[q], s.ring_box[p])
            for own, e, f in _product(len(p), ja, ea, jb, eb):
                good[p[own[_meet(s.edges[e], s.edges[f])]]] = False
        held = _holds(s, s.ring_first[j], s.ring_edges[j], s.edges[s.ring_first[i], :2])
        depth += np.bincount(i[held], minlength=len(rings))
    way = np.sign(area) * np.where(depth % 2, -1.0, 1.0)
    edge = -np.sign(s.edges[:, 2] - s.edges[:, 0]) * np.repeat(way, s.ring_edges)
    valid = np.logical_and.reduceat(good, s.part_ring) & ~crowd if len(s.part_ring) else np.zeros(0, bool)
    return edge, valid


def shared(a: Shapes, sign_a: np.ndarray, b: Shapes, sign_b: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Overlap areas of pairs of parts that are valid polygons.

    Along any upright line, the length inside a polygon is the sum over its edges of their
    height, with + for edges that have the inside below and - for others. So the area that two
    polygons share is the same sum over pairs of edges of the area under the lower of both.
    """
    out = np.zeros(len(u))
    for part in slices(a.part_edges[u] + b.part_edges[v]):
        x, y = u[part], v[part]
        wide = lambda box, low: np.stack([box[:, 0], low, box[:, 2], np.full(len(box), np.inf)], axis=1)
        # What lies below all of a cancels out.
        ja, ea = _close(a, a.part_first[x], a.part_edges[x], wide(b.part_box[y], np.full(len(x), -np.inf)))
        jb, eb = _close(b, b.part_first[y], b.part_edges[y], wide(a.part_box[x], a.part_box[x, 1]))
        steep = sign_a[ea] != 0
        ja, ea = ja[steep], ea[steep]
        steep = sign_b[eb] != 0
        jb, eb = jb[steep], eb[steep]
        total = np.zeros(len(x))
        for own, e, f in _product(len(x), ja, ea, jb, eb):
            lo, hi = np.maximum(a.low[0][e], b.low[0][f]), np.minimum(a.high[0][e], b.high[0][f])
            some = lo < hi
            own, e, f, lo, hi = own[some], e[some], f[some], lo[some], hi[some]
            ground = a.part_box[x[own], 1]
            ends = []
            for s, k in ((a, e), (b, f)):
                q = s.edges[k]
                slope = (q[:, 3] - q[:, 1]) / (q[:, 2] - q[:, 0])
                at = [q[:, 1] + slope * (z - q[:, 0]) for z in (lo, hi)]
                ends.append([np.clip(z, s.low[1][k], s.high[1][k]) - ground for z in at])
            (p0, p1), (q0, q1) = ends
            d0, d1 = p0 - q0, p1 - q1
            cross = d0 * d1 < 0
            t = np.where(cross, d0 / np.where(cross, d0 - d1, 1.0), 0.0)
            first, last = np.minimum(p0, q0), np.minimum(p1, q1)
            middle = np.where(cross, p0 + t * (p1 - p0), first)
            under = (hi - lo) * (t * (first + middle) + (1 - t) * (middle + last)) / 2
            total += np.bincount(own, sign_a[e] * sign_b[f] * under, len(x))
        box = a.part_box[x]
        noise = 1e-15 * (box[:, 2] - box[:, 0]) * (box[:, 3] - box[:, 1])
        out[part] = np.where(total > noise, total, 0.0)
    return out


def grown(b: Shapes, rings: np.ndarray, shape: np.ndarray, area: np.ndarray) -> Shapes:
    """Convex rings grown by a convex counter-clockwise shape: edges of both by their direction."""
    n, k = len(rings), len(shape)
    owner, t = ragged(b.ring_edges[rings])
    e = b.edges[b.ring_first[rings][owner] + t]
    step = (e[:, 2:] - e[:, :2]) * np.sign(area[rings])[owner, None]
    own = np.concatenate([owner, np.repeat(np.arange(n), k)])
    step = np.concatenate([step, np.tile(np.roll(shape, -1, axis=0) - shape, (n, 1))])
    angle = np.arctan2(step[:, 1], step[:, 0]) % (2 * np.pi)
    order = np.lexsort((angle, own))
    own, step = own[order], step[order]
    # The lowest corner, of those the leftmost, comes before the edges of direction 0.
    low = np.lexsort((e[:, 0], e[:, 1], owner))
    first = low[np.searchsorted(owner[low], np.arange(n))]
    base = e[first, :2] + shape[np.lexsort((shape[:, 0], shape[:, 1]))[0]]
    count = np.bincount(own, minlength=n)
    at = np.cumsum(count) - count
    run = np.cumsum(step, axis=0)
    run -= np.repeat(run[at] - step[at], count, axis=0)
    ends = np.repeat(base, count, axis=0) + run
    starts = np.empty_like(ends)
    starts[1:] = ends[:-1]
    starts[at] = ends[at + count - 1]  # closed whatever rounding did
    edges = np.concatenate([starts, ends], axis=1)
    box = np.concatenate([np.fmin.reduceat(starts, at, axis=0), np.fmax.reduceat(starts, at, axis=0)], axis=1)
    one = np.ones(n, np.int64)
    return Shapes(edges, at, count, box, np.arange(n), np.arange(n), one, at, count, box, np.zeros(n, bool))
