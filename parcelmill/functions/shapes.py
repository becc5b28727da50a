"""Predicates and distances of pairs of shapes, for whole batches of pairs at once.

A shape is a list of edges. All pairs of edges of all pairs of shapes of a batch stand in
flat arrays, so no Python code runs per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

#: Pairs of edges held at a time.
_AT_ONCE = 400_000


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of all rows, and where each row's begin and how many they are."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    edges = np.stack([values.field(n).to_numpy(zero_copy_only=False) for n in ("ax", "ay", "bx", "by")], axis=1).astype(float)
    return edges, offsets[:-1], np.diff(offsets)


def _chunks(sizes: np.ndarray) -> Iterator[slice]:
    """Runs of rows with at most `_AT_ONCE` pairs of edges, or one row."""
    at, total = 0, np.cumsum(sizes)
    while at < len(sizes):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + _AT_ONCE, side="right")))
        yield slice(at, end)
        at = end


def _meet(e: np.ndarray, f: np.ndarray) -> np.ndarray:
    """Do two segments share a point?"""
    def side(a: np.ndarray, p: np.ndarray) -> np.ndarray:
        return np.sign((a[:, 2] - a[:, 0]) * (p[:, 1] - a[:, 1]) - (a[:, 3] - a[:, 1]) * (p[:, 0] - a[:, 0]))

    boxes = np.ones(len(e), bool)
    for i in (0, 1):
        boxes &= np.maximum(e[:, i], e[:, i + 2]) >= np.minimum(f[:, i], f[:, i + 2])
        boxes &= np.maximum(f[:, i], f[:, i + 2]) >= np.minimum(e[:, i], e[:, i + 2])
    return boxes & (side(e, f[:, :2]) * side(e, f[:, 2:]) <= 0) & (side(f, e[:, :2]) * side(f, e[:, 2:]) <= 0)


def _right_of(e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Does a ray to the right from a place cross an edge?"""
    spans = (e[:, 1] > p[:, 1]) != (e[:, 3] > p[:, 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        at = (e[:, 2] - e[:, 0]) * (p[:, 1] - e[:, 1]) / (e[:, 3] - e[:, 1]) + e[:, 0]
    return spans & (p[:, 0] < at)


def _far(e: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Distance of a place to a segment."""
    d = e[:, 2:] - e[:, :2]
    length = (d**2).sum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        t = np.where(length > 0, ((p - e[:, :2]) * d).sum(axis=1) / length, 0.0)
    return np.hypot(*(p - e[:, :2] - np.clip(t, 0.0, 1.0)[:, None] * d).T)


def _compare(a: pa.Array, b: pa.Array, filled: np.ndarray, measured: bool) -> np.ndarray:
    """Distances of pairs, 0 where shapes meet; infinite for others unless `measured`."""
    ea, oa, na = _flat(a)
    eb, ob, nb = _flat(b)
    out = np.full(len(na), np.inf)
    for part in _chunks(na * nb):
        n, m = na[part], nb[part]
        size = n * m
        row = np.repeat(np.arange(len(n)), size)
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        i, j = k // m[row], k % m[row]
        e, f = ea[oa[part][row] + i], eb[ob[part][row] + j]
        count = lambda hit, at, least: np.bincount(at, hit, least)
        together = count(_meet(e, f), row, len(n)) > 0
        # A shape that meets no border lies inside or outside; every corner is asked, so each ring is.
        for rays, local, sizes, counts in ((_right_of(e, f[:, :2]), j, m, None), (_right_of(f, e[:, :2]), i, n, filled[part])):
            first = np.cumsum(sizes) - sizes
            odd = count(rays, first[row] + local, int(sizes.sum())) % 2 == 1
            held = count(odd, np.repeat(np.arange(len(sizes)), sizes), len(sizes)) > 0
            together |= held if counts is None else held & counts
        found = np.where(together, 0.0, np.inf)
        if measured:
            rest = ~together[row]
            gap = np.full(len(row), np.inf)
            u, v = e[rest], f[rest]
            gap[rest] = np.minimum.reduce([_far(v, u[:, :2]), _far(v, u[:, 2:]), _far(u, v[:, :2]), _far(u, v[:, 2:])])
            np.minimum.at(found, row, gap)
        out[part] = found
    return out


def _bools(column: pa.Array) -> np.ndarray:
    return column.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


@F.arrow_udf(BooleanType())
def shapes_meet(a: pa.Array, b: pa.Array) -> pa.Array:
    """Do two polygons share a point? Both may have parts and holes."""
    return pa.array(_compare(a, b, np.ones(len(a), bool), measured=False) == 0)


@F.arrow_udf(DoubleType())
def shape_distance(a: pa.Array, b: pa.Array, b_filled: pa.Array) -> pa.Array:
    """Distance of a polygon to points, lines or a polygon, 0 where they meet.

    `b_filled` tells whether the inside of `b` belongs to it.
    """
    return pa.array(_compare(a, b, _bools(b_filled), measured=True))
