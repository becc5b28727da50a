"""Large shapes cut into small pieces.

A polygon with very many corners is halved again and again, by upright and level lines
between its corners, until each piece has few corners. Pieces share nothing but their cut
lines and cover the polygon exactly, so whatever holds for some piece (a point inside, a
meeting, a nearest distance) or adds up over pieces (an area) can be asked of pieces, whose
size is bounded. Pieces are polygons in rows of their own: no later step sees a large one.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from parcelmill.session import stored

c = F.col
MAX_CORNERS = 64
#: Polygons that one task cuts, and corners of pieces held at a time.
CUT_ROWS = 20_000
_CORNERS_AT_ONCE = 200_000
#: Columns of a cut table: hash of the whole shape, and number of the piece.
WHOLE, PIECE = "__whole", "__piece"


def _cut_at(values: np.ndarray) -> float | None:
    """A place between two corners, near the middle one."""
    places = np.unique(values)
    if len(places) < 2:
        return None
    i = min(max(int(np.searchsorted(places, np.median(values))), 1), len(places) - 1)
    at = (places[i - 1] + places[i]) / 2
    return float(at) if places[i - 1] < at < places[i] else None


def halves(edges: np.ndarray, axis: int, at: float) -> tuple[np.ndarray, np.ndarray]:
    """Both sides of a polygon at a line that no corner lies on, closed along the line."""
    a, b = edges[:, axis], edges[:, axis + 2]
    below, above = np.maximum(a, b) < at, np.minimum(a, b) > at
    cut = edges[~below & ~above]
    p, q = cut[:, axis], cut[:, axis + 2]
    u, v = cut[:, 1 - axis], cut[:, 3 - axis]
    cross = np.clip(u + (at - p) / (q - p) * (v - u), np.minimum(u, v), np.maximum(u, v))
    spot = np.empty((len(cut), 2))
    spot[:, axis], spot[:, 1 - axis] = at, cross
    leaves = p < at  # from below to above
    first, last = np.concatenate([cut[:, :2], spot], axis=1), np.concatenate([spot, cut[:, 2:]], axis=1)
    # Along the line the inside lies between the first and the second crossing, the third and the fourth, and so on.
    order = np.argsort(cross, kind="stable")
    i, j = order[0::2], order[1::2]
    out = np.where(leaves[i], i, j)  # where the polygon leaves the lower side
    back = np.where(leaves[i], j, i)
    low = np.concatenate([edges[below], first[leaves], last[~leaves], np.concatenate([spot[out], spot[back]], axis=1)])
    high = np.concatenate([edges[above], last[leaves], first[~leaves], np.concatenate([spot[back], spot[out]], axis=1)])
    return low, high


def _rings(edges: np.ndarray) -> list[list[tuple[float, float]]]:
    """Closed rings that use each edge once, along its direction where that is possible."""
    ends = [((ax, ay), (bx, by)) for ax, ay, bx, by in edges.tolist() if (ax, ay) != (bx, by)]
    starting, ending = defaultdict(list), defaultdict(list)
    for n, (a, b) in enumerate(ends):
        starting[a].append(n)
        ending[b].append(n)
    used, rings = bytearray(len(ends)), []

    def take(candidates: list[int]) -> int | None:
        while candidates:
            n = candidates.pop()
            if not used[n]:
                used[n] = 1
                return n
        return None

    for n, (a, b) in enumerate(ends):
        if used[n]:
            continue
        used[n] = 1
        ring, at = [a], b
        while at != a:
            ring.append(at)
            if (m := take(starting[at])) is not None:
                at = ends[m][1]
            elif (m := take(ending[at])) is not None:
                at = ends[m][0]
            else:
                break
        rings.append([*ring, a])
    return rings


def cut_polygon(edges: np.ndarray, corners: int) -> Iterator[list[list[tuple[float, float]]]]:
    """Pieces of a polygon, given as edges (ax, ay, bx, by) of closed rings, of at most `corners` edges.

    A piece is larger only where no cut makes it smaller.
    """
    todo = [edges]
    while todo:
        now = todo.pop()
        best = None
        if len(now) > corners:
            for axis in (0, 1):
                at = _cut_at(now[:, [axis, axis + 2]].ravel())
                if at is not None:
                    both = halves(now, axis, at)
                    size = max(map(len, both))
                    if size < len(now) and (best is None or size < best[0]):
                        best = size, both
        if best is None:
            if rings := _rings(now):
                yield rings
        else:
            todo += best[1]


def corner_count(rings: Column) -> Column:
    return F.aggregate(rings, F.lit(0), lambda n, r: n + F.size(r))


def subdivide(df: DataFrame, rings: str = "rings", corners: int = MAX_CORNERS, only: Column | None = None) -> tuple[DataFrame, bool]:
    """The table with large polygons cut into pieces, one row each, and whether any was.

    Other columns are repeated, and `__whole` (hash of the shape) and `__piece` tell pieces
    apart. Polygons are dealt to tasks by rows, not by the bytes of their file, and cut once: the
    result is stored, as every caller reads it several times. Where no polygon has more than
    `corners` corners the table is returned as it is. `only` limits cutting to the rows it holds
    for, the rest stay whole.
    """
    large = corner_count(c(rings)) > corners
    if only is not None:
        large = large & only
    large = F.coalesce(large, F.lit(False))
    many = df.where(large).count()
    if many == 0:
        return df, False
    # Read from a file, shapes are not made anew for each of the expressions below.
    named = stored(df, "shapes").withColumns({WHOLE: F.xxhash64(rings), PIECE: F.lit(0)})
    shape = StructType([*df.schema.fields, StructField(WHOLE, LongType()), StructField(PIECE, IntegerType())])
    at = df.columns.index(rings)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(at)
            ring_at, point_at = paths.offsets.to_numpy(), paths.values.offsets.to_numpy()
            place = paths.values.values
            p = np.stack([place.field(i).to_numpy(zero_copy_only=False) for i in ("x", "y")], axis=1).astype(float)
            edges = np.concatenate([p[:-1], p[1:]], axis=1)
            inner = np.ones(len(edges), bool)  # not from one ring to the next
            ends = point_at[(point_at > 0) & (point_at < len(p))] - 1
            inner[ends] = False
            rows, pieces, held = [], [], 0
            for row in range(batch.num_rows):
                first, last = point_at[ring_at[row]], point_at[ring_at[row + 1]] - 1
                own = list(cut_polygon(edges[first:last][inner[first:last]], corners))
                rows += [(row, n) for n in range(len(own))]
                pieces += own
                held += sum(len(r) for piece in own for r in piece)
                if held >= _CORNERS_AT_ONCE:
                    yield assembled(batch, rows, pieces)
                    rows, pieces, held = [], [], 0
            if rows:
                yield assembled(batch, rows, pieces)

    def assembled(batch: pa.RecordBatch, rows: list[tuple[int, int]], pieces: list) -> pa.RecordBatch:
        points = np.array([q for piece in pieces for r in piece for q in r], float).reshape(-1, 2)
        corner = pa.StructArray.from_arrays([pa.array(points[:, i]) for i in (0, 1)], ["x", "y"])
        ring_ends = np.cumsum([0, *(len(r) for piece in pieces for r in piece)])
        piece_ends = np.cumsum([0, *map(len, pieces)])
        lists = pa.ListArray.from_arrays(pa.array(piece_ends, pa.int32()), pa.ListArray.from_arrays(pa.array(ring_ends, pa.int32()), corner))
        of = pa.array([row for row, _ in rows], pa.int64())
        others = [batch.column(i).take(of) if i != at else lists for i in range(batch.num_columns - 1)]
        return pa.RecordBatch.from_arrays([*others, pa.array([n for _, n in rows], pa.int32())], batch.schema.names)

    tasks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(many / CUT_ROWS))
    pieces = named.where(large).repartition(tasks, F.xxhash64(*df.columns)).mapInArrow(cut, shape)
    return stored(named.where(~large).unionByName(pieces), "pieces"), True


def path_chunks(rings: Column, corners: int = MAX_CORNERS) -> Column:
    """Long paths as several shapes of one short path each: an array of `rings`.

    Neighbouring chunks share a corner, so the lines cover the same places.
    """
    chunks = lambda r: F.transform(F.sequence(F.lit(1), F.greatest(F.size(r) - 1, F.lit(1)), F.lit(corners)), lambda i: F.array(F.slice(r, i, F.lit(corners + 1))))
    return F.flatten(F.transform(rings, chunks))
