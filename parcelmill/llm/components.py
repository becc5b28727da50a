"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelmill.session import stored


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as one star per component, around its smallest node."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = [x for x in parent if root(x) != x]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([root(x) for x in part], pa.int64())], ["a", "b"])


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large star: larger neighbours move to the smallest one. Small star: smaller ones do."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both if large else both.where("b < a")
    least = near.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
    moved = near.join(least, "a").where(F.col("b") > F.col("a") if large else F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
    if not large:
        moved = moved.unionByName(least.select("a", F.col("low").alias("b")))
    return moved.where("a <> b").distinct()


def components(edges: DataFrame, edges_per_task: int = 2_000_000) -> DataFrame:
    """(node, root): each node that is not the smallest of its component, and the smallest.

    `edges` has the columns a and b. Tasks first contract the edges they hold, at most about
    `edges_per_task` each, which is all when one task holds them. Otherwise large-star and
    small-star steps alternate with contraction until nothing moves.
    """
    now = stored(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b"), "edges")
    while True:
        count = now.count()
        tasks = max(1, -(-count // edges_per_task))
        held = now.repartition(tasks) if tasks > 1 else now.repartition(1)
        stars = stored(held.mapInArrow(_contract, "a long, b long"), "stars")
        if tasks == 1:
            break
        moved = stored(_star(_star(stars, large=True), large=False), "moved")
        state = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state(moved) == state(now):
            stars = moved
            break
        now = moved
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root"))
