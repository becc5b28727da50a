"""Approximate nearest neighbours by cross-polytope hashing.

A vector is turned by a pseudo-rotation (three rounds of random signs and a fast
Hadamard transform) and hashed to the signed axis it lies nearest to. Several
tables with rotations of their own, each probed at the axes next in line, collect
candidates; candidates are ranked by their exact inner product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelmill.session import stored

_ROUNDS = 3
#: Norms of one band differ by this factor at most; each band has tables of its own.
_BAND_BASE = 2.0


def hadamard(x: np.ndarray) -> np.ndarray:
    """Orthonormal Walsh-Hadamard transform of each row; the width is a power of two."""
    rows, width = x.shape
    step = 1
    while step < width:
        pairs = x.reshape(rows, width // (2 * step), 2, step)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(rows, width)
        step *= 2
    return x / math.sqrt(width)


def rotations(width: int, tables: int, hashes: int, seed: int) -> np.ndarray:
    """Random signs, one set per table, hash and round."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, hashes, _ROUNDS, width))


def ranked_axes(x: np.ndarray, signs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The `depth` nearest signed axes of each row, nearest first, and their coordinates."""
    for one in signs:
        x = hadamard(x * one)
    both = np.concatenate([x, -x], axis=1)
    depth = min(depth, both.shape[1])
    best = np.argsort(-both, axis=1, kind="stable")[:, :depth]
    return best, np.take_along_axis(both, best, axis=1)


def cells(x: np.ndarray, signs: np.ndarray, depth: int) -> np.ndarray:
    """Cell numbers per row, nearest first: signed axes of all hashes of a table combined."""
    axes, score = ranked_axes(x, signs[0], depth)
    width = 2 * x.shape[1]
    for one in signs[1:]:
        more, gain = ranked_axes(x, one, depth)
        total = (score[:, :, None] + gain[:, None, :]).reshape(len(x), -1)
        both = (axes[:, :, None] * width + more[:, None, :]).reshape(len(x), -1)
        best = np.argsort(-total, axis=1, kind="stable")[:, :depth]
        axes, score = np.take_along_axis(both, best, axis=1), np.take_along_axis(total, best, axis=1)
    return axes


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = len(column)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vec): vectors without null, NaN or infinite parts, not zero, of the commonest width."""
    vec = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = (
        df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"))
        .where(F.col("id").isNotNull() & F.col("vec").isNotNull())
        .where(~bad & F.exists("vec", lambda x: x != 0))
    )
    width = rows.groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    return rows.where(F.size("vec") == (width["w"] if width else 0))


def search(
    df: DataFrame,
    is_query: str,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    tables: int = 10,
    probes: int = 12,
    hashes: int | None = None,
    block_rows: int = 4096,
    seed: int = 20,
) -> DataFrame:
    """The `k` rows with the largest inner product for each row that fulfils `is_query`.

    Returns query_id, rank (from 1), vec_id, score; ties go to the smaller id. A row
    is never its own neighbour. `is_query` is an SQL condition on the id, named ``id``.

    Equal vectors are searched once and stand for their k + 1 smallest ids, which no
    answer can exceed, so a vector repeated a million times costs as much as one. Cells
    are cut into blocks of `block_rows`, so that a crowded cell is spread over tasks.
    Norms may differ: vectors are hashed in bands of norm, lifted to unit length by one
    more coordinate where norms differ inside a band. `hashes` signed axes make up a
    cell; None takes 1 whatever the size, as more of them lower the recall.

    Nulls, zero vectors, vectors with non-finite parts and vectors of another width than the
    commonest take no part. A query has `k` rows, or all others where there are fewer: one
    whose probes meet fewer goes on through all cells of a table. Repeated ids count once per
    vector; an empty table gives an empty result.
    """
    rows = stored(usable_vectors(df, id_col, vector_col).distinct(), "vectors")
    first = rows.first()
    out = "query_id long, rank int, vec_id long, score double"
    if first is None:
        return df.sparkSession.createDataFrame([], out)

    # One row per distinct vector, with its k + 1 smallest ids.
    near = Window.partitionBy("vec").orderBy("id")
    spots = (
        rows.withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1)
        .groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("gid", F.col("ids")[0])
    )
    asked = rows.where(F.expr(is_query)).select("vec", F.col("id").alias("query_id"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x))
    spots = stored(
        spots.join(asked.select("vec").distinct().withColumn("asked", F.lit(True)), "vec", "left")
        .withColumn("norm", norm).withColumn("band", F.round(F.log2("norm") / math.log2(_BAND_BASE)).cast("int")),
        "spots",
    )
    # One row per band of norms: at most some two thousand, whatever the table holds.
    bands = {r["band"]: (r["lo"], r["hi"]) for r in spots.groupBy("band").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).collect()}
    flat = all(hi - lo <= 1e-3 * hi for lo, hi in bands.values())
    width = 1 << max(0, (len(first["vec"]) + (0 if flat else 1) - 1)).bit_length()
    if hashes is None:
        hashes = 1
    depth = probes**hashes
    signs = rotations(width, tables, hashes, seed)

    def lifted(vec: np.ndarray, top: np.ndarray | None) -> np.ndarray:
        length = np.sqrt((vec * vec).sum(axis=1))
        wide = np.zeros((len(vec), width))
        unit = length if top is None or flat else top
        wide[:, : vec.shape[1]] = vec / unit[:, None]
        if top is not None and not flat:
            wide[:, vec.shape[1]] = np.sqrt(np.maximum(0.0, 1.0 - (length / top) ** 2))
        return wide

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            top = np.array([bands[b][1] for b in batch.column("band").to_pylist()])
            wide = lifted(_matrix(batch.column("vec")), top)
            codes = np.stack([cells(wide, one, 1)[:, 0] for one in signs], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("gid"), batch.column("band"), batch.column("vec"), pa.array(list(codes), pa.list_(pa.int64()))],
                ["gid", "band", "vec", "cells"],
            )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = lifted(_matrix(batch.column("vec")), None)
            wanted = np.stack([cells(wide, one, depth) for one in signs], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("gid"), batch.column("vec"), pa.array([list(x) for x in wanted], pa.list_(pa.list_(pa.int64())))],
                ["gid", "vec", "wanted"],
            )

    # Vectors are turned once; each step below takes them apart into cells anew.
    turned = stored(spots.select("gid", "band", "vec").mapInArrow(place, "gid long, band int, vec array<double>, cells array<long>"), "turned")
    placed = turned.select("gid", "band", "vec", F.posexplode("cells").alias("tab", "cell"))
    asking = stored(spots.where("asked").select("gid", "vec").mapInArrow(probe, "gid long, vec array<double>, wanted array<array<long>>"), "asking")
    wanted = (
        asking.select(F.col("gid").alias("qid"), F.col("vec").alias("qvec"), F.posexplode("wanted").alias("tab", "axes"))
        .select("qid", "qvec", "tab", F.posexplode("axes").alias("turn", "cell"))
        .withColumn("band", F.explode(F.array(*[F.lit(b) for b in bands])))
    )
    keys = ["band", "tab", "cell"]
    size = placed.groupBy(keys).agg(F.ceil(F.count("*") / block_rows).alias("row_blocks"))
    load = wanted.groupBy(keys).agg(F.ceil(F.count("*") / block_rows).alias("query_blocks"))
    # One row per cell, tables x cells x bands of them.
    blocks = stored(size.join(load, keys), "blocks")
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    left = wanted.join(blocks, keys).withColumn("qb", part("qid", "query_blocks")).withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)))
    right = placed.join(blocks, keys).withColumn("rb", part("gid", "row_blocks")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)))
    group = [*keys, "rb", "qb"]

    def rank(a: pa.Table, b: pa.Table) -> pa.Table:
        qid, gid, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if a.num_rows and b.num_rows:
            q, v = _matrix(a.column("qvec")), _matrix(b.column("vec"))
            floor = a.column("floor").to_numpy()
            names, found = a.column("qid").to_numpy(), b.column("gid").to_numpy()
            order = np.argsort(found, kind="stable")
            found, v = found[order], v[order]
            for at in range(0, len(q), 512):
                part = q[at : at + 512]
                near_to = part @ v.T
                # The product above only selects, with room for rounding; the sums below are the scores.
                least = floor[at : at + 512] - 1e-9 * np.abs(floor[at : at + 512])
                if near_to.shape[1] > k + 1:
                    cut = np.partition(near_to, -(k + 1), axis=1)[:, -(k + 1)]
                    least = np.maximum(least, cut - 1e-9 * np.abs(cut))
                i, j = np.nonzero(near_to >= least[:, None])
                exact = (part[i] * v[j]).sum(axis=1)
                qid.append(names[at + i])
                gid.append(found[j])
                score.append(exact)
        return pa.table({"qid": np.concatenate(qid), "gid": np.concatenate(gid), "score": np.concatenate(score)})

    best = Window.partitionBy("qid").orderBy(F.desc("score"), "gid")

    def scored(queries: DataFrame, rows: DataFrame = right) -> DataFrame:
        a = queries.select(*group, "qid", "qvec", "floor").groupBy(group)
        b = rows.select(*group, "gid", "vec").groupBy(group)
        return a.cogroup(b).applyInArrow(rank, "qid long, gid long, score double")

    def top(found: DataFrame) -> DataFrame:
        return found.dropDuplicates(["qid", "gid"]).withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)

    # The nearest cell of each table first; its k + 1 best bound what the other cells must beat.
    start = stored(top(scored(left.where("turn = 0").withColumn("floor", F.lit(float("-inf"))))), "first_probe")
    floor = start.groupBy("qid").agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("-inf")).alias("floor"))
    rest = scored(left.where("turn > 0").join(floor, "qid", "left").na.fill(float("-inf"), ["floor"]))
    found = stored(top(start.select("qid", "gid", "score").unionByName(rest)), "found")

    # A query whose probes met fewer than `k` others goes on through every cell of one table, which is all rows.
    names = spots.select("gid", "ids")
    reached = found.join(names, "gid").groupBy("qid").agg(F.sum(F.size("ids")).alias("reached"))
    short = asking.select(F.col("gid").alias("qid"), F.col("vec").alias("qvec")).join(reached, "qid", "left")
    short = stored(short.where(F.coalesce("reached", F.lit(0)) <= k).drop("reached"), "short")
    if count := short.count():
        parts = F.lit(max(1, -(-count // block_rows)))
        every = stored(size.where("tab = 0"), "every_cell")  # two cells per dimension and band
        asked_all = short.withColumns({"tab": F.lit(0), "qb": F.pmod(F.xxhash64("qid"), parts), "floor": F.lit(float("-inf"))}).join(F.broadcast(every), "tab")
        asked_all = asked_all.withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)))
        held = placed.join(F.broadcast(every), keys).withColumn("rb", part("gid", "row_blocks")).withColumn("qb", F.explode(F.sequence(F.lit(0), parts - 1)))
        found = top(found.select("qid", "gid", "score").unionByName(scored(asked_all, held)))
    asked_at = asked.join(spots.where("asked").select("vec", F.col("gid").alias("qid")), "vec").select("query_id", "qid")
    expanded = (
        found.select("qid", "gid", "score").join(names, "gid").select("qid", "score", F.explode("ids").alias("vec_id"))
        .withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    )
    final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        asked_at.join(expanded, "qid").where(F.col("query_id") != F.col("vec_id"))
        .withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def recall(found: DataFrame, truth: DataFrame) -> float:
    """Share of the true neighbours (query_id, vec_id) that were found."""
    hit = truth.join(found.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_semi").count()
    return hit / max(1, truth.count())


def op1_cross_polytope_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest rows of `embeddings` for each row whose id is divisible by 20."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 20 = 0")
