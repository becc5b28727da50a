"""Hard negatives by segment summaries.

A vector is cut into segments of neighbouring components; of each segment its mean and its
deviation are stored. By Cauchy and Schwarz the inner product of two vectors over a segment
of n components lies within n (product of means) plus or minus n (product of deviations), so
a few sums bound a score from both sides. An anchor first meets the coarsest summaries: the
k-th best lower bound is a floor, and rows whose upper bound stays below it go. The rest meet
summaries of finer segments, and what is left in the end is scored exactly.

Rows are dealt to blocks by a hash; a task holds one block at a time and the anchors pass by
in portions, so memory does not depend on the number of rows, anchors or labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelmill.session import stored

#: Numbers of segments, coarse to fine; those that a vector has fewer components than are left out.
LEVELS = (2, 8, 16)
#: Pairs left after a level of which more than this share calls for the whole matrix of scores.
_DENSE = 0.02
#: Sums of products up to here are exact in doubles.
_EXACT = 2**53


def integer_rows(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vec): vectors as integers, floor(scale * x), without the rows that take no part."""
    vec = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    parts = F.col(vector_col)
    fits = F.lit(2.0**62) / F.greatest(F.size(parts), F.lit(1))  # a score then fits a long
    bad = F.exists(parts, lambda x: x.isNull() | F.isnan(x.cast("double")) | ~(F.pow(F.lit(float(scale)) * x.cast("double"), F.lit(2.0)) < fits))
    named = df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & parts.isNotNull()).where(~bad)
    return named.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vec.alias("vec"))


class Block:
    """Vectors of one width with the summaries of their segments."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vecs: np.ndarray) -> None:
        self.ids, self.labels, self.vecs = ids, labels, vecs
        self.exact = vecs.astype(np.float64)
        self.largest = float(np.abs(self.exact).max(initial=0.0))
        width = vecs.shape[1]
        self.levels = []
        for count in (n for n in LEVELS if n < width):
            cuts = np.linspace(0, width, count + 1).astype(int)
            size = np.diff(cuts)
            mean = np.add.reduceat(self.exact, cuts[:-1], axis=1) / size
            square = np.add.reduceat(self.exact**2, cuts[:-1], axis=1) / size
            root = np.sqrt(size)
            self.levels.append((mean * root, np.sqrt(np.maximum(square - mean**2, 0.0)) * root))


def _bounds(a: Block, r: Block, level: int, pairs: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds, of all pairs or of the listed ones, widened by what rounding may cost."""
    (am, ad), (rm, rd) = a.levels[level], r.levels[level]
    if pairs is None:
        mid, spread = am @ rm.T, ad @ rd.T
    else:
        mid = np.einsum("ij,ij->i", am[pairs[0]], rm[pairs[1]])
        spread = np.einsum("ij,ij->i", ad[pairs[0]], rd[pairs[1]])
    slack = 1e-9 * (1.0 + a.largest * r.largest * a.vecs.shape[1])
    return mid - spread - slack, mid + spread + slack


def _scores(a: Block, r: Block, pairs: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Exact integer inner products."""
    small = a.largest * r.largest * max(a.vecs.shape[1], 1) < _EXACT
    av, rv = (a.exact, r.exact) if small else (a.vecs, r.vecs)
    if pairs is None:
        return (av @ rv.T).astype(np.int64)
    out = [np.einsum("ij,ij->i", av[pairs[0][at : at + 65536]], rv[pairs[1][at : at + 65536]]).astype(np.int64) for at in range(0, len(pairs[0]), 65536)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def best_in_windows(a: Block, r: Block, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each row of `a`, its `k` best allowed rows of `r` (and equals of the last) with low <= score <= high: places and scores.

    `allowed` is a matrix of anchors by rows; `low` and `high` have one number per anchor.
    """
    place = np.nonzero(allowed)
    keep_all = True
    for level in range(len(a.levels)):
        under, over = _bounds(a, r, level, None) if keep_all else _bounds(a, r, level, place)
        if keep_all:
            under, over = under[place], over[place]
        # A row that certainly lies in the window and is the k-th best by its lower bound sets a floor.
        sure = (over <= high[place[0]]) & (under >= low[place[0]])
        floor = low.astype(np.float64)
        who, what = place[0][sure], under[sure]
        order = np.lexsort((-what, who))
        who, what = who[order], what[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        kth = rank == k - 1
        floor[who[kth]] = np.maximum(floor[who[kth]], what[kth])
        left = (over >= floor[place[0]]) & (under <= high[place[0]])
        place = (place[0][left], place[1][left])
        keep_all = len(place[0]) > _DENSE * allowed.size
    if keep_all:
        score = _scores(a, r, None)[place]
    else:
        score = _scores(a, r, place)
    good = (score >= low[place[0]]) & (score <= high[place[0]])
    who, what, score = place[0][good], place[1][good], score[good]
    order = np.lexsort((r.ids[what], -score, who))
    who, what, score = who[order], what[order], score[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    who, what, score = who[rank < k], what[rank < k], score[rank < k]
    edges = np.searchsorted(who, np.arange(len(a.ids) + 1))
    return [(what[edges[i] : edges[i + 1]], score[edges[i] : edges[i + 1]]) for i in range(len(a.ids))]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _meet(work: Callable[[Block, np.ndarray, np.ndarray, Block], Iterator[tuple]], portion: int, kinds: list[pa.DataType], names: list[str]) -> Callable:
    """A function for mapInArrow over rows (kind 0) and then anchors (kind 1) of each block, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for batch in batches:
            width, home, kind = (batch.column(n).to_numpy() for n in ("width", "block", "kind"))
            change = np.flatnonzero(np.diff(width) | np.diff(home) | np.diff(kind)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(home)], strict=True):
                if hi <= lo:
                    continue
                if at != (width[lo], home[lo]):
                    at, parts, block = (width[lo], home[lo]), [], None
                rows = batch.slice(lo, hi - lo)
                if kind[lo] == 0:
                    parts.append(rows)
                    continue
                if not parts:
                    continue  # anchors of a block without rows
                if block is None:
                    held = pa.Table.from_batches(parts).combine_chunks()
                    block = Block(held.column("id").to_numpy(), held.column("label").to_numpy(), _matrix(held.column("vec").combine_chunks(), int(width[lo])))
                found: list[tuple] = []
                for start in range(0, hi - lo, portion):
                    some = rows.slice(start, portion)
                    anchors = Block(some.column("id").to_numpy(), some.column("label").to_numpy(), _matrix(some.column("vec"), int(width[lo])))
                    found += work(anchors, some.column("low").to_numpy(), some.column("high").to_numpy(), block)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return run


def _same_label(k: int) -> Callable[[Block, np.ndarray, np.ndarray, Block], Iterator[tuple]]:
    def work(a: Block, low: np.ndarray, high: np.ndarray, r: Block) -> Iterator[tuple]:
        allowed = (a.labels[:, None] == r.labels[None, :]) & (a.ids[:, None] != r.ids[None, :])
        for i, (what, score) in enumerate(best_in_windows(a, r, allowed, low, high, k)):
            yield from ((int(a.ids[i]), int(a.labels[i]), int(r.ids[j]), int(s)) for j, s in zip(what, score, strict=True))

    return work


def _other_label(k: int) -> Callable[[Block, np.ndarray, np.ndarray, Block], Iterator[tuple]]:
    def work(a: Block, low: np.ndarray, high: np.ndarray, r: Block) -> Iterator[tuple]:
        allowed = a.labels[:, None] != r.labels[None, :]
        for i, (what, score) in enumerate(best_in_windows(a, r, allowed, low, high, k)):
            yield from ((int(a.ids[i]), int(a.labels[i]), int(low[i]), int(high[i]), int(r.ids[j]), int(s)) for j, s in zip(what, score, strict=True))

    return work


def mine(
    df: DataFrame, is_anchor: str, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 5, low_percent: int = 80, high_percent: int = 100, scale: int = 256, block_rows: int = 4096, portion: int = 128,
) -> DataFrame:
    """Hard negatives of each anchor and each of its positives.

    Components become floor(scale * x); a score is an integer inner product; higher scores come
    first, ties by smaller id. An anchor's positives are its first `positives` other rows of the
    same label. A positive's negatives are the first `negatives` rows of another label with
    low_percent * positive_score <= 100 * negative_score <= high_percent * positive_score; a
    positive without any gives no row. Returns anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score. `is_anchor` is an SQL condition on the id, named ``id``.

    Rows with a null id, label or vector, or with a component that is null, not finite or so
    large that a score could leave 63 bits, take no part; zero and empty vectors do. Vectors are
    compared with those of their own width. Rows that repeat id, label and vector count once;
    rows that share an id but differ otherwise are all searched, the positives and negatives of
    such anchors are ranked together, and none of them is a positive of another one of that id.
    Other columns are left aside, so their names can't clash; an empty table gives an empty result.
    """
    keyed = integer_rows(df, id_col, vector_col, label_col, scale).groupBy("id", "label", "vec").agg(F.count("*").alias("copies")).drop("copies")
    rows = stored(keyed.withColumn("width", F.size("vec")), "vectors")
    blocks = max(1, -(-rows.count() // block_rows))
    none, kind = F.lit(None).cast("long"), lambda n: F.lit(n).alias("kind")
    held = rows.select("width", F.pmod(F.xxhash64("id", "label", "vec"), F.lit(blocks)).cast("int").alias("block"), kind(0), "id", "label", "vec", none.alias("low"), none.alias("high"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    shape = "anchor_id long, label long, "

    def met(anchors: DataFrame, work: Callable, columns: str) -> DataFrame:
        sent = anchors.select("width", everywhere, kind(1), "id", "label", "vec", "low", "high")
        names = [c.split()[0] for c in columns.split(", ")]
        dealt = held.unionByName(sent).repartition("width", "block").sortWithinPartitions("width", "block", "kind", "id")
        return dealt.mapInArrow(_meet(work, portion, [pa.int64()] * len(names), names), columns)

    anchors = rows.where(F.expr(is_anchor))
    widest = [F.lit(-(2**62)).alias("low"), F.lit(2**62).alias("high")]
    near = met(anchors.select("*", *widest), _same_label(positives), shape + "positive_id long, positive_score long")
    first = Window.partitionBy("anchor_id", "label").orderBy(F.desc("positive_score"), "positive_id")
    chosen = stored(near.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= positives).drop("place"), "positives")
    # Positives of one score share their negatives. The window is narrowed to whole scores.
    score = F.col("positive_score")
    windows = chosen.select(
        F.col("anchor_id").alias("id"), "label",
        F.expr(f"CAST(-floor(-CAST({low_percent} AS decimal(38,0)) * positive_score / 100) AS long)").alias("low"),
        F.expr(f"CAST(floor(CAST({high_percent} AS decimal(38,0)) * positive_score / 100) AS long)").alias("high"), score,
    ).distinct()
    asked = anchors.join(windows, ["id", "label"]).where("low <= high")
    far = met(asked, _other_label(negatives), shape + "low long, high long, negative_id long, negative_score long")
    best = Window.partitionBy("anchor_id", "label", "low", "high").orderBy(F.desc("negative_score"), "negative_id")
    ranked = far.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    back = chosen.join(windows.select(F.col("id").alias("anchor_id"), "label", score, "low", "high"), ["anchor_id", "label", "positive_score"])
    return back.join(ranked, ["anchor_id", "label", "low", "high"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score",
    )


def noisy_labels(df: DataFrame) -> DataFrame:
    """The rows with the labels of ids divisible by 7 moved on by one, among ten."""
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return df.select("vec_id", "embedding", moved.alias("label"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth embedding among all of them."""
    return mine(noisy_labels(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "id % 100 = 0")


OP12_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
        CAST(list_inner_product(a.vec, r.vec) AS BIGINT) AS score
    FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY rank <= 5
"""
