"""Near duplicates by MinHash and an LSH forest.

A document is its set of word shingles. Documents of equal sets are one node. Each node's
signature is put into several sorted orders, each beginning with other signature values;
nodes that stand close in an order and share a prefix are candidates. In a sparse region all
nodes of a prefix are compared; in a crowded one only the nearest in order, which share the
longest prefixes. Candidates are confirmed on their full sets, and links make components.
Nodes of crowded regions are then walked again, much further, for partners that are still in
other components, and in the end joined exactly on their rarest shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmill.llm.components import components
from parcelmill.llm.words import slices
from parcelmill.session import settings, stored

_VALUES = 128
_TREES = 16
_START = 2  # values that candidates share at least
_DEPTH = 10  # values of an order's key
_MARK_BITS = 1 << 24
_RARITY_BITS = 18
_PART_ROWS = 4096
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text.

    Words are what ASCII white space separates, with A-Z in lower case. A text of fewer than
    `width` words has its whole sequence as one shingle, a text without words none.
    """
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(texts)))
    coded = split.flatten().dictionary_encode()
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    words = hashes[coded.indices.to_numpy()] if len(hashes) else np.zeros(0, np.uint64)
    blank = np.uint64(xxhash.xxh64_intdigest(""))
    edges = split.offsets.to_numpy() - split.offsets[0].as_py()
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        own = words[low:high]
        if not len(own) or (len(own) == 1 and own[0] == blank):
            yield np.zeros(0, np.uint64)
            continue
        size = min(width, len(own))
        rolled = np.zeros(len(own) - size + 1, np.uint64)
        for i in range(size):
            rolled = rolled * _PRIME + own[i : len(own) - size + 1 + i]
        yield np.unique(_mix(rolled + np.uint64(size)))


def _factors() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(9)
    return rng.integers(1, 1 << 63, _VALUES, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, _VALUES, dtype=np.uint64)


def signature(shingles: np.ndarray, factors: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """16 bits of the smallest value of each hash function."""
    low = np.full(_VALUES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        low = np.minimum(low, (part[:, None] * factors[0] + factors[1]).min(axis=0))
    return (_mix(low) & np.uint64(0xFFFF)).astype(">u2")


def orders() -> np.ndarray:
    """Which signature values make up the key of each tree; no two trees begin with the same ones."""
    rng = np.random.default_rng(11)
    first = rng.permutation(_VALUES)[: _TREES * _START].reshape(_TREES, _START)
    return np.stack([np.append(own, rng.permutation(np.setdiff1d(np.arange(_VALUES), own))[: _DEPTH - _START]) for own in first])


def _signatures(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    factors = _factors()
    for whole in batches:
        for low, high in slices(whole.column("text"), 8_000_000):
            batch = whole.slice(low, high - low)
            sizes, one, two, signs = [], [], [], []
            for own in shingle_sets(batch.column("text"), width):
                sizes.append(len(own))
                one.append(int(np.add.reduce(own)))
                two.append(int(np.bitwise_xor.reduce(_mix(own + _PRIME))) if len(own) else 0)
                signs.append(signature(own, factors).tobytes() if len(own) else b"")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(np.array(one, np.uint64).view(np.int64)), pa.array(np.array(two, np.uint64).view(np.int64)), pa.array(signs, pa.binary())],
                ["doc_id", "n", "h1", "h2", "signs"],
            )


def _keys(batches: Iterator[pa.RecordBatch], trees: int) -> Iterator[pa.RecordBatch]:
    """Each node once per tree, with the tree's key and a sketch of four bits per value."""
    order = orders()[:trees]
    for batch in batches:
        if not batch.num_rows:
            continue
        signs = np.frombuffer(b"".join(batch.column("signs").to_pylist()), ">u2").reshape(-1, _VALUES)
        small = (signs & 15).astype(np.uint8)
        sketch = (small[:, ::2] << 4 | small[:, 1::2])
        sketches = [s.tobytes() for s in sketch]
        more = [batch.column("items")] if "items" in batch.schema.names else []
        for tree, own in enumerate(order):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(signs), tree, np.int32)), pa.array([k.tobytes() for k in np.ascontiguousarray(signs[:, own])], pa.binary()),
                    batch.column("node"), batch.column("n"), batch.column("root"), pa.array(sketches, pa.binary()), *more,
                ],
                ["tree", "key", "node", "n", "root", "sketch", "items"][: 6 + len(more)],
            )


_EQUAL = np.array([int(x >> 4 == 0) + int((x & 15) == 0) for x in range(256)], np.uint8)


def _close(rows: list[np.ndarray], fresh: int, crowd: int, reach: int, share: float, least: float, apart: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places i < j of close rows of a sorted stretch, their estimated likeness, and the nodes of crowded regions.

    j is not before `fresh`. With `apart` only rows of different roots count.
    """
    head, node, n, root, sketch = rows
    start = np.flatnonzero(np.append(True, (head[1:] != head[:-1]).any(axis=1)))
    run = np.diff(np.append(start, len(head)))
    size = np.repeat(run, run)
    first, second, likely = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for step in range(1, min(crowd, len(head) - 1) + 1):
        at = np.arange(max(0, fresh - step), len(head) - step)
        at = at[(size[at + step] <= crowd) | (step <= reach)]
        if apart:
            at = at[root[at] != root[at + step]]
        at = at[(head[at] == head[at + step]).all(axis=1)]
        if not len(at):
            continue
        small, large = np.minimum(n[at], n[at + step]), np.maximum(n[at], n[at + step])
        at = at[small >= share * large]
        match = _EQUAL[sketch[at] ^ sketch[at + step]].sum(axis=1, dtype=np.int64) / _VALUES
        guess = (match - 1 / 16) / (15 / 16)
        good = (guess >= least) & (node[at] != node[at + step])
        first.append(at[good])
        second.append(at[good] + step)
        likely.append(guess[good])
    return np.concatenate(first), np.concatenate(second), np.concatenate(likely), np.unique(node[fresh:][size[fresh:] > crowd])


def _stretches(batches: Iterator[pa.RecordBatch], overlap: int, extra: bool) -> Iterator[tuple[list[np.ndarray], int]]:
    """Sorted rows (tree, key, node, n, root, sketch[, items]) in stretches that overlap, and where the new rows of each begin."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.frombuffer(b"".join(batch.column("key").to_pylist()), ">u2").reshape(-1, _DEPTH)[:, :_START].astype(np.int32)
        head = np.concatenate([batch.column("tree").to_numpy()[:, None], key], axis=1)
        sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, _VALUES // 2)
        rows = [head, *[batch.column(c).to_numpy() for c in ("node", "n", "root")], sketch]
        if extra:
            items = np.empty(batch.num_rows, object)
            items[:] = [np.frombuffer(x, np.uint64) for x in batch.column("items").to_pylist()]
            rows.append(items)
        before = 0 if held is None else len(held[0])
        if held is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(held, rows, strict=True)]
        yield rows, before
        held = [x[-overlap:] for x in rows]


def _same(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= percent * (len(one) + len(two) - both)


def _ordered(nodes: DataFrame, trees: int) -> DataFrame:
    """Each node once per tree, in ranges of the full order.

    A crowded prefix is spread over as many tasks as its rows fill.
    """
    schema = "tree int, key binary, node long, n long, root long, sketch binary" + (", items binary" if "items" in nodes.columns else "")
    return nodes.mapInArrow(lambda b: _keys(b, trees), schema).repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")


def candidates(nodes: DataFrame, share: float, crowd: int, reach: int, least: float) -> DataFrame:
    """(a, b, guess): pairs of nodes (node, n, signs, root) that stand close in some tree.

    Each node of a crowded region also comes out paired with itself.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, fresh in _stretches(batches, 2 * crowd, False):
            i, j, guess, crowded = _close(rows, fresh, crowd, reach, share, least, False)
            a, b = np.append(rows[1][i], crowded), np.append(rows[1][j], crowded)
            guess = np.append(guess, np.ones(len(crowded))).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(guess)], ["a", "b", "guess"])

    return _ordered(nodes, _TREES).mapInArrow(run, "a long, b long, guess float").groupBy("a", "b").agg(F.max("guess").alias("guess"))


def far_links(nodes: DataFrame, percent: int, crowd: int, reach: int, least: float, trees: int) -> DataFrame:
    """(a, b): linked pairs of nodes (node, n, signs, root, items) of different roots, looked for far along some trees.

    Pairs are confirmed where they meet; roots that a task has linked already are not tried again.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def top(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x

        for rows, fresh in _stretches(batches, 2 * crowd, True):
            i, j, guess, _ = _close(rows[:5], fresh, crowd, reach, percent / 100, least, True)
            linked = []
            for x, y in zip(*[k[np.argsort(-guess, kind="stable")].tolist() for k in (i, j)], strict=True):
                one, two = top(int(rows[3][x])), top(int(rows[3][y]))
                if one != two and _same(rows[5][x], rows[5][y], percent):
                    parent[max(one, two)] = min(one, two)
                    linked.append((int(rows[1][x]), int(rows[1][y])))
            columns = list(zip(*linked, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b"])

    return _ordered(nodes, trees).mapInArrow(run, "a long, b long").distinct()


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high in slices(whole.column("text"), 8_000_000):
                batch = whole.slice(low, high - low)
                own = [x.tobytes() for x in shingle_sets(batch.column("text"), width)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.binary())], ["node", "items"])

    # A bit map of the wanted ids, of at most _MARK_BITS / 64 rows, keeps most other texts out of the join.
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(_MARK_BITS))
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), slot(c).bitwiseAND(63).cast("int"))
    marks = wanted.groupBy(F.floor(slot("node") / 64).alias("word")).agg(F.bit_or(bit("node")).alias("bits"))
    near = docs.withColumn("word", F.floor(slot("doc_id") / 64)).join(F.broadcast(marks), "word").where(F.col("bits").bitwiseAND(bit("doc_id")) != 0)
    # An inner join, as a semi join would be moved below the filter; `wanted` is distinct.
    return near.select("doc_id", "text").join(wanted.select(F.col("node").alias("doc_id")), "doc_id").select("doc_id", "text").mapInArrow(run, "node long, items binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have a Jaccard likeness of `percent` / 100 at least."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            good = []
            for i in range(batch.num_rows):
                good.append(_same(np.frombuffer(x[i].as_buffer(), np.uint64), np.frombuffer(y[i].as_buffer(), np.uint64), percent))
            mask = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    joined = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
    joined = joined.join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long").distinct()


def _slots(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(64 - _RARITY_BITS)).astype(np.int64)


def _rarity(nodes: DataFrame) -> np.ndarray:
    """How many shingles of all nodes fall into each slot of the hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << _RARITY_BITS, np.int64)
        for batch in batches:
            for items in batch.column("items"):
                np.add.at(count, _slots(np.frombuffer(items.as_buffer(), np.uint64)), 1)
        slot = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(count[slot])], ["slot", "n"])

    rows = nodes.select("items").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(1 << _RARITY_BITS, np.int64)
    total[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return total


def _rare_shingles(nodes: DataFrame, percent: int) -> DataFrame:
    """(shingle, place, node, n, root): of each node the shingles among which its first common one with a partner must be.

    All nodes order their shingles alike, those of rare slots first.
    """
    rarity = _rarity(nodes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            parts = []
            for items in batch.column("items"):
                own = np.frombuffer(items.as_buffer(), np.uint64)
                parts.append(own[np.lexsort((own, rarity[_slots(own)]))[: len(own) + 1 + -percent * len(own) // 100]])
            size = [len(x) for x in parts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(parts).view(np.int64)), pa.array(np.concatenate([np.arange(x, dtype=np.int32) for x in size])),
                    *[pa.array(np.repeat(batch.column(c).to_numpy(), size)) for c in ("node", "n", "root")],
                ],
                ["shingle", "place", "node", "n", "root"],
            )

    return nodes.select("node", "n", "root", "items").mapInArrow(run, "shingle long, place int, node long, n long, root long")


def exact_pairs(nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b, guess): all pairs of nodes (node, n, root, items) of different roots that may reach `percent`; guess counts rare shingles in common.

    A prefix-filter join. The first common shingle of a linked pair leaves enough shingles
    behind it in both sets. Shingles of one root alone are dropped before the join, and the
    rows of a frequent one are cut into parts.
    """
    rows = stored(_rare_shingles(nodes, percent), "rare_shingles")
    shared = rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.ceil(F.count("*") / _PART_ROWS).cast("int").alias("parts"))
    rows = stored(rows.join(shared.where("low <> high").select("shingle", "parts"), "shingle"), "shared_shingles")
    named = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("place", "node", "n", "root")]
    left = rows.select("shingle", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), *named("x"))
    right = rows.select("shingle", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *named("y"))
    left, right = left.alias("l"), right.alias("r")
    behind = F.least(F.col("n_x") - F.col("place_x"), F.col("n_y") - F.col("place_y"))
    may = (
        (F.col("l.shingle") == F.col("r.shingle")) & (F.col("l.part") == F.col("r.part")) & (F.col("root_x") < F.col("root_y"))
        & (100 * F.least("n_x", "n_y") >= percent * F.greatest("n_x", "n_y")) & ((100 + percent) * behind >= percent * (F.col("n_x") + F.col("n_y")))
    )
    return left.join(right, may).groupBy(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).agg(F.count("*").alias("guess"))


def _with_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
        pairs = pairs.withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs


def find(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, crowd: int = 48, reach: int = 4,
    far_crowd: int = 1024, far_reach: int = 256, far_trees: int = 6, least: float = 0.58,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document.

    Regions of a tree that share their first values and hold at most `crowd` nodes are
    compared in full, larger ones with the `reach` next nodes in order. Candidates whose
    estimated likeness is below `least`, four standard errors under `percent`, are left out.

    Only components are wanted, so pairs are confirmed in turns: each node's likeliest partner,
    then the likeliest pair of any two components, then all that still lie between different
    components. Nodes of crowded regions are then walked again in `far_trees` trees, regions of
    `far_crowd` in full and `far_reach` nodes ahead in larger ones, and pairs of different
    components confirmed on the spot. What these walks leave apart is joined exactly: of the
    nodes of crowded regions, all pairs that can reach `percent` by their rarest shingles are
    candidates. No candidate between components stays unconfirmed.

    Null texts and texts without words link with nothing. Rows of one id are one document,
    of the union of their links; null ids stay alone, with a null component. An empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # Whole texts go to Python in small batches, as words and shingles take several times their room.
    small = {"spark__sql__execution__arrow__maxRecordsPerBatch": "2500"}
    with settings(docs.sparkSession, **small):
        signed = stored(rows.mapInArrow(lambda b: _signatures(b, width), "doc_id long, n long, h1 long, h2 long, signs binary"), "signatures")
    classes = stored(
        signed.where("n > 0 AND doc_id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("node"), F.first("signs").alias("signs")), "classes",
    )
    nodes = classes.select("node", "n", "signs", F.col("node").alias("root"))
    found = stored(candidates(nodes, percent / 100, crowd, reach, least), "candidates")
    pairs, crowded = found.where("a <> b"), found.where("a = b").select(F.col("a").alias("node"))
    with settings(docs.sparkSession, **small):
        sets = stored(_sets(rows.where("doc_id IS NOT NULL"), found.select(F.explode(F.array("a", "b")).alias("node")).distinct(), width), "sets")

    both = pairs.select("a", "b", "guess", F.explode(F.array("a", "b")).alias("node"))
    best = both.groupBy("node").agg(F.max(F.struct("guess", F.negative(F.col("a") + F.col("b")).alias("near"), "a", "b")).alias("m"))
    first = stored(best.select("m.a", "m.b").distinct(), "first_pairs")
    links = stored(_confirm(first, sets, percent), "links_1")
    roots = components(links)
    rest = stored(_with_roots(pairs.join(first, ["a", "b"], "left_anti"), roots).where("root_a <> root_b"), "rest")
    between = rest.groupBy(F.least("root_a", "root_b").alias("u"), F.greatest("root_a", "root_b").alias("v")).agg(F.max(F.struct("guess", "a", "b")).alias("m"))
    second = stored(between.select("m.a", "m.b"), "second_pairs")
    links = stored(links.unionByName(_confirm(second, sets, percent)), "links_2")
    roots = components(links)
    left = _with_roots(rest.select("a", "b").join(second, ["a", "b"], "left_anti"), roots).where("root_a <> root_b")
    links = stored(links.unionByName(_confirm(left, sets, percent)), "links_3")
    roots = components(links)
    again = crowded.join(classes.select("node", "n", "signs"), "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    again = stored(again.join(sets, "node").select("node", "n", "signs", "root", "items"), "crowded")
    links = stored(links.unionByName(far_links(again, percent, far_crowd, far_reach, least, far_trees)), "links_4")
    with settings(docs.sparkSession, **small):
        again = again.drop("root").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        again = stored(again.select("node", "n", "root", "items"), "apart")
        pairs = stored(exact_pairs(again, percent), "exact_pairs")
    roots = again.select("node", "root")
    rooted = _with_roots(pairs, roots)
    between = rooted.groupBy(F.least("root_a", "root_b").alias("u"), F.greatest("root_a", "root_b").alias("v")).agg(F.max(F.struct("guess", "a", "b")).alias("m"))
    first = stored(between.select("m.a", "m.b"), "exact_first")
    links = stored(links.unionByName(_confirm(first, sets, percent)), "links_5")
    left = _with_roots(pairs.join(first, ["a", "b"], "left_anti"), components(links)).where("root_a <> root_b")
    links = stored(links.unionByName(_confirm(left, sets, percent)), "links_6")
    # Classes that share a document id are one.
    own = signed.where("n > 0 AND doc_id IS NOT NULL").join(classes.select("h1", "h2", "n", "node"), ["h1", "h2", "n"]).select("doc_id", "node")
    shared = own.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b")
    roots = components(links.unionByName(shared))
    named = classes.select("h1", "h2", "n", "node").join(roots, "node", "left").select("h1", "h2", "n", F.coalesce("root", "node").alias("root"))
    found = signed.select("doc_id", "n", "h1", "h2").join(named, ["h1", "h2", "n"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)),
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near duplicates of each document."""
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
