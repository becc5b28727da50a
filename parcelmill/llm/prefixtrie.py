"""The trie of conversation prefixes, by z-fast tries.

A prefix of d turns has a hash: the exclusive or of the hashes of its turns, each taken
together with its depth, in 128 bits. Conversations become lists of such hashes, cut into
segments of bounded length; the segments that start at one prefix form a trie of their own.

Segments are dealt to tasks by their first turns. A task inserts them, batch by batch, into a
z-fast trie: a compacted node spans the depths (lo, hi] and is found in a table by the hash
of its prefix at the handle, the number in (lo, hi] that is divisible by the largest power of
two. A fat binary search over handles finds the node at which a segment leaves the trie, in
as many steps as the depth has bits. Then compacted edges are expanded to one row per depth
with the sums of all members, and rows of different tasks are summed by prefix hash.

What is asked of a subtree becomes a sum over members of a node. Every node is owned by its
smallest member, and the nodes of one owner are a path down to the end of its conversation.
So the distinct words and the leaves below a node are sums over members of what each owns,
with the part of the owner's path above the node taken off; the trie is run once to find
owners and once to sum what they own. No step goes level by level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelmill.session import stored

_KEY = 16  # bytes of a prefix hash


def handle_depth(lo: int, hi: int) -> int:
    """The number in (lo, hi] that is divisible by the largest power of two."""
    return hi & (-1 << ((lo ^ hi).bit_length() - 1))


class ZFastTrie:
    """Compacted tries over lists of prefix hashes, found by the hash at their handle.

    Depths count from the start of a segment. A node keeps the segment that spells its edge,
    the sums of the members that end in it, and the smallest member.
    """

    def __init__(self, sums: int) -> None:
        self.sums = sums
        self.roots: dict[bytes, int] = {}
        self.handles: dict[bytes, int] = {}
        self.first: dict[bytes, int] = {}  # a node by the hash one turn below its parent
        self.lo: list[int] = []
        self.hi: list[int] = []
        self.spelled: list[tuple] = []
        self.parent: list[int] = []
        self.ended: list[list[int]] = []
        self.least: list[int | None] = []
        self.held = 0

    def _add(self, lo: int, hi: int, spelled: tuple, parent: int) -> int:
        for column, value in ((self.lo, lo), (self.hi, hi), (self.spelled, spelled), (self.parent, parent), (self.ended, [0] * self.sums), (self.least, None)):
            column.append(value)
        return len(self.lo) - 1

    def exit_node(self, root: int, keys: bytes, length: int) -> tuple[int, int]:
        """The node at which `keys` leaves the trie or ends, and how deep it agrees with that node's edge."""
        node, a, b = root, 0, length
        while a < b:
            f = handle_depth(a, b)
            hit = self.handles.get(keys[_KEY * (f - 1) : _KEY * f])
            if hit is None:
                b = f - 1
            else:
                node, a = hit, self.hi[hit]
        own = self.spelled[node][0]
        if node != root and (self.hi[node] > length or not self._agree(own, keys, self.hi[node])):
            return node, self._depth(node, keys, length)
        below = self.hi[node]
        if below < length:
            child = self.first.get(keys[_KEY * below : _KEY * (below + 1)])
            if child is not None:
                return child, self._depth(child, keys, length)
        return node, below

    @staticmethod
    def _agree(own: bytes, keys: bytes, depth: int) -> bool:
        return own[_KEY * (depth - 1) : _KEY * depth] == keys[_KEY * (depth - 1) : _KEY * depth]

    def _depth(self, node: int, keys: bytes, length: int) -> int:
        """The deepest place of the edge where both agree: prefixes agree up to there and no further."""
        own, a, b = self.spelled[node][0], self.lo[node], min(self.hi[node], length)
        while a < b:
            mid = (a + b + 1) // 2
            if self._agree(own, keys, mid):
                a = mid
            else:
                b = mid - 1
        return a

    def _name(self, node: int) -> None:
        f = handle_depth(self.lo[node], self.hi[node])
        self.handles[self.spelled[node][0][_KEY * (f - 1) : _KEY * f]] = node

    def insert(self, segment: tuple, sums: list[int], least: int) -> None:
        """Add the members of a segment: (prefix hashes, start hash, start depth, words, words before)."""
        keys, start = segment[0], segment[1]
        length = len(keys) // _KEY
        root = self.roots.get(start)
        if root is None:
            root = self.roots[start] = self._add(0, 0, segment, -1)
        node, depth = self.exit_node(root, keys, length)
        if depth < self.hi[node]:  # the edge is cut where the segment leaves it
            upper = self._add(self.lo[node], depth, self.spelled[node], self.parent[node])
            own, low = self.spelled[node][0], self.lo[node]
            self.first[own[_KEY * low : _KEY * (low + 1)]] = upper
            f = handle_depth(low, self.hi[node])
            del self.handles[own[_KEY * (f - 1) : _KEY * f]]
            self.lo[node], self.parent[node] = depth, upper
            self.first[own[_KEY * depth : _KEY * (depth + 1)]] = node
            self._name(node)
            self._name(upper)
            node = upper
        if depth < length:
            leaf = self._add(depth, length, segment, node)
            self.first[keys[_KEY * depth : _KEY * (depth + 1)]] = leaf
            self._name(leaf)
            self.held += length
            node = leaf
        self.ended[node] = [x + y for x, y in zip(self.ended[node], sums, strict=True)]
        self.least[node] = least if self.least[node] is None else min(self.least[node], least)

    def edges(self) -> Iterator[tuple[tuple, int, int, list[int], int]]:
        """(segment, lo, hi, sums and smallest of all members at or below) of each compacted edge."""
        for node in sorted(range(len(self.lo)), key=lambda i: -self.hi[i]):
            up = self.parent[node]
            if up < 0:
                continue
            self.ended[up] = [x + y for x, y in zip(self.ended[up], self.ended[node], strict=True)]
            self.least[up] = self.least[node] if self.least[up] is None else min(self.least[up], self.least[node])
            yield self.spelled[node], self.lo[node], self.hi[node], self.ended[node], self.least[node]


def _segments(batch: pa.RecordBatch, sums: list[str]) -> Iterator[tuple[tuple, list[int], int]]:
    """Each segment of a batch with what its member brings."""
    turns = batch.column("turns")
    flat, edges = turns.flatten(), turns.offsets.to_numpy()
    edges = edges - edges[0]
    start = np.stack([batch.column("x1").to_numpy(), batch.column("x2").to_numpy()], axis=1)
    keys = np.stack([np.bitwise_xor.accumulate(flat.field(h).to_numpy()) for h in ("h1", "h2")], axis=1) if len(flat) else np.zeros((0, 2), np.int64)
    words = flat.field("words").to_numpy()
    depth, before, conv = (batch.column(c).to_pylist() for c in ("depth", "before", "conv"))
    brought = list(zip(*[batch.column(c).to_pylist() for c in sums], strict=True))
    for i in range(len(conv)):
        lo, hi = edges[i], edges[i + 1]
        own = keys[lo:hi] ^ start[i]
        if lo:
            own = own ^ keys[lo - 1]
        yield (own.tobytes(), start[i].tobytes(), depth[i], words[lo:hi], before[i]), list(brought[i]), conv[i]


def _expanded(sums: list[str], turns_held: int, shape: bool):
    """A function for mapInArrow: segments in, one row per node of the task's tries out."""
    names = ["y1", "y2", *sums, *(["least", "p1", "p2", "depth", "words", "before"] if shape else [])]

    def rows(trie: ZFastTrie) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[] for _ in names]
        count = 0
        for (keys, start, depth, words, before), lo, hi, total, least in trie.edges():
            n = hi - lo
            path = np.frombuffer(start + keys[: _KEY * hi], np.int64).reshape(-1, 2)
            values = [path[lo + 1 :, 0], path[lo + 1 :, 1], *(np.full(n, x) for x in total)]
            if shape:
                so_far = before + np.concatenate([[0], np.cumsum(words[:hi])])
                values += [np.full(n, least), path[lo:hi, 0], path[lo:hi, 1], depth + np.arange(lo + 1, hi + 1), words[lo:hi], so_far[lo:hi]]
            for part, value in zip(parts, values, strict=True):
                part.append(value)
            count += n
            if count >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).astype(np.int64)) for p in parts], names)
                parts, count = [[] for _ in names], 0
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p).astype(np.int64)) for p in parts], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ZFastTrie(len(sums))
        for batch in batches:
            # Members of a batch that are equal go in together.
            equal: dict[bytes, list] = {}
            for segment, brought, conv in _segments(batch, sums):
                end = segment[0][-_KEY:]
                known = equal.get(end)
                if known is None:
                    equal[end] = [segment, brought, conv]
                else:
                    known[1] = [x + y for x, y in zip(known[1], brought, strict=True)]
                    known[2] = min(known[2], conv)
            for segment, brought, conv in equal.values():
                trie.insert(segment, brought, conv)
                if trie.held > turns_held:
                    yield from rows(trie)
                    trie = ZFastTrie(len(sums))
        yield from rows(trie)

    return run, ", ".join(f"{n} long" for n in names)


def lookup(rows: DataFrame, table: DataFrame, on: list[str], salt: Column, salts: int = 64) -> DataFrame:
    """`rows` left-joined with `table`, which has one row per key; rows of a hot key are spread by `salt`."""
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    asked = spread.select(*on, "_salt").distinct().join(table, on)  # a key is here once per salt at most
    return spread.join(asked, [*on, "_salt"], "left").drop("_salt")


def numbered(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, part, pos, role, digest, words): turns with their place in the conversation, from 1.

    Rows are sorted by ranges that may cut a conversation; a place is the place in its part plus
    the rows of the parts before.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.md5(text.cast("binary")).alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    dealt = stored(rows.repartitionByRange("conv", F.asc_nulls_first("turn"), "role").withColumn("part", F.spark_partition_id()), "turns")
    sizes = dealt.groupBy("conv", "part").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("earlier", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
    within = Window.partitionBy("conv", "part").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    return dealt.join(sizes, ["conv", "part"]).withColumn("pos", F.row_number().over(within) + F.col("earlier")).select("conv", "part", "pos", "role", "digest", "words")


def rebuilt(turns: DataFrame, block: int, heads: int) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first turns of their block's first one in place of their own.

    Conversation c takes the first h turns of c - c % block, h = crc32(decimal c) % heads, and
    goes on with its own after its first h. Returns (conv, depth, role, digest, words) and
    (conv), the latter with those that have no turns as well.
    """
    sizes = turns.groupBy("conv", "part").agg(F.count("*").alias("size"))
    convs = sizes.groupBy("conv").agg(F.sum("size").alias("size"))
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % block).withColumn("h", F.crc32(F.col("conv").cast("string").cast("binary")) % heads)
    bases = convs.where("conv = base").select("base", F.col("size").alias("base_size"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    # What a conversation needs to know reaches its rows part by part, so a huge one is not one key.
    shifts = sizes.join(convs, "conv").select("conv", "part", "h", "taken")
    own = turns.join(shifts, ["conv", "part"]).where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("taken"))
    lead = turns.where((F.col("pos") < heads) & (F.col("conv") % block == 0)).withColumnRenamed("conv", "base")
    given = convs.where("taken > 0").join(lead, "base").where("pos <= taken").withColumn("depth", F.col("pos"))
    columns = ["conv", "depth", "role", "digest", "words"]
    return given.select(columns).unionByName(own.select(columns)), convs.select("conv")


def segments(turns: DataFrame, longest: int) -> DataFrame:
    """Conversations cut into segments of `longest` turns, each with the hash and the words of what comes before.

    Columns conv, depth (turns before), x1, x2 (hash of the turns before), before (their words),
    total (words of the conversation), turns (array of h1, h2, words), e1, e2 (hash of the whole
    conversation).
    """
    h = lambda n: F.xxhash64(F.lit(n), F.col("depth"), F.col("role"), F.col("digest"))
    placed = turns.select("conv", "depth", h(1).alias("h1"), h(2).alias("h2"), "words", F.floor((F.col("depth") - 1) / longest).alias("seg"))
    cut = placed.groupBy("conv", "seg").agg(
        F.sort_array(F.collect_list(F.struct("depth", "h1", "h2", "words"))).alias("turns"),  # at most `longest`
        F.bit_xor("h1").alias("s1"), F.bit_xor("h2").alias("s2"), F.sum("words").alias("w"),
    )
    whole = Window.partitionBy("conv")
    earlier = whole.orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    return cut.select(
        "conv", (F.col("seg") * longest).alias("depth"), F.coalesce(F.bit_xor("s1").over(earlier), none).alias("x1"), F.coalesce(F.bit_xor("s2").over(earlier), none).alias("x2"),
        F.coalesce(F.sum("w").over(earlier), none).alias("before"), F.sum("w").over(whole).alias("total"), "turns",
        F.bit_xor("s1").over(whole).alias("e1"), F.bit_xor("s2").over(whole).alias("e2"),
    )


def member_digests(ends: DataFrame, ids_per_chunk: int = 4096) -> DataFrame:
    """(y1, y2, ends_sha256): of the ids of the conversations that end at a node, ascending, comma-joined.

    Ranges of (node, id) are joined to chunks of text first; then one task reads the chunks of a
    node in order and keeps nothing but the state of its hash.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y1, y2, conv = (batch.column(c).to_numpy() for c in ("y1", "y2", "conv"))
            cuts = np.flatnonzero(np.diff(y1) | np.diff(y2)) + 1
            rows = []
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(conv)], strict=True):
                for at in range(lo, hi, ids_per_chunk):
                    part = conv[at : min(at + ids_per_chunk, hi)]
                    rows.append((y1[lo], y2[lo], part[0], ",".join(map(str, part.tolist()))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["y1", "y2", "low", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done = []
            for y1, y2, ids in zip(*(batch.column(c).to_pylist() for c in ("y1", "y2", "ids")), strict=True):
                if at == (y1, y2):
                    state.update(b"," + ids.encode())
                    continue
                if at is not None:
                    done.append((*at, state.hexdigest()))
                at, state = (y1, y2), hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], ["y1", "y2", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*at, state.hexdigest())], ["y1", "y2", "ends_sha256"])

    dealt = ends.repartitionByRange("y1", "y2", "conv").sortWithinPartitions("y1", "y2", "conv")
    texts = dealt.mapInArrow(chunks, "y1 long, y2 long, low long, ids string")
    return texts.repartition("y1", "y2").sortWithinPartitions("y1", "y2", "low").mapInArrow(hashed, "y1 long, y2 long, ends_sha256 string")


def build(turns: DataFrame, convs: DataFrame, longest: int = 256, turns_held: int = 200_000) -> DataFrame:
    """One row per distinct prefix of the conversations given by (conv, depth, role, digest, words).

    `convs` has each conversation once, those without turns too. A segment has at most `longest`
    turns, and a task expands its tries once they hold `turns_held` turns.
    """
    spark = turns.sparkSession
    cut = stored(segments(turns, longest), "segments")
    first = lambda n: F.get("turns", F.lit(n))["h1"]
    order = ["depth", "x1", "x2", "a", "b", "conv"]

    def tries(rows: DataFrame, sums: list[str], shape: bool) -> DataFrame:
        run, columns = _expanded(sums, turns_held, shape)
        near = rows.withColumn("a", first(0)).withColumn("b", first(1))  # neighbours share their first turns
        return near.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, columns)

    found = tries(cut.select("conv", "depth", "x1", "x2", "before", "turns", F.lit(1).cast("long").alias("n"), "total"), ["n", "total"], True)
    key, up = ["y1", "y2"], ["p1", "p2"]
    same = [F.any_value(c).alias(c) for c in (*up, "depth", "words", "before")]
    nodes = stored(found.groupBy(key).agg(F.sum("n").alias("n_convs"), F.sum("total").alias("total"), F.min("least").alias("conv_id"), *same), "nodes")
    children = nodes.groupBy(F.col("p1").alias("y1"), F.col("p2").alias("y2")).agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, key, "left").na.fill(0, ["n_children"]), "counted")

    at_top = lambda c: F.min_by(c, "depth").alias(c)
    owners = nodes.groupBy(F.col("conv_id").alias("conv")).agg(
        F.sum("words").alias("own"), (F.max_by("n_children", "depth") == 0).cast("long").alias("leaf"), F.min("depth").alias("top"),
        F.min_by("before", "depth").alias("above"), at_top("p1"), at_top("p2"),
    )
    parents = nodes.select(F.col("y1").alias("p1"), F.col("y2").alias("p2"), F.col("conv_id").alias("above_id"))
    owners = stored(lookup(owners, parents, up, F.col("conv")), "owners")
    brought = lookup(cut.select("conv", "depth", "x1", "x2", "before", "turns"), owners.select("conv", "own", "leaf"), ["conv"], F.col("depth"))
    below = tries(brought.na.fill(0, ["own", "leaf"]), ["own", "leaf"], False).groupBy(key).agg(F.sum("own").alias("own"), F.sum("leaf").alias("n_leaves"))

    counted = convs.agg(F.count("*").alias("n"), F.min("conv").alias("low")).first()
    everything = nodes.agg(F.sum((F.col("n_convs") - 1) * F.col("words")), F.sum((F.col("depth") == 1).cast("long")), F.sum((F.col("n_children") == 0).cast("long"))).first()
    root_id = F.lit(counted["low"]).cast("long")
    path = lookup(nodes.withColumn("conv", F.col("conv_id")), owners.select("conv", "top", "above", "above_id"), ["conv"], F.col("depth"))
    # Words of all members at or below the node, less the words of the distinct nodes there.
    saved = F.col("total") - F.col("n_convs") * F.col("before") - (F.col("own") - (F.col("before") - F.col("above")))
    parent = F.when(F.col("depth") > F.col("top"), F.col("conv_id")).when(F.col("depth") == 1, root_id).otherwise(F.col("above_id"))
    rows = path.join(below, key).select(*key, "conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", saved.alias("saved_tokens"))
    long = lambda x: F.lit(x).cast("long")
    root = spark.range(1 if counted["n"] else 0).select(
        long(0).alias("y1"), long(0).alias("y2"), root_id.alias("conv_id"), long(0).alias("depth"), long(None).alias("parent_conv_id"), long(counted["n"]).alias("n_convs"),
        long(everything[1] or 0).alias("n_children"), long(everything[2] or 1).alias("n_leaves"), long(everything[0] or 0).alias("saved_tokens"),
    )
    hashes = cut.where("depth = 0").select("conv", F.col("e1").alias("y1"), F.col("e2").alias("y2"))
    ends = convs.join(hashes, "conv", "left").na.fill(0, key)
    none = hashlib.sha256(b"").hexdigest()
    return rows.unionByName(root).join(member_digests(ends), key, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"),
    )


def prefix_trie(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    block: int = 20, heads: int = 4, longest: int = 256, turns_held: int = 200_000,
) -> DataFrame:
    """The trie of all prefixes of the rebuilt conversations (see `rebuilt`), one row per node.

    Returns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256. `heads` = 1 leaves conversations as they are.

    Turns are ordered by turn, null first; rows of one turn by role and then by the MD5 of the
    text; rows that repeat stay as turns of their own. Null roles and texts are empty strings, a
    text of any length is read whole; rows without a conversation id take no part. Conversations
    without turns are members of the root. Other columns are left aside, so their names can't
    clash; an empty table gives an empty result, as no conversation starts with the root.
    """
    turns = stored(numbered(df, conv_col, turn_col, role_col, text_col), "numbered")
    made, convs = rebuilt(turns, block, heads)
    return build(made, stored(convs, "conversations"), longest, turns_held)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all conversations."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP11_SQL = r"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, list({'role': role, 'text': text} ORDER BY pos) AS seq,
        xor(list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
            lambda crc, byte: list_reduce(
                list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)
        ), 4294967295::BIGINT) % 4 AS h
    FROM turns GROUP BY conv_id
),
made AS (
    SELECT c.conv_id, list_concat(list_slice(coalesce(b.seq, []), 1, c.h), list_slice(c.seq, c.h + 1, len(c.seq))) AS seq
    FROM convs c LEFT JOIN convs b ON b.conv_id = c.base
),
prefixes AS (
    SELECT conv_id, d AS depth, sha256(list_slice(seq, 1, d)::VARCHAR) AS node, sha256(list_slice(seq, 1, d - 1)::VARCHAR) AS up,
        CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(seq[d].text, '[^\x20\x09-\x0D]+')) END AS words, len(seq) = d AS ends
    FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM made)
),
nodes AS (
    SELECT node, depth, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
    FROM prefixes GROUP BY node, depth
),
children AS (SELECT up, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.up = n.node AND c.depth = n.depth),
sums AS (
    SELECT p.node, p.depth, sum((u.n_convs - 1) * u.words) AS saved_tokens, count(*) FILTER (WHERE u.n_children = 0) AS n_leaves
    FROM counted u JOIN prefixes p ON p.conv_id = u.conv_id AND p.depth <= u.depth GROUP BY ALL
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves,
    CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN sums s USING (node, depth) LEFT JOIN nodes p ON p.node = n.up AND p.depth = n.depth - 1
"""
