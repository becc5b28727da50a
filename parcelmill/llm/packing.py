"""Packing of documents into sequences by hierarchical best fit.

Documents become pieces of at most `capacity` tokens. Each task packs a chunk of pieces by
best fit, largest first. Nearly full bins are final; the others go into the next round as
items, in fewer chunks, until one chunk is left or nothing can be joined any more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmill.llm.words import WordEncoder, gather, ragged, slices
from parcelmill.session import stored

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
_MEMBER = pa.struct([*_FIELDS, ("offset", pa.int64())])


_KNOWN_WORDS = 250_000
# Fixed value: Latin letters, and marks that the tokenizer always cuts from letters before them.
_SPELLING = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<tail>[!%&*$#.,;:?)]*)$"


def _word_ids(encoder: WordEncoder, words: pa.StringArray, known: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words cut at white space, one after the other, and how many each has.

    Words of Latin letters are encoded once for all their spellings: in lower case and apart
    from marks at their end. Their merges give their ids; anything else is encoded as it
    stands. `known` keeps ids for the next call, of _KNOWN_WORDS words or one call's more.
    """
    parts = pc.extract_regex(words, _SPELLING)
    plain = parts.is_valid()
    core = pc.if_else(plain, pc.utf8_lower(pc.struct_field(parts, "core")), words).dictionary_encode()
    tail = pc.fill_null(pc.struct_field(parts, "tail"), "").dictionary_encode()
    names = core.dictionary.to_pylist()
    whole = pc.match_substring_regex(core.dictionary, _SPELLING).to_pylist()
    if len(known) > _KNOWN_WORDS:
        known.clear()
    fresh = [(w, p) for w, p in zip(names, whole, strict=True) if w not in known]
    merged = encoder.merged
    known.update([(w, merged(w)) for w, p in fresh if p])
    others = [w for w, p in fresh if not p]
    known.update(zip(others, encoder.encoded(others), strict=True))
    items, sizes = ragged([known[w] for w in names] + encoder.encoded(tail.dictionary.to_pylist()))
    pairs = np.stack([core.indices.to_numpy(), tail.indices.to_numpy() + len(names)], axis=1)
    return gather(items, np.cumsum(sizes) - sizes, sizes, pairs.ravel()), sizes[pairs].sum(axis=1)


def pieces(df: DataFrame, tokenizer_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts and check sums of each document's pieces.

    A document is its ids and `end_id`. Each distinct word of a batch is encoded once; the
    ids of a text are those of its words, as the tokenizer never joins over white space.
    Null texts are empty, and an empty text is one piece of one token.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = WordEncoder(tokenizer_path), {}
        for whole in batches:
            for low, high in slices(whole.column("text"), 5_000_000):
                batch = whole.slice(low, high - low)
                split = pc.split_pattern(pc.replace_substring(batch.column("text"), "\n", " "), " ")
                coded = split.flatten().dictionary_encode()
                codes = coded.indices.to_numpy()
                items, sizes = _word_ids(encoder, coded.dictionary, known)
                starts = np.cumsum(sizes) - sizes
                edges = split.offsets.to_numpy() - split.offsets[0].as_py()
                out: list[tuple[int | None, int, int, int, int]] = []
                for row, doc in enumerate(batch.column("doc_id").to_pylist()):
                    ids = np.append(gather(items, starts, sizes, codes[edges[row] : edges[row + 1]]), np.uint32(end_id)).astype("<u4")
                    for n, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        out.append((doc, n, at, len(part), zlib.crc32(part.tobytes())))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], [name for name, _ in _FIELDS])

    return rows.mapInArrow(run, _PIECE)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, largest first: indices of the items of each bin."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: a bin with room r exists
    bins: list[list[int]] = []
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        fitting = open_rooms >> size
        if fitting:
            left = size + (fitting & -fitting).bit_length() - 1
            at = room[left].pop()
            if not room[left]:
                open_rooms &= ~(1 << left)
            bins[at].append(int(i))
            left -= size
        else:
            at, left = len(bins), capacity - size
            bins.append([int(i)])
        room[left].append(at)
        open_rooms |= 1 << left
    return bins


def _round(items: DataFrame, capacity: int, chunk_rows: int) -> DataFrame:
    """Best fit within chunks of items (fill, members)."""
    members = pa.list_(_MEMBER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def packed() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            column = table.column("members").chunk(0)
            fills = table.column("fill").to_numpy()
            bins = best_fit(fills, capacity)
            order = np.array([i for one in bins for i in one], dtype=np.int64)
            taken = column.take(pa.array(order))
            counts = np.diff(column.offsets.to_numpy())[order]
            bin_of = np.repeat(np.arange(len(bins)), [len(one) for one in bins])
            size = np.bincount(bin_of, weights=counts, minlength=len(bins)).astype(np.int32)
            fill = np.bincount(bin_of, weights=fills[order], minlength=len(bins)).astype(np.int64)
            flat = taken.flatten()
            length = flat.field("length").to_numpy()
            ends = np.cumsum(size)
            upto = np.cumsum(length) - length
            offset = upto - np.repeat(upto[ends - size], size)
            flat = pa.StructArray.from_arrays([*[flat.field(name) for name, _ in _FIELDS], pa.array(offset)], [f.name for f in _MEMBER])
            joined = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), flat)
            return pa.RecordBatch.from_arrays([pa.array(fill), joined.cast(members)], ["fill", "members"])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= chunk_rows:
                yield packed()
        if any(b.num_rows for b in held):
            yield packed()

    member = "array<struct<" + _PIECE.replace(", ", ",").replace(" ", ":") + ",offset:long>>"
    return items.mapInArrow(run, f"fill long, members {member}")


def pack(found: DataFrame, capacity: int = 2048, chunk_rows: int = 100_000) -> DataFrame:
    """Sequence and place of each piece of `pieces`.

    A bin is final, and nearly full, when the emptiest bin left would not fit into it. Rounds
    end when the two emptiest bins do not fit together, so no two bins could be one. Best fit
    leaves a chunk of `chunk_rows` bins at most one that is filled to half, and only those can
    still be joined, so little is left to do after the second round; every other round deals
    the bins by fill, which brings the emptiest together. A bin has at most `capacity`
    members, so no row grows with the data. An empty table gives an empty result.
    """
    whole = found.where(F.col("length") >= capacity)
    small = found.where(F.col("length") < capacity)
    item = lambda rows: rows.select(F.col("length").alias("fill"), F.array(F.struct(*[name for name, _ in _FIELDS], F.lit(0).cast("long").alias("offset"))).alias("members"))
    done = [item(whole)]
    bins = stored(_round(item(small), capacity, chunk_rows), "bins_0")
    turn = 0
    while True:
        least = [row["fill"] for row in bins.select("fill").orderBy("fill").limit(2).collect()]
        if len(least) < 2 or sum(least) > capacity:
            done.append(bins)
            break
        full = F.col("fill") + least[0] > capacity
        done.append(bins.where(full))
        left = bins.where(~full)
        chunks = -(-left.count() // chunk_rows)
        dealt = left.repartition(chunks) if turn % 2 == 0 else left.repartitionByRange(chunks, "fill")
        turn += 1
        bins = stored(_round(dealt, capacity, chunk_rows), f"bins_{turn}")
    united = done[0]
    for one in done[1:]:
        united = united.unionByName(one)
    numbered = stored(united, "sequences").withColumn("sequence_id", F.monotonically_increasing_id())
    return numbered.select("sequence_id", F.explode("members").alias("m")).select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", "m.offset")


def op2_residual_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, each document ended by id 0."""
    from public_tokenizers import path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(stored(pieces(docs, path("word_bpe_49k.json"), 2048, 0), "pieces"), 2048)
