"""BPE encoding and decoding through a table of distinct words.

Spark splits texts into the words that byte-pair merges never cross. Rows of a batch form a
block: it numbers its distinct words and sends each to a bucket chosen by a hash of the word.
A bucket encodes every distinct word once, and sends the ids back to the places the word has
in the blocks. Decoding looks the ids up in the table of pieces.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelmill.llm.words import WordEncoder, byte_values, load_tokenizer, pack, pack_words, ragged, ranges, unpack, unpack_words
from parcelmill.session import settings, stored

# Fixed value: how the byte-level vocabulary cuts a text before its merges.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def added_tokens(tokenizer_path: str) -> list[str]:
    """Strings that a tokenizer file takes out of a text before anything else."""
    with open(tokenizer_path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f)["added_tokens"]]


def words_of(text: Column, added: list[str]) -> Column:
    """The words of a text, in order; added tokens are words of their own."""
    cut = lambda part: F.regexp_extract_all(part, F.lit(PATTERN), F.lit(0))
    if not added:
        return cut(text)
    quoted = "|".join("".join(f"\\x{{{ord(c):x}}}" for c in t) for t in sorted(added, key=len, reverse=True))
    parts, marks = F.split(text, quoted, -1), F.regexp_extract_all(text, F.lit(f"(?:{quoted})"), F.lit(0))
    mixed = F.flatten(F.transform(parts, lambda p, i: F.concat(cut(p), F.slice(marks, i + 1, F.lit(1)))))
    return F.when(text.rlike(quoted), mixed).otherwise(cut(text))


def piece_table(tokenizer_path: str) -> list[bytes]:
    """The bytes of each id, as a list by id: as long as the vocabulary."""
    vocabulary = load_tokenizer(tokenizer_path).get_vocab(with_added_tokens=True)
    value = byte_values()
    table = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        table[i] = bytes(value[c] for c in piece) if all(c in value for c in piece) else piece.encode()
    return table


_DOCUMENTS = "block string, doc_ids array<long>, counts binary, codes binary"
_WORDS = "block string, bucket int, codes binary, word_sizes binary, word_text binary"


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int, documents: bool) -> Iterator[pa.RecordBatch]:
    """Blocks of some 1.5 million words, named by a hash of their content.

    Either one row per block with its documents as word numbers, or one row per block and
    bucket with the words and their numbers.
    """
    names = [c.split(" ")[0] for c in (_DOCUMENTS if documents else _WORDS).split(", ")]
    kinds = [pa.string(), pa.list_(pa.int64()) if documents else pa.int32(), *[pa.binary()] * (2 if documents else 3)]
    for whole in batches:
        for low, high in ranges(pc.list_value_length(whole.column("words")), 1_500_000):
            batch = whole.slice(low, high - low)
            words = batch.column("words")
            coded = words.flatten().dictionary_encode()
            raw = coded.indices.to_numpy()
            # Common words get the small numbers, which compress best.
            order = np.argsort(-np.bincount(raw, minlength=len(coded.dictionary)), kind="stable")
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            counts, docs = np.diff(words.offsets.to_numpy()), batch.column("doc_id").to_pylist()
            by_name = pc.sort_indices(coded.dictionary).to_numpy()
            found = coded.dictionary.take(by_name).to_pylist()
            digest = xxhash.xxh3_128(number[raw].tobytes())
            for part in (counts.tobytes(), repr(docs).encode(), "".join(found).encode()):
                digest.update(part)
            block = digest.hexdigest()
            if documents:
                rows = [(block, docs, pack(counts), pack(number[raw]))]
            else:
                rows, number = [], number[by_name]
                home = np.fromiter((zlib.crc32(w.encode()) % buckets for w in found), np.int64, len(found))
                by_home = np.argsort(home, kind="stable")
                edges = np.searchsorted(home[by_home], np.arange(buckets + 1))
                for b in range(buckets):
                    at = by_home[edges[b] : edges[b + 1]]
                    if len(at):
                        rows.append((block, b, pack(number[at]), *pack_words([found[i] for i in at])))
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def round_trip(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, bucket_bytes: int = 16_000_000) -> DataFrame:
    """Ids of each text, and the text decoded from them.

    Returns doc_id, n_tokens and ids (array) and decoded (string), or with `digest` their
    SHA-256: of the decimal ids joined by commas, and of the text in UTF-8. The result is
    written to the shared folder.

    Texts are read twice, once for words and once for documents, rather than kept twice on
    disk; a block whose two readings differ is an error. Null texts are empty, repeated rows
    stay, an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    # Buckets grow with the corpus, so that a bucket's words fit a task whatever its size.
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-size // bucket_bytes))
    added = added_tokens(tokenizer_path)
    words = rows.select("doc_id", words_of(F.col("text"), added).alias("words"))
    kept: list[WordEncoder] = []

    def encode_bucket(table: pa.Table) -> pa.Table:
        if not kept:  # once per task
            kept.append(WordEncoder(tokenizer_path))
        encoder = kept[0]
        known = {w: encoder.encoded([w])[0] for w in added}
        sizes, ids = [], []
        for row in range(table.num_rows):
            own = unpack_words(table.column("word_sizes")[row].as_py(), table.column("word_text")[row].as_py())
            for w in own:
                if w not in known:
                    known[w] = encoder.merged(w)
            items, size = ragged([known[w] for w in own])
            sizes.append(pack(size))
            ids.append(pack(items))
        return pa.table({"block": table.column("block"), "codes": table.column("codes"), "sizes": pa.array(sizes, pa.binary()), "ids": pa.array(ids, pa.binary())})

    pieces = piece_table(tokenizer_path)  # as long as the vocabulary

    def put_together(docs: pa.Table, coded: pa.Table) -> pa.Table:
        if not docs.num_rows:
            raise RuntimeError("the texts changed between two readings")
        shown: dict[int, bytes] = {}
        plain: dict[int, bytes] = {}
        length: dict[int, int] = {}
        for codes, sizes, ids in zip(coded.column("codes"), coded.column("sizes"), coded.column("ids"), strict=True):
            codes, ids = unpack(codes.as_py()).tolist(), unpack(ids.as_py()).tolist()
            at = 0
            for code, n in zip(codes, unpack(sizes.as_py()).tolist(), strict=True):
                own = ids[at : at + n]
                at += n
                shown[code] = b"".join([b"%d," % i for i in own])
                plain[code] = b"".join([pieces[i] for i in own])
                length[code] = n
        out: list[list] = [[], [], [], []]
        for row in range(docs.num_rows):
            codes = unpack(docs.column("codes")[row].as_py()).tolist()
            at = 0
            for doc, n in zip(docs.column("doc_ids")[row].as_py(), unpack(docs.column("counts")[row].as_py()).tolist(), strict=True):
                own = codes[at : at + n]
                at += n
                joined, text = b"".join([shown[c] for c in own])[:-1], b"".join([plain[c] for c in own])
                if digest:
                    last = [hashlib.sha256(joined).hexdigest(), hashlib.sha256(text.decode("utf-8", "replace").encode()).hexdigest()]
                else:
                    last = [[int(i) for i in joined.split(b",")] if joined else [], text.decode("utf-8", "replace")]
                for column, value in zip(out, [doc, sum([length[c] for c in own]), *last], strict=True):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string() if digest else pa.list_(pa.int32()), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    names = ["doc_id", "n_tokens", *(["ids_sha256", "decoded_sha256"] if digest else ["ids", "decoded"])]
    schema = f"doc_id long, n_tokens long, {names[2]} {'string' if digest else 'array<int>'}, {names[3]} string"
    coded = words.mapInArrow(lambda b: _blocks(b, buckets, False), _WORDS).groupBy("bucket").applyInArrow(encode_bucket, "block string, codes binary, sizes binary, ids binary")
    documents = words.mapInArrow(lambda b: _blocks(b, buckets, True), _DOCUMENTS)
    joined = documents.groupBy("block").cogroup(coded.groupBy("block")).applyInArrow(put_together, schema)
    # A batch of words takes several times the room of its texts.
    with settings(df.sparkSession, spark__sql__execution__arrow__maxRecordsPerBatch="2500"):
        return stored(joined, "round_trip")


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again from its ids."""
    from public_tokenizers import path

    name = path("byte_bpe_50k.json")
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), name, digest=True)
