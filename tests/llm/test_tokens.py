"""Encoding, decoding, packing and chat text against the tokenizers library."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from parcelmill.llm import bpe, chat, packing
from parcelmill.llm.words import pack, pack_words, unpack, unpack_words
from tests.llm.brute import sha

HARD = [
    (1, "Hello World! it's THE end, the end."), (2, None), (3, ""), (4, "  \n\n  "), (5, "a<|endoftext|>b  <|endoftext|>"), (6, "ÉÈ école ñandú ß ẞ İstanbul Σίσυφος ΟΔΟΣ"),
    (7, "é Å ño"), (8, "x y z\x1cq\x85w tab\tend\r\n"), (9, "1234 12.5% a1b2 ²½ ٣"), (10, "日本語テキスト 한국어 😀👍🏽"), (11, "don't I'LL we've 's"), (12, "a" * 5000),
    (13, "word " * 9000), (13, "word " * 9000), (None, "no id"), (14, "wait...what?! (yes); no: #tag $5 *b* & | c"), (15, "\x00nul ﻿bom"),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame([(i, t, 9, "c") for i, t in HARD], "doc_id long, text string, words int, block string")


def test_packed_numbers_and_words():
    for numbers in ([], [0], [1, 2**32 - 1, 5]):
        assert unpack(pack(np.array(numbers, np.uint32))).tolist() == numbers
    for words in ([], [""], ["a", "", "é😀", "b\nc"]):
        assert unpack_words(*pack_words(words)) == words


def test_bpe_round_trip(spark, hard):
    name = path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(name)
    found = bpe.round_trip(hard, name, bucket_bytes=2000).collect()
    assert len(found) == len(HARD)
    want = sorted((i if i is not None else -1, tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t in HARD)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, list(r["ids"])) for r in found) == want
    texts = sorted((i if i is not None else -1, tokenizer.decode(ids, skip_special_tokens=False)) for i, ids in want)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["decoded"]) for r in found) == texts
    digest = {r["doc_id"]: r for r in bpe.round_trip(hard, name, digest=True).collect()}
    ids = dict(want)[6]
    assert digest[6]["ids_sha256"] == sha(",".join(map(str, ids))) and digest[6]["n_tokens"] == len(ids)
    assert bpe.round_trip(hard.limit(0), name).count() == 0


def test_pieces_and_packing(spark, hard):
    name = path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(name)
    found = packing.pieces(hard, name, 2048, 0).collect()
    want = []
    for i, t in HARD:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, n, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for n, at in enumerate(range(0, len(ids), 2048))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(tuple, found), key=key) == sorted(want, key=key)
    _valid(packing.pack(packing.pieces(hard, name, 2048, 0), 2048).collect(), len(want), 2048)
    assert packing.pack(packing.pieces(hard.limit(0), name, 2048, 0), 2048).count() == 0


def _valid(rows, count, capacity):
    assert len(rows) == count
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in bins.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= capacity
    # No two sequences could be one.
    fills = sorted(sum(length for _, length in members) for members in bins.values())
    assert len(fills) < 2 or fills[0] + fills[1] > capacity
    return len(bins)


@pytest.mark.parametrize("chunk_rows", [7, 100, 100_000])
def test_packing_in_rounds(spark, chunk_rows):
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in np.append(rng.integers(1, 101, 700), [100, 1, 1, 60, 60, 60])]
    rows = spark.createDataFrame([(i, 0, 0, s, 7) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(5)
    bins = _valid(packing.pack(rows, 100, chunk_rows=chunk_rows).collect(), len(sizes), 100)
    bound = -(-sum(sizes) // 100)
    assert bins <= bound * (1.10 if chunk_rows == 7 else 1.03) + 1


def test_items_that_never_fit_together_end_at_once(spark):
    rows = spark.range(300).selectExpr("id doc_id", "0 piece", "0L start", "60L length", "1L ids_crc32")
    assert _valid(packing.pack(rows, 100, chunk_rows=10).collect(), 300, 100) == 300


TURNS = [
    (1, 0, "system", "Be [INST] kind \\ </s>"), (1, 1, "user", "  hi "), (1, 2, "assistant", "  ok </s>[INST] [/INST]\n"), (1, 3, "assistant", ""), (1, 4, "assistant", None), (2, 5, None, "x"),
    (2, None, "assistant", "first"), (2, 6, "assistant", "]a\\"), (2, 6, "assistant", "]a\\"), (3, 0, "assistant", "😀 é [IN\\ST]\\\\"), (None, 0, "assistant", "lost"), (4, 0, "assistant</s>", "odd role"),
]


@pytest.mark.parametrize("part_chars", [1, 30, 1_000_000])
def test_chat_masks(spark, part_chars):
    rows = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, part string")
    formatted = chat.format_conversations(rows, path("byte_bpe_50k.json"), part_chars=part_chars)
    found = {r["conv_id"]: r for r in chat.digests(formatted).collect()}
    groups = {}
    for conv, turn, role, text in sorted(TURNS, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0, t[2] or "", t[3] or "")):
        groups.setdefault(conv, []).append((role or "", text or ""))
    assert set(found) == set(groups)
    for conv, turns in groups.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        r = found[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), sha(loss))
    whole = {}
    for r in sorted(formatted.collect(), key=lambda r: (r["conv_id"] or 0, r["part"])):
        text, ids = whole.get(r["conv_id"], ("", []))
        assert len(r["input_ids"]) == len(r["loss_mask"])
        whole[r["conv_id"]] = (text + r["text"], ids + list(r["input_ids"]))
    tokenizer = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for text, ids in whole.values():
        assert tokenizer.encode(text, add_special_tokens=False).ids == ids
    assert chat.digests(chat.format_conversations(rows.limit(0), path("byte_bpe_50k.json"))).count() == 0


def test_words_of_a_block_stay_in_order():
    words = pa.array([["b", "a", "b"], []])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), words], ["doc_id", "words"])

    read = lambda documents: pa.Table.from_batches(list(bpe._blocks(iter([batch]), 4, documents))).to_pylist()
    docs, rows = read(True)[0], read(False)
    assert {r["block"] for r in rows} == {docs["block"]}
    number = {w: c for r in rows for w, c in zip(unpack_words(r["word_sizes"], r["word_text"]), unpack(r["codes"]).tolist(), strict=True)}
    assert unpack(docs["codes"]).tolist() == [number["b"], number["a"], number["b"]] and unpack(docs["counts"]).tolist() == [3, 0]
