"""The prefix trie, hard negatives and exact duplicates against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from parcelmill.llm import exactdup, hardneg, prefixtrie

DATA = "/root/testdata/sf0.001"


def _trie(rows, block=20, heads=4):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns[conv].append(((turn is not None, turn or 0), role, hashlib.md5(text.encode()).hexdigest(), text))
    plain = {c: [(r, x) for _, r, _, x in sorted(own)] for c, own in turns.items()}
    made = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % heads
        made[c] = plain.get(c - c % block, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    words = lambda text: len(re.findall(r"[^\x20\x09-\x0D]+", text))
    out = {}
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaf = lambda n: not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in members)
        ends = ",".join(map(str, sorted(c for c in own if len(made[c]) == len(node))))
        out[min(own), len(node)] = (
            min(members[node[:-1]]) if node else None, len(own), sum(len(n) == len(node) + 1 for n in below), sum(map(leaf, below)),
            sum((len(members[n]) - 1) * words(n[-1][1]) for n in below if n), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def _found_trie(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, depth int")
    got = prefixtrie.prefix_trie(df, **how).collect()
    return {(r[0], r[1]): tuple(r[2:]) for r in got}, len(got)


def _talk(seed, convs, deepest):
    rng, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(rng.choice([1, 1, 2, 3, deepest if c % 9 == 0 else 4])):
            rows.append((c, t if rng.random() > 0.05 else None, rng.choice(["user", "assistant", None]) if t % 5 == 4 else "user", rng.choice(["a b", "c", "", None]) if t < 6 else "go on"))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("longest,held", [(256, 200_000), (3, 12)])
def test_prefix_trie(spark, longest, held):
    rows = _talk(4, 90, 25) + [(200, 1, "user", "only"), (200, 1, "user", "only"), (None, 0, "user", "lost"), (221, 0, None, None), (-7, 0, "user", "x " * 5000)]
    got, count = _found_trie(spark, rows, longest=longest, turns_held=held, heads=1)
    assert got == _trie(rows, heads=1) and count == len(got)
    rows = [r for r in rows if r[0] != -7]
    got, count = _found_trie(spark, rows, longest=longest, turns_held=held)
    assert got == _trie(rows) and count == len(got)


def test_prefix_trie_of_copies_and_nothing(spark):
    rows = [(c, t, "user", f"same {t}") for c in range(0, 3000) for t in range(2)] + [(5000, t, "user", "long") for t in range(700)]
    got, _ = _found_trie(spark, rows, heads=1)
    both = ",".join(map(str, range(3000)))
    assert got[0, 2] == (0, 3000, 0, 1, 2999 * 2, hashlib.sha256(both.encode()).hexdigest())
    assert got[0, 0][1:4] == (3001, 2, 2) and len(got) == 703 and got[5000, 700][:3] == (5000, 1, 0)
    assert _found_trie(spark, []) == ({}, 0)
    # Turnless: 2 takes two turns of an absent conversation in place of its only one.
    alone = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 > 0)
    assert _found_trie(spark, [(alone, 0, "user", "gone")])[0] == {(alone, 0): (None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())}


def test_a_trie_by_itself():
    rng = random.Random(9)
    trie, seen = prefixtrie.ZFastTrie(1), defaultdict(int)
    for _ in range(3000):
        seq = tuple(rng.choice("ab") for _ in range(rng.randint(1, 12)))
        seen[seq] += 1
        keys = b"".join(hashlib.md5(repr(seq[: d + 1]).encode()).digest() for d in range(len(seq)))
        trie.insert((keys, b"", 0, None, 0, seq), [1], 0)
    got = {}
    for segment, lo, hi, (n,), _ in trie.edges():
        got |= {segment[5][:d]: n for d in range(lo + 1, hi + 1)}
    prefixes = {s[:d] for s in seen for d in range(1, len(s) + 1)}
    assert got == {p: sum(n for s, n in seen.items() if s[: len(p)] == p) for p in prefixes}


def _negatives(rows, anchor, k=5):
    ints = {}
    for i, vec, label in rows:
        if i is None or vec is None or label is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        ints[i] = (label, [int(np.floor(256 * float(x))) for x in vec])
    out = set()
    for a, (label, vec) in ints.items():
        if not anchor(a):
            continue
        score = {i: sum(x * y for x, y in zip(vec, v, strict=True)) for i, (_, v) in ints.items() if i != a and len(v) == len(vec)}
        order = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in order if ints[i][0] == label][:k]:
            fit = [i for i in order if ints[i][0] != label and 80 * score[p] <= 100 * score[i] <= 100 * score[p]][:k]
            out |= {(a, p, r + 1, n, score[p], score[n]) for r, n in enumerate(fit)}
    return out


def test_hard_negatives(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(5, 24))
    rows = [(i, (centers[rng.integers(5)] * rng.choice([0.3, 1.0]) + 0.4 * rng.normal(size=24)).tolist(), int(rng.integers(4))) for i in range(900)]
    rows += [(1000 + i, rows[i % 7][1], i % 3) for i in range(60)]  # ties
    rows += [(2000, None, 1), (2010, [None] * 24, 1), (2020, [float("nan")] * 24, 1), (2030, [float("inf")] + [0.0] * 23, 1), (2040, rows[0][1], None), (None, rows[0][1], 1)]
    rows += [(2050, [0.0] * 24, 1), (2060, [], 0), (2061, [], 0), (2062, [], 1), (2070, [1e6] * 24, 2), (2080, [1.0, 2.0], 0), (2081, [1.0, 2.0], 0), (2082, [1.0, 1.9], 3)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, block string")
    for how in ({}, {"block_rows": 64, "portion": 5}):
        got = [tuple(r) for r in hardneg.mine(df, "id % 10 = 0", **how).collect()]
        assert len(got) == len(set(got)) and set(got) == _negatives(rows, lambda i: i % 10 == 0)
    assert any(a == 2060 for a, *_ in got) and any(a == 2080 for a, *_ in got)
    twice = hardneg.mine(df.unionByName(df), "id % 10 = 0")
    assert {tuple(r) for r in twice.collect()} == set(got) and twice.count() == len(got)
    assert hardneg.mine(df.limit(0), "id % 10 = 0").count() == 0
    # Too large for a score of 63 bits: the row takes no part.
    assert hardneg.mine(spark.createDataFrame([(i, [1e30], i % 2) for i in range(20)], df.select("vec_id", "embedding", "label").schema), "id % 10 = 0").count() == 0


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(1)
    block = lambda n: hardneg.Block(np.arange(n), np.zeros(n), (rng.normal(size=(n, 33)) * 256 + rng.normal(size=(n, 1)) * 900).astype(np.int64))
    a, r = block(20), block(500)
    exact, spread = a.vecs @ r.vecs.T, []
    for level in range(len(a.levels)):
        low, high = hardneg._bounds(a, r, level, None)
        assert (low <= exact).all() and (exact <= high).all()
        spread.append((high - low).mean())
    assert spread == sorted(spread, reverse=True)


@pytest.mark.parametrize("parts,fan", [(1, 8), (13, 2), (13, 4)])
def test_exact_duplicates(spark, parts, fan):
    rng = random.Random(parts)
    texts = ["a b", "a  b", "a\t\r\n b", "a b", "a b ", "", None, " ", "\n\n", "é x", "x" * 300_000, "x" * 300_000 + " "] + [f"one {i}" for i in range(40)]
    rows = [(rng.choice([rng.randrange(5000), None]) if rng.random() < 0.1 else i, rng.choice(texts) if rng.random() < 0.6 else "a b") for i in range(700)]
    rows += rows[:5] + [(None, "nobody"), (None, "nobody")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node int, digest string").repartition(parts)
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    want = []
    for i, t in rows:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        want.append((i, keep, len(own), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    order = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted((tuple(r) for r in exactdup.find(df, fan=fan).collect()), key=order) == sorted(want, key=order)
    left = exactdup.keep_one(df, fan=fan)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(i for i, k, _, kept, _ in want if kept and i is not None)
    assert exactdup.find(df.limit(0)).count() == 0


def test_digests_alone_do_not_make_copies(spark):
    """Entries of one digest stay apart where length or SHA-256 differ."""
    rows = [(node, 7, n, bytes([sha]), 10 * node + n, 1, 0) for node in range(6) for n in (1, 2) for sha in (1, 2)]
    runs = spark.createDataFrame(rows, "node int, digest long, n_chars int, sha binary, keep_id long, group_size long, lane int")
    merged = {(r["n_chars"], bytes(r["sha"])): (r["keep_id"], r["group_size"]) for r in exactdup.merge_runs(runs, 6, 2).collect()}
    assert merged == {(n, bytes([sha])): (n, 6) for n in (1, 2) for sha in (1, 2)}


def test_native_plan(spark):
    plan = exactdup.find(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
