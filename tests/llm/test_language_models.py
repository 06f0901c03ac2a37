"""op3: exact baseline, a proper distribution, odd rows."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from inkweave.llm import op3_ppm as op3
from tests.llm.helpers import empty, frame, odd_rows, plain, prose


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2


def test_op3_baseline_against_brute_force(spark):
    rows = odd_rows() + [(100 + k, prose(k % 9, 80), "en", "s", 1) for k in range(60)]
    tokens = [((t or "").encode().lower().split() + [b"\n"]) for _, t, *_ in rows]
    counts = Counter(w for (i, *_), ws in zip(rows, tokens, strict=True) if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    out = op3.score(frame(spark, rows)).collect()
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 5), r.held_out, r.train_tokens) for r in out)
    want = sorted((i or -1, len(ws), sum(counts[w] > 0 for w in ws), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 5), held(i), n) for (i, *_), ws in zip(rows, tokens, strict=True))
    assert got == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)


@pytest.mark.parametrize("least", [1, 4, 30])
def test_op3_probabilities_sum_to_one(least):
    r = np.random.RandomState(1)
    streams = [bytes(r.choice(list(b"abcab cd"), 150).tolist()) + b"\n" for _ in range(40)]
    keys, n = op3.tallied(op3.grams(streams)[0])
    orders = []
    for k in range(op3.ORDER + 1):
        g, c = op3.tallied(keys & np.uint64(256 ** (k + 1) - 1), n)
        orders.append((g[c >= least], c[c >= least]))
    trie = op3.Trie(orders)
    contexts = [*(r.choice(keys, 6) >> np.uint64(8)), np.uint64(0x0102030405)]
    for c in contexts:
        p = 10.0 ** trie.log10((np.uint64(c) << np.uint64(8)) | np.arange(256, dtype=np.uint64))
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_op3_grams_follow_each_text():
    keys, owner = op3.grams([b"ab\n", b"\n", b"c\n"])
    last = (keys & np.uint64(255)).tolist()
    assert bytes(last) == b"ab\n\nc\n" and owner.tolist() == [0, 0, 0, 1, 2, 2]
    assert (keys >> np.uint64(8))[0] == int.from_bytes(b"\n" * op3.ORDER, "big") == (keys >> np.uint64(8))[3]


def test_op3_learns(spark):
    texts = {k: prose(k, 200) for k in range(300)}
    out = op3.score(plain(spark, texts)).collect()
    held_ = [r for r in out if r.held_out]
    size = sum(len(texts[r.doc_id]) + 1 for r in held_)
    assert -sum(r.score for r in held_) / size < 0.75, "letters at random would take over 1.1 a byte"


def test_op3_empty_and_nothing_to_learn(spark):
    assert op3.score(empty(spark)).count() == 0
    only_held = next(i for i in range(100) if held(i))
    (r,) = op3.score(plain(spark, {only_held: "ab"})).collect()
    assert r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(-3 * math.log10(256))


def test_op3_keeps_rare_grams_of_a_large_corpus(spark):
    # over 2 million training bytes, where a trie of at most 2^20 nodes an order dropped what was seen once
    long = [prose(k, 30_000) for k in range(4)]
    texts = {k: long[k % 4] for k in range(24)} | {100 + k: f"rare{k}word zq{k}x {prose(k, 20)}" for k in range(40)}
    tries = {i: [b" ".join(t.encode().split()) + b"\n"] for i, t in texts.items()}
    keys, n = op3.tallied(op3.grams([s for i, (s,) in tries.items() if not held(i)])[0])
    assert n.sum() > 2 << 20
    trie = op3.Trie([op3.tallied(keys & np.uint64(256 ** (k + 1) - 1), n) for k in range(op3.ORDER + 1)])
    want = {i: trie.log10(op3.grams(s)[0]).sum() for i, s in tries.items()}
    for size in (op3.HELD, 50_000):
        got = {r.doc_id: r.score for r in op3.score(plain(spark, texts), held_bytes=size).collect()}
        assert got == pytest.approx(want, rel=1e-5)


@pytest.mark.parametrize("crowd", [op3.CROWD, 300, 5])
def test_op3_crowded_endings_are_dealt_by_more_bytes(spark, crowd):
    # "ka" ends most contexts
    texts = {k: "ka" * 200 + " " + prose(k, 60) + " ka" * 50 for k in range(40)} | {200: None, 201: ""}
    streams = {i: [b" ".join((t or "").encode().split()) + b"\n"] for i, t in texts.items()}
    keys, n = op3.tallied(op3.grams([s for i, (s,) in streams.items() if not held(i)])[0])
    trie = op3.Trie([op3.tallied(keys & np.uint64(256 ** (k + 1) - 1), n) for k in range(op3.ORDER + 1)])
    want = {i: trie.log10(op3.grams(s)[0]).sum() for i, s in streams.items()}
    got = {r.doc_id: r.score for r in op3.score(plain(spark, texts), held_bytes=3000, crowd=crowd).collect()}
    assert got == pytest.approx(want, rel=1e-5)


def test_op3_crowded_endings_by_length(spark):
    texts = plain(spark, {k: "ka" * 200 for k in range(20)}).selectExpr("string(doc_id) AS doc_id", "text", "false AS held_out")
    rows = op3.read(texts).cache()
    pairs = rows.filter("kind = 2").groupBy("key").sum("n").toPandas().sort_values("key")
    two = pairs["key"].to_numpy().astype(np.uint64), pairs["sum(n)"].to_numpy().astype(np.int64)
    found = op3.crowded(rows, two, 300)
    assert [{e.to_bytes(8, "big")[-k:] for e in endings.tolist()} for k, (endings, _, _) in enumerate(found, 2)] == [{b"kakaka"[:k], b"akakak"[:k]} for k in range(2, op3.ORDER)]
    assert op3.crowded(rows, two, op3.CROWD) == []
    # behind "ka": k, and the end of each text
    assert dict(zip(found[0][1].tolist(), found[0][2].tolist()))[int.from_bytes(b"kak", "big")] == 20 * 199
    rows.unpersist()
