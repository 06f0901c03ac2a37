"""op1 and op4: exact round trips, the reference libraries, packing invariants."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkweave.llm import op1_sentencepiece as op1
from inkweave.llm import op4_packing as op4
from tests.llm.helpers import empty, frame, odd_rows, prose


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=op1.default_model())


@given(st.text(max_size=60))
@settings(max_examples=150, deadline=None)
def test_op1_ids_equal_the_library(text):
    import sentencepiece

    text = text.replace("▁", "")
    processor = test_op1_ids_equal_the_library.__dict__.setdefault("p", sentencepiece.SentencePieceProcessor(model_file=op1.default_model()))
    m = op1.model(op1.default_model())
    ids = m.encode([text])[0]
    assert ids == processor.encode(text)
    assert m.decode(ids) == text


def test_op1_unigram_search_is_the_best_segmentation():
    m = op1.PieceModel.__new__(op1.PieceModel)
    m.kind, m.prefix, m.squeeze, m.fallback, m.unknown = 1, False, False, False, 0
    pieces = {"a": -3.0, "b": -3.0, "ab": -4.0, "abc": -9.0, "c": -3.5, "bc": -4.5, "▁": -1.0}
    m.ids = {p: i + 1 for i, p in enumerate(pieces)}
    m.score, m.worst, m._fits, m._known = pieces, -19.0, {}, {}
    m.kinds = {p[i:]: p[i:] in pieces for p in pieces for i in range(len(p))}

    def best(w):
        if not w:
            return 0.0
        return max([pieces[w[:k]] + best(w[k:]) for k in range(1, len(w) + 1) if w[:k] in pieces] + [(-19.0 + best(w[1:])) if w[0] not in pieces else -1e9])

    names = {i: p for p, i in m.ids.items()} | {0: None}
    words = sorted({"abc", "abab", "abcx", "bca", "x", "cab", "abcabc"})
    for w, ids in m.search(words).items():
        assert sum(-19.0 if names[i] is None else pieces[names[i]] for i in ids) == pytest.approx(best(w))


def test_op1_odd_rows(spark, library):
    rows = odd_rows()
    out = op1.round_trip(frame(spark, rows), op1.default_model()).collect()
    assert len(out) == len(rows) and all(r.lossless for r in out)
    wanted = sorted(zlib.crc32(np.array(library.encode(t or ""), dtype="<u4").tobytes()) for _, t, *_ in rows)
    assert sorted(r.ids_crc32 for r in out) == wanted
    assert op1.round_trip(empty(spark), op1.default_model()).count() == 0
    encoded = op1.encode(frame(spark, rows), op1.default_model())
    back = op1.decode(encoded, op1.default_model()).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, *_ in rows)


def test_op4_ids_equal_the_library():
    from tokenizers import Tokenizer

    own, encode = Tokenizer.from_file(op4.default_vocabulary()), op4.encoder(op4.default_vocabulary())
    for t in ["", "a", prose(3, 300), "日本 \n\n  x 🙂", "x <|endoftext|> y", "it's we'll  \t 12a"]:
        assert encode(t) == own.encode(t, add_special_tokens=False).ids


def test_op4_packing_keeps_every_piece(spark):
    rows = odd_rows()
    cut = op4.pieces(frame(spark, rows), op4.default_vocabulary())
    packed = op4.pack(cut, 3).cache()
    out = packed.collect()
    assert sum(r.length for r in out) == sum(len(op4.encoder(op4.default_vocabulary())(t or "")) + 1 for _, t, *_ in rows)
    by = {}
    for r in out:
        assert len(r.ids) == 4 * r.length and 0 < r.length <= 1024
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    long = sorted((r.piece, r.start, r.length) for r in out if r.doc_id == 11)
    assert all(n == 1024 for _, _, n in long[1:]) and [s for _, s, _ in long] == [sum(n for _, _, n in long[:k]) for k in range(len(long))]
    whole = op4.assemble(packed).collect()
    assert len(whole) == len(by) and all(len(r.ids) == 4 * r.length for r in whole)
    assert op4.pack(op4.pieces(empty(spark), op4.default_vocabulary()), 2).count() == 0


def test_op4_bins_against_brute_force():
    r = np.random.RandomState(0)
    lengths = r.randint(1, 101, 3000).tolist()
    bins = op4.Bins(100, 16)
    for n in lengths:
        free = sorted(f for f in range(101) for _ in bins.stacks[f])
        fitting = [f for f in free if f >= n]
        _, offset = bins.put(n)
        after = sorted(f for f in range(101) for _ in bins.stacks[f])
        if fitting:
            free.remove(fitting[0])  # the least free space that fits
            left = fitting[0] - n
            assert offset == 100 - fitting[0]
        else:
            if len(free) == 16 and n < 100:
                free = free[1:]  # the fullest closes
            left = 100 - n
            assert offset == 0
        assert after == sorted(free + ([left] if left else [])) and len(after) == bins.open <= 16
        assert bins.bits == sum(1 << f for f in set(after))
    assert bins.made >= -(-sum(lengths) // 100)
    big = op4.Bins(1024, 1 << 16)
    many = sorted(r.randint(1, 1025, 5000).tolist(), reverse=True)
    for n in many:
        big.put(n)
    assert big.made <= 1.02 * -(-sum(many) // 1024) + 1
