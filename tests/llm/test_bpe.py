"""op12: ids and texts of the library, the lookahead's bound, streaming and odd rows."""

import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkweave.llm import op12_bpe as op12
from tests.llm.helpers import empty, frame, odd_rows, prose


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(op12.default_vocabulary())


def small_vocabulary(folder, merges: list[tuple[str, str]]) -> str:
    letters = sorted({c for pair in merges for part in pair for c in part} | set("abc"))
    made = list(dict.fromkeys([*letters, *("".join(m) for m in merges)]))
    stored = {"model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(made)}, "merges": [list(m) for m in merges]}, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "added_tokens": []}
    path = folder / f"v{abs(hash(tuple(merges)))}.json"
    path.write_text(json.dumps(stored))
    return str(path)


def random_merges(seed: int) -> list[tuple[str, str]]:
    r = random.Random(seed)
    parts, merges = ["a", "b", "c"], []
    while len(merges) < 14:
        pair = r.choice(parts), r.choice(parts)
        if "".join(pair) not in parts and len("".join(pair)) < 9:
            merges.append(pair)
            parts.append("".join(pair))
    return merges


@given(st.lists(st.sampled_from([*"abcehinorst'-1 9\n\t", "the", " the", "é", "ß", "日本", "🙂", "½", "\x1c", "\x85", "\xa0", " ", "'ll", "'S", "<|endoftext|>"]), max_size=50).map("".join))
@settings(max_examples=200, deadline=None)
def test_ids_and_text_equal_the_library(text):
    from tokenizers import Tokenizer

    own = test_ids_and_text_equal_the_library.__dict__.setdefault("t", Tokenizer.from_file(op12.default_vocabulary()))
    v = op12.vocabulary(op12.default_vocabulary())
    ids = v.encode(text)
    assert ids == own.encode(text, add_special_tokens=False).ids
    assert v.decode(ids) == own.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("letters", ["a", "ab", "thein", "abcdefghijklmnopqrstuvwxyz", "ÃÂ", "-=", " ", "日本語", "0123456789"])
def test_pretokens_longer_than_the_lookahead(library, letters):
    v = op12.vocabulary(op12.default_vocabulary())
    r = random.Random(letters)
    text = "".join(r.choice(letters) for _ in range(5 * v.lookahead))
    assert v.encode(text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("seed", range(12))
def test_the_lookahead_suffices(tmp_path, seed):
    """On vocabularies of random merges: what ends a lookahead before the end of a prefix stands in every longer text, the
    transducer gives what the merges give, and its memory stays within the bound."""
    v = op12.Merges(small_vocabulary(tmp_path, random_merges(seed)))
    r = random.Random(seed)
    for _ in range(8):
        text = "".join(r.choice("abc"[: r.choice([2, 3])]) for _ in range(6 * v.lookahead)).encode()
        whole, _ = v.merged(text)
        assert list(itertools.chain.from_iterable(v.transduce(text))) == whole
        ends = set(np.cumsum([len(v.bytes_of[i]) for i in whole]).tolist())
        for n in range(v.lookahead, len(text), 7):
            at = 0
            for i in v.merged(text[:n])[0]:
                at += len(v.bytes_of[i])
                assert at > n - v.lookahead or at in ends
    assert max(len(run) for run in v.transduce(text)) <= 4 * v.lookahead


def test_fit_is_what_the_merges_say(tmp_path):
    for seed in range(12):
        v = op12.Merges(small_vocabulary(tmp_path, random_merges(100 + seed)))
        tokens = sorted(v.id_of.values())
        for a, b in itertools.product(tokens, tokens):
            assert v.fit(a, b) == (v.merged(v.bytes_of[a] + v.bytes_of[b])[0] == [a, b])


def test_long_texts_go_block_by_block(monkeypatch):
    r = random.Random(3)
    pieces = ["the", " ", "  ", "\n", "'ll", "'", "l", "12", ".", "é", " a", "日", "\t", "'r", "e"]
    cut = op12.Pretokens()
    for k in range(200):
        text = "".join(r.choice(pieces if k % 2 else pieces[:-4]) for _ in range(120))
        assert list(itertools.chain.from_iterable(cut.of(text, 9))) == next(cut.of(text))
    assert list(itertools.chain.from_iterable(cut.of("x" * 100 + " y", 9))) == ["x" * 100, " y"]


def test_decoding_by_blocks():
    v = op12.vocabulary(op12.default_vocabulary())
    ids = [v.byte[bytes([b])] for b in "日本 é🙂".encode()] + [v.byte[b"\xe6"], v.byte[b"\x97"]]
    machine = v.decoder()
    assert "".join(machine.feed([i]) for i in ids) + machine.end() == v.decode(ids) == "日本 é🙂�"
    assert v.decode([]) == ""


def test_words_that_are_no_longer_known(monkeypatch, library):
    monkeypatch.setattr(op12, "KNOWN_WORDS", 3)
    v = op12.Merges(op12.default_vocabulary(), op12.vocabulary(op12.default_vocabulary()).lookahead)
    text = prose(4, 300)
    assert v.encode(text) == library.encode(text, add_special_tokens=False).ids and len(v._known) <= 3


def test_odd_rows(spark, library):
    rows = odd_rows() + [(50, "x<|endoftext|> y" * 3, "en", "s", 1)]
    out = op12.round_trip(frame(spark, rows), op12.default_vocabulary()).collect()
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out) == sorted(want)
    assert op12.round_trip(empty(spark), op12.default_vocabulary()).count() == 0
    encoded = op12.encode(frame(spark, rows), op12.default_vocabulary())
    assert sorted(len(r.ids) for r in encoded.collect()) == sorted(n for _, n, *_ in want)
    back = op12.decode(encoded, op12.default_vocabulary()).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, *_ in rows)


def test_other_vocabularies_are_refused(tmp_path):
    path = tmp_path / "other.json"
    path.write_text(json.dumps({"model": {"type": "WordPiece", "vocab": {}, "merges": []}, "pre_tokenizer": {"type": "ByteLevel"}}))
    with pytest.raises(ValueError):
        op12.Merges(str(path))
