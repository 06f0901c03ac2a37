"""op3, op6, op7, op8 against plain versions of what they compute."""

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from inkweave.llm import op3_ppm as op3
from inkweave.llm import op6_quality as op6
from inkweave.llm import op7_language as op7
from inkweave.llm import op8_toxicity as op8
from tests.llm.helpers import plain, prose
from tests.llm.test_language_models import held


def ppm(train: list[bytes], stream: bytes) -> float:
    """log10 of the probability of a stream, context by context and byte by byte."""
    pad = op3.END * op3.ORDER
    seen = defaultdict(Counter)
    for s in train:
        s = pad + s
        for i in range(op3.ORDER, len(s)):
            for k in range(op3.ORDER + 1):
                seen[s[i - k : i]][s[i]] += 1
    total, stream = 0.0, pad + stream
    for i in range(op3.ORDER, len(stream)):
        out = set()
        for k in range(op3.ORDER, -1, -1):
            here = seen.get(stream[i - k : i])
            if not here:
                continue
            left = sum(n - 0.5 for s, n in here.items() if s not in out) + len(here) / 2
            if stream[i] in here:
                total += math.log10((here[stream[i]] - 0.5) / left)
                break
            total += math.log10(len(here) / 2 / left)
            out = set(here)
        else:
            total -= math.log10(max(1, 256 - len(seen.get(b"", ()))))
    return total


def test_op3_score_against_a_plain_ppm(spark):
    texts = {k: prose(k % 7, 30) + (" Äö 日本" if k % 5 == 0 else "") for k in range(30)} | {100: None, 101: "", 102: "zzz qqq 0123"}
    streams = {i: b" ".join(op3.normal(t)) + op3.END for i, t in texts.items()}
    train = [s for i, s in streams.items() if not held(i)]
    got = {r.doc_id: r.score for r in op3.score(plain(spark, texts)).collect()}
    assert got == pytest.approx({i: ppm(train, s) for i, s in streams.items()}, rel=1e-4)


def test_op6_features_and_dictionaries():
    import zstandard

    rows = pd.DataFrame({"text": [prose(k, 300) for k in range(40)] + [prose(k, 300).upper() for k in range(40)], "mark": [1] * 40 + [0] * 40})
    m = op6.fit(rows, {1: 40, 0: 40}, size=2000)
    text = prose(500, 400)
    sizes = []
    for raw in (m.good, m.bad):
        kind = zstandard.DICT_TYPE_FULLDICT if m.trained else zstandard.DICT_TYPE_RAWCONTENT
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind), write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(c.compress(text.encode()[k : k + 512])) for k in range(0, len(text.encode()), 512)))
    n = len(text.encode())
    d, r = (sizes[0] - sizes[1]) / n, min(sizes) / n
    assert m.features([text])[0] == pytest.approx([d, r, r * r, d * r, 1])
    assert d < 0 and m.score([text])[0] > 0.5 > m.score([text.upper()])[0]
    # too little to train in one class: both are raw, and of one size
    few = op6.fit(rows.iloc[[0, 1, 2, 40]], {1: 3, 0: 1}, size=2000)
    assert not few.trained and len(few.good) == len(few.bad) > 0
    assert set(op6.fit(rows.iloc[:40], {1: 40}).score(["a", ""])) == {1.0}


def phrases(training: str, text: str) -> int:
    """Greedy longest phrases of a text that occur in the training text, in blocks."""
    n = 0
    for at in range(0, len(text), op7.BLOCK):
        block, i = text[at : at + op7.BLOCK], 0
        while i < len(block):
            k = 1
            while i + k < len(block) and block[i : i + k + 1] in training:
                k += 1
            i += k
            n += 1
    return n


@pytest.mark.parametrize("dense", [2, 64])
def test_op7_counts_the_phrases(monkeypatch, dense):
    monkeypatch.setattr(op7, "DENSE", dense)
    training = {"a": " " + prose(1, 150) + " 日本語の漢字 ", "b": " " + prose(2, 90) + " äöü "}
    m = op7.fit(pd.DataFrame({"mark": list(training), "text": list(training.values())}))
    texts = [prose(3, 200), prose(4, 700), "日本 äx", "q", "", "é日x " * 300]
    got, _, lettered = m.phrases(texts)
    flat = lambda t: "".join(map(chr, np.abs(op7.squeezed(op7.code_points(t)))))
    learnt = {n: flat(" " + t + " ") for n, t in training.items()}
    assert got.tolist() == [[phrases(learnt[n], flat(t)) for n in m.names] for t in texts]
    assert lettered.tolist() == [True, True, True, True, False, True]


def test_op7_takes_equal_shares_from_all_over_its_texts():
    texts = [np.full(10, 1), np.full(1000, 2), np.arange(5000) + 10]
    got = op7.spread([t.astype(np.int32) for t in texts], 400)
    assert len(got) <= 400 and (got == 1).sum() == 10 and 150 < (got == 2).sum() <= 200
    far = got[got >= 10]
    assert far.min() == 10 and far.max() == 5009 and 150 < len(far) <= 200


def test_op8_restores_the_likeliest_word():
    words = Counter({"idiot": 5, "pilot": 3, "toad": 2, "boost": 2})
    model = op8.LetterModel.of(words, Counter())

    def best(word):
        options, i = [], 0
        while i < len(word):
            c, run = word[i], 1
            while i + run < len(word) and word[i + run] == c:
                run += 1
            i += run
            ch = op8.CHANNEL
            if c.isalpha():
                options.append([(c, 0.0)] if run == 1 else [(c, 0.0), (c + c, 0.0 if run == 2 else ch["double letter"])])
            elif c in op8.LEET:
                some = [(x * k, ch["letter for a sign"] + (ch["double letter"] if k == 1 and run == 2 else 0)) for x in op8.LEET[c] for k in range(1, min(run, 2) + 1)]
                options.append([*some, ("", ch["nothing for a digit" if c.isdigit() else "nothing for a sign"]), (c, ch["sign kept"])])
            else:
                options.append([("", ch["nothing for a separator"])])
        found = []
        for way in itertools.product(*options):
            marked = "^^" + "".join(x for x, _ in way) + "$"
            found.append((sum(p for _, p in way) + sum(model.cost(marked[k - 2 : k], marked[k]) for k in range(2, len(marked))), marked[2:-1]))
        return min(found)

    for masked in ("1d10t", "p1l0t", "t0@d", "b00st", "i.d.i-o_t", "id!0t", "1dddi0t"):
        cost, word = best(masked)
        assert model.restore(masked) == word, (masked, cost)
    assert model.restore("1d10t") == "idiot" and model.restore("b00st") == "boost"


def test_op8_one_rule_for_spaced_words():
    assert op8.spaced("a b o o b x") == ["a b o o b x"] and op8.spaced("1 2 3 4") == [] and op8.spaced("I 2 3") == []
    assert op8.spaced("you s t u p 1 d now") == ["s t u p", "s t u p 1 d"]
    words = op8.known_words(["Abc " + "x" * 40 + " " + "ab" * 30], np.array([1]))
    assert words == Counter({"abc": 3, "xxx": 3, "ab" * 30: 3})
