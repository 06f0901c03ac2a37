"""op11 against brute force, its keys and its arithmetic."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkweave.llm import op11_phrases as op11
from tests.llm.helpers import SCHEMA, empty, frame, odd_rows, prose

FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def by_force(rows, least=10, longest=3, cover=50, most=2000):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, total = {}, Counter()
    for _, text, lang, *_ in rows:
        own = counts.setdefault(lang or "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                for k in range(len(words) - n + 1):
                    own[tuple(words[k : k + n])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for p, a in f.items():
            if len(p) < 2 or a < least:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            longer = [b for q, b in f.items() if len(q) > len(p) and b >= least and any(q[s : s + len(p)] == p for s in range(len(q) - len(p) + 1))]
            if not any(100 * b >= cover * a for b in longer):
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, rank, p.decode(), -a, x, y, total[lang], -s) for rank, (s, a, p, x, y) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


def mined(df, **settings):
    return sorted(tuple(r[c] for c in FIELDS) for r in op11.mine(df, **settings).collect())


def corpus():
    names = ["Alpha beta GAMMA", "new york city", "é ü ß", "日本 語 文", "alpha beta"]
    rows = [(k, f"{prose(k % 9, 30)}, {names[k % 5]}\t{names[k % 3]}; {prose(k, 8)}! {names[0]} x\n{names[k % 2]}", ["en", "de", None][k % 3], "s", 1) for k in range(90)]
    return odd_rows() + rows + [(500, "a a a a a a a a a a a a a a", "und", "s", 1)]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    if small:  # many slices, ranges and parts
        monkeypatch.setattr(op11, "RANGE", 500)
        monkeypatch.setattr(op11, "MOST_BOUNDS", 7)
        monkeypatch.setattr(op11, "PACKED", 100)
        monkeypatch.setattr(op11, "SLICE", 3000)
    rows = corpus()
    df = frame(spark, rows).repartition(5)
    want = by_force(rows)
    assert mined(df) == want and len(want) > 50
    if small:
        assert mined(df, least=3, longest=4, cover=90, most=40) == by_force(rows, 3, 4, 90, 40)


def test_a_null_language_is_und(spark):
    rows = [(1, "one two " * 12, None, "s", 1), (2, "one two " * 3, "und", "s", 1)]
    assert mined(frame(spark, rows)) == by_force(rows)


def test_empty_tables_and_rare_words(spark):
    assert op11.mine(empty(spark)).count() == 0
    assert op11.mine(frame(spark, [(1, "all words here differ", "en", "s", 1), (2, None, None, "s", None)])).count() == 0
    assert [t for t, _ in op11.mine(empty(spark)).dtypes] == list(FIELDS)


def test_keys_sort_as_their_numbers():
    r = np.random.RandomState(1)
    ids = r.randint(0, 2**40, (4000, 3))
    ids[:2000] %= 70000
    ids[::7, 2] = 0
    keys = op11.packed(ids)
    assert keys.shape == (4000, 15) and (op11.unpacked(keys) == ids).all()
    order = op11.radix_order(keys)
    assert ids[order].tolist() == sorted(ids.tolist())
    assert [k.tobytes() for k in keys[order]] == sorted(k.tobytes() for k in keys)
    back, counts = op11.opened(op11.block(keys, np.arange(4000)), 15)
    assert (back == keys).all() and (counts == np.arange(4000)).all()
    some = keys[order][[0, 0, 0, 5, 9, 9]]
    distinct, sums = op11.run_lengths(some, np.array([1, 2, 3, 4, 5, 6]))
    assert sums.tolist() == [6, 4, 11] and (distinct == some[[0, 3, 4]]).all()


def test_runs_whose_numbers_pass_64_bits():
    codes = np.array([0, 1, 2, 0, 1, -1, 2, 0, 1, 2], dtype="<i4")
    runs = op11.SliceRuns(codes.tobytes(), np.array([0, 1, 2]), np.array([30, 10, 2**39]))
    pad = np.arange(2**21) + 2**33
    wide = op11.SliceRuns(codes.tobytes(), np.append([0, 1, 2], np.arange(3, 3 + len(pad))), np.append([30, 10, 2**39], pad))
    assert wide.of(3).ndim == 2 and runs.of(3).ndim == 1
    for n in (2, 3):
        (found, counts), (again, times) = runs.counted(n), wide.counted(n)
        rows = runs.ids(found, n)
        assert rows.tolist() == sorted(rows.tolist()) == wide.ids(again, n).tolist() and (counts == times).all()
        assert sorted(map(tuple, wide.some(n, 1).tolist())) == sorted(map(tuple, rows.tolist()))


def test_blocks_cut_packed_runs_at_the_bounds():
    keys = op11.packed(np.array([[1, 5], [1, 9], [2, 2], [7, 1], [7, 3], [9, 9]]))
    counts = np.arange(6)
    bounds = [k.tobytes() for k in op11.packed(np.array([[1, 9], [1, 9], [7, 2]]))]
    out = list(op11._blocks(keys, counts, bounds, 1))
    assert [(r, op11.unpacked(op11.opened(b, 10)[0])[:, 0].tolist()) for r, _, b in out] == [(0, [1]), (2, [1, 2, 7]), (3, [7, 9])]
    parted = [op11.opened(b, 10) for _, _, b in op11._blocks(keys, counts, bounds, 3)]
    assert sorted(c for _, cs in parted for c in cs.tolist()) == list(range(6))


def test_scores_are_exact_past_64_bits(spark):
    cases = [(999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (10**12 + 7, 10**14 + 3, 10**12 + 11), (3_037_000_500, 3_037_000_501, 4_000_000_007), (10, 10, 11)]
    out = spark.createDataFrame(cases, "a long, l long, r long").withColumn("s", op11.score("a", "l", "r")).collect()
    assert [x.s for x in out] == [1_000_000 * a * a // (x * y) for a, x, y in cases]


def test_rows_of_one_word_and_hot_languages(spark):
    """A third of all rows in one language, one bigram in each of them."""
    rows = [(k, f"the same words {prose(k, 5)}", "en" if k % 3 else "de", "s", 1) for k in range(300)]
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(6)) == by_force(rows)
    assert spark.createDataFrame(rows, SCHEMA).agg(F.count("*")).first()[0] == 300
