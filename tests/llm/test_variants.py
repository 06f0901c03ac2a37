"""op13 against brute force, with keys that are split, and its automaton."""

import random
import re
import zlib
from collections import Counter

import pytest

from inkweave.llm import op13_variants as op13
from tests.llm.helpers import empty, frame, odd_rows, prose

FIELDS = ("word", "form", "root", "n", "n_near", "form_n")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_error(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def by_force(rows, shortest=7, least=2, factor=10, noise=31):
    counts = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if noise and h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= shortest and n >= least}
    near = {w: [y for y in words if one_error(w, y)] for w in words}
    best = {w: min(ys, key=lambda y: (-words[y], y)) for w, ys in near.items() if ys}
    form = {w: y for w, y in best.items() if words[y] >= factor * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def grouped(df, **settings):
    return sorted((tuple(r[c] for c in FIELDS) for r in op13.group(df, **settings).collect()), key=lambda r: r[0])


def corpus(seed=5):
    """Words with planted errors at each place, in runs of one letter, in chains of forms."""
    r = random.Random(seed)
    rows = odd_rows()
    base = ["straßené", "aaaaaaa", "aaaaaaaa", "aabbaabb", "ABCDEFGHIJ", "intérêts", "abcabcabc", "zzzzzzzzzzzzzz"]
    for k, w in enumerate(base * 3):
        text = [w] * r.choice([1, 2, 40])
        for _ in range(6):
            at, c = r.randrange(len(w) + 1), r.choice("abézß")
            y = r.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])
            text += [y] * r.choice([1, 2, 3, 30])
        r.shuffle(text)
        rows.append((100 + k, " ".join(text), "en", "s", 1))
    rows.append((300, " ".join(["mississippi"] * 2 + ["mississippx"] * 20 + ["mississippxy"] * 200 + ["mississippxyz"] * 2000), "en", "s", 1))
    rows += [(400 + k, prose(k, 120), "en", "s", 1) for k in range(25)]
    return rows


@pytest.mark.parametrize("size", [20_000, 60, 5])
def test_against_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(op13, "GROUP", size)
    monkeypatch.setattr(op13, "CHUNK", size)
    rows = corpus()
    want = by_force(rows)
    assert grouped(frame(spark, rows).repartition(4)) == want
    assert max(r[4] for r in want) > 3 and any(r[2] != r[1] and r[1] for r in want)


def test_no_noise_and_other_bounds(spark):
    rows = corpus(6)
    assert grouped(frame(spark, rows), shortest=4, least=3, factor=2, noise=None) == by_force(rows, 4, 3, 2, None)


def test_empty_tables_and_long_runs(spark):
    assert op13.group(empty(spark)).count() == 0
    assert op13.group(frame(spark, [(1, None, None, "s", None), (2, "short ones", "en", "s", 1)])).count() == 0
    long = "ab" * 3000
    rows = [(k, f"{long} {long}c {long[1:]}", "en", "s", 1) for k in range(3)]
    assert grouped(frame(spark, rows)) == by_force(rows)


@pytest.mark.parametrize("seed", range(4))
def test_automaton_numbers_and_errors(seed):
    r = random.Random(seed)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(0, 7))) for _ in range(300)})
    a = op13.Automaton(words)
    assert [a._rest(a.root, 0, w) for w in words] == list(range(len(words)))
    assert a._rest(a.root, 0, "abcabcabcabc") == -1
    # minimal: no two states have the same words behind them
    seen = [(a.final[k], tuple((c, to) for c, (to, _) in a.next[k].items())) for k in range(len(a.next))]
    assert len(set(seen)) == len(seen)
    for w in words[::5]:
        assert a.near(w, 0, len(w)) == {k for k, y in enumerate(words) if one_error(w, y)}
        h = len(w) // 2
        behind = {k for k, y in enumerate(words) if y[:h] == w[:h] and one_error(w[h:], y[h:])}
        assert a.near(w, h, len(w)) == behind


def test_a_prefix_of_a_third_of_all_words_is_split(spark):
    r = random.Random(1)
    rows = [(k, " ".join(["prefix" + "".join(r.choice("abcd") for _ in range(6))] * 2), "en", "s", 1) for k in range(400)]
    table = op13.words(frame(spark, rows), noise=None)
    groups, _ = op13._groups(table, 50)
    assert groups.groupBy("key").count().agg({"count": "max"}).first()[0] <= 50
    assert {(x.word, x.n_near) for x in op13.near(table, 50).collect()} == {(x[0], x[4]) for x in by_force(rows, noise=None)}
