"""op5's steps without Spark: small slices, lengthened prefixes, deceiving hashes."""

import random

import numpy as np
import pandas as pd
import pytest

from inkweave.llm import op5_repeats as op5
from tests.llm.helpers import frame, prose
from tests.llm.test_duplicates import corpus, removed


def by_hand(texts: dict, tasks: int = 3) -> tuple[dict, pd.DataFrame]:
    """What remove() does, with lists in place of shuffles: (texts as removed() gives them, rows by place)."""
    rows = pd.DataFrame({"id": list(texts), "key": [hash(i) * 31 + 7 for i in texts], "text": [t or "" for t in texts.values()]})
    parts = [rows.iloc[k::tasks] for k in range(tasks)]

    def shuffled(frames, *order):
        every = pd.concat(list(frames), ignore_index=True)
        whole = every.sort_values(list(order), kind="stable", ignore_index=True)
        # batches that cut groups apart
        return [whole.iloc[k : k + 7] for k in range(0, len(whole), 7)]

    repeated = pd.concat(op5._repeated(iter(shuffled((f for p in parts for f in op5._marked(iter([p]))), "place", "prefix"))), ignore_index=True)
    large = set(repeated.loc[repeated["size"] > 0, "prefix"])
    asked = repeated[repeated["size"] == 0].groupby(["id", "key"])["prefix"].agg(lambda p: [{"prefix": x, "large": int(x in large)} for x in set(p)])
    joined = [p.merge(asked.rename("prefixes").reset_index(), on=["id", "key"]) for p in parts]
    leaves = shuffled((f for p in joined if len(p) for f in op5._leaves(iter([p]))), "place", "id", "start")
    gone = pd.concat(op5._nodes(iter(leaves)), ignore_index=True)
    runs = {i: g[["start", "n"]].to_dict("records") for i, g in gone.groupby("id")}
    out = op5.cut(rows["text"], pd.Series([runs.get(i) for i in rows["id"]]))
    return {i: (a, b, c) for i, a, b, c in zip(rows["id"], out["n_words"], out["n_removed"], out["kept"], strict=True)}, pd.concat(leaves)


@pytest.mark.parametrize("group", [100_000, 40, 3])
@pytest.mark.parametrize("size", [3_000_000, 900])
def test_parts_against_brute_force(monkeypatch, group, size):
    monkeypatch.setattr(op5, "GROUP", group)
    monkeypatch.setattr(op5, "SLICE", size)
    texts = corpus(70)
    out, _ = by_hand(texts)
    assert out == removed(texts)


def test_a_prefix_of_a_third_of_all_suffixes_is_spread(monkeypatch):
    """Five words that recur with ever different words behind them make one prefix, which is lengthened."""
    monkeypatch.setattr(op5, "GROUP", 200)
    monkeypatch.setattr(op5, "SLICE", 4000)
    r = random.Random(4)
    texts = {}
    for k in range(60):
        w = []
        for _ in range(12):
            w += ["the", "same", "five", "words", "always", *prose(r.randrange(30), 16).split()]
        texts[k] = " ".join(w)
    out, leaves = by_hand(texts)
    assert out == removed(texts)
    rows = leaves[leaves["words"].notna()]
    assert rows.groupby("place").size().max() < len(rows) / 10


def test_equal_hashes_of_different_windows_do_no_harm(monkeypatch):
    """Every window gets the same path hash: the words still decide."""
    made = op5.Suffixes.__init__

    def deceived(self, f):
        made(self, f)
        self.path = np.zeros_like(self.path)

    monkeypatch.setattr(op5.Suffixes, "__init__", deceived)
    texts = corpus(40)
    out, _ = by_hand(texts)
    assert out == removed(texts)


def test_deep_nodes_name_equal_windows():
    r = np.random.RandomState(1)
    codes = np.concatenate([r.randint(0, 3, 300), np.arange(40) % 5, np.arange(40) % 5])
    names = op5._deep_nodes(codes)
    n = len(codes) - op5.WINDOW + 1
    by = {}
    for k in range(n):
        assert by.setdefault(tuple(codes[k : k + op5.WINDOW]), names[k]) == names[k]
    assert len(set(by.values())) == len(by)


@pytest.mark.parametrize("one", [None, 5])
def test_very_many_rows_of_one_id_and_text_can_be_split(spark, one):
    long = prose(3, 60)
    rows = [(one, long, "en", "s", 1)] * 400 + [(k, prose(k, 30) + " " + long + " end", "en", "s", 1) for k in (1, 9)]
    out = op5.remove(frame(spark, rows), ["lang"])
    got = {(r.doc_id, r.n_words, r.n_removed) for r in out.collect()}
    # the first document keeps the passage with the word behind it, all others lose what they have of it
    assert out.count() == 402 and got == {(1, 91, 0), (one, 60, 60), (9, 91, 61)}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" not in plan.split("MapInPandas")[0], "the texts are dealt by the join, whose skew can be split"
