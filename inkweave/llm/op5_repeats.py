"""Removal of repeated passages by prefix-partitioned suffix trees over words, cut at the depth that matters.

A window of WINDOW words that also starts earlier (at a smaller doc_id, or before in the same document) is a leaf below
an internal node of the corpus' word suffix tree that is WINDOW words deep. The tree is built by parts:

* Sampling: in each window the smallest hash among its runs of PREFIX words marks one suffix, the leftmost on a tie. Equal
  windows mark the same place, so a repeated window hangs at suffixes that start with the same PREFIX words, and about one
  suffix in eight is enough to find all of them. A marked suffix keeps the words of the windows that marked it.
* Partitioning: suffixes are dealt by their first PREFIX words. A prefix that occurs once in the corpus can't hold a
  repeat, and its suffixes go no further. The others are counted, by the different windows that hang at them: a prefix
  with more than GROUP of them is lengthened to the whole window, which deals its suffixes anew. So prefixes are of
  variable length, each group fits a task's memory, and a prefix that a third of all suffixes share is spread.
* Subtrees: a task builds the tree of its groups from the words themselves, by levels: the nodes at depth 1, 2, 4, 8, 16 and
  WINDOW, each named by two nodes of the level before. Of a node at depth WINDOW with several leaves, all leaves but the
  earliest are repeats; neighbouring ones merge into maximal repeats, and every word that one covers is removed.

Hashes only deal and select; that windows are equal is decided on their words. Tasks look for repeats among their own
documents first, and hand on one leaf of each node: a passage that stands in a third of all documents is one leaf for each
slice of a few thousand documents. Windows are always judged on the input.

Words are runs without white space, unchanged. Null texts have none. Windows at the same start of rows with the same
doc_id aren't earlier than each other, so repeated rows keep their words; a null doc_id comes after all others. A row loses
words by its own windows only: rows that share an id, or have none, are told apart by a 64-bit hash of their text. Texts
shorter than WINDOW words lose nothing. An empty table gives no rows. Only doc_id, text and the columns to carry are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import growing, slices, written
from inkweave.llm.words import coded_words, hashes_of, mixed, windows, words_of

WINDOW, PREFIX = 20, 5
LAST = 2**63 - 1  # where a null id stands in the order
SLICE = 3_000_000
GROUP = 100_000


def _first(*sorted_keys: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before in any of the keys."""
    new = np.ones(len(sorted_keys[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])
    return new


class Suffixes:
    """The windows of a slice of texts as flat arrays, each with the suffix that it marks."""

    def __init__(self, f: pd.DataFrame):
        self.words, self.codes, distinct, counts = coded_words([words_of(t) for t in f["text"]])
        per_text = np.maximum(0, counts - WINDOW + 1)
        owner = np.repeat(np.arange(len(counts)), per_text)
        #: start of each window in its text, and in the flat words
        self.inside = np.arange(len(owner)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        self.at = (np.cumsum(counts) - counts)[owner] + self.inside
        self.id, self.key = f["id"].to_numpy()[owner], f["key"].to_numpy()[owner]
        if not len(owner):
            self.mark = self.prefix = np.zeros(0, dtype=np.int64)
            self.path = np.zeros(0, dtype=np.uint64)
            return
        runs = windows(hashes_of(distinct)[self.codes], PREFIX)
        least = np.lib.stride_tricks.sliding_window_view(runs, WINDOW - PREFIX + 1)
        self.mark = self.at + least[self.at].argmin(axis=1)
        self.prefix = runs[self.mark].view(np.int64)
        path = np.zeros(len(owner), dtype=np.uint64)
        for k in range(WINDOW // PREFIX):
            path += mixed(runs[self.at + k * PREFIX] + np.uint64(0x9E3779B97F4A7C15 * (k + 1) % 2**64))
        self.path = mixed(path)

    def same_words(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the windows a and b are equal, word by word."""
        same = np.ones(len(a), dtype=bool)
        for k in range(WINDOW):
            same &= self.codes[self.at[a] + k] == self.codes[self.at[b] + k]
        return same


def _runs(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> pd.DataFrame:
    """Windows (id, key, start) as runs (id, key, start, n)."""
    order = np.lexsort((starts, keys, ids))
    ids, keys, starts = ids[order], keys[order], starts[order]
    new = _first(ids, keys)
    new[1:] |= starts[1:] != starts[:-1] + 1
    at = np.flatnonzero(new)
    return pd.DataFrame({"id": ids[at], "key": keys[at], "start": starts[at].astype(np.int32), "n": np.diff(np.append(at, len(ids))).astype(np.int32)})


def _marked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(place, id, key, prefix, once, known, size): each prefix of the slice with the number of different windows at it, and
    with its row if that is the only one; and, as known, the rows of prefixes that stand in several rows or places."""
    for f in slices(frames, SLICE):
        s = Suffixes(f)
        one = _first(s.mark)
        at = np.flatnonzero(one)
        size = np.diff(np.append(at, len(one)))
        order = np.lexsort((s.key[at], s.id[at], s.prefix[at]))
        at, size = at[order], size[order]
        prefix = s.prefix[at]
        first = np.flatnonzero(_first(prefix))
        times = np.diff(np.append(first, len(prefix)))
        often = np.repeat(times, times) > 1
        # different windows at each prefix; where it occurs once, all are different
        sizes = np.add.reduceat(size, first) if len(first) else size
        inside = np.flatnonzero(np.isin(s.prefix, prefix[first[times > 1]]))
        pairs = np.lexsort((s.path[inside], s.prefix[inside]))
        different = _first(s.prefix[inside][pairs], s.path[inside][pairs])
        sizes[times > 1] = np.unique(s.prefix[inside][pairs][different], return_counts=True)[1]
        known = pd.DataFrame({"id": s.id[at[often]], "key": s.key[at[often]], "prefix": prefix[often]}).drop_duplicates()
        yield pd.DataFrame(
            {
                "place": np.concatenate([prefix[first], mixed(known["key"].to_numpy().view(np.uint64)).view(np.int64)]),
                "id": np.concatenate([s.id[at[first]], known["id"]]),
                "key": np.concatenate([s.key[at[first]], known["key"]]),
                "prefix": np.concatenate([prefix[first], known["prefix"]]),
                "once": np.concatenate([times == 1, np.zeros(len(known), dtype=bool)]),
                "known": np.concatenate([np.zeros(len(first), dtype=bool), np.ones(len(known), dtype=bool)]),
                "size": np.concatenate([sizes, np.zeros(len(known), dtype=np.int64)]),
            }
        )


def _repeated(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, key, prefix, size 0) of rows whose prefix occurs again, and (0, 0, prefix, size) of prefixes with more than
    GROUP windows; the rows come sorted by place."""
    held = None

    def done(f: pd.DataFrame, prefix: np.ndarray, first: np.ndarray) -> Iterator[pd.DataFrame]:
        times, size = np.diff(np.append(first, len(f))), np.add.reduceat(f["size"].to_numpy(), first)
        out = (np.repeat(times, times) > 1) | f["again"].to_numpy()
        yield f.loc[out & f["once"].to_numpy(), ["id", "key", "prefix"]].assign(size=0)
        large = first[size > GROUP]
        yield pd.DataFrame({"id": 0, "key": 0, "prefix": prefix[large], "size": size[size > GROUP]})

    for f in frames:
        known = f["known"].to_numpy()
        yield f.loc[known, ["id", "key", "prefix"]].assign(size=0)
        f = f.loc[~known, ["id", "key", "prefix", "once", "size"]].assign(again=False)
        if held is not None:
            f = pd.concat([held, f], ignore_index=True)
        if not len(f):
            continue
        prefix = f["prefix"].to_numpy()
        first = np.flatnonzero(_first(prefix))
        last = first[-1]
        if last:
            yield from done(f.iloc[:last], prefix[:last], first[:-1])
        held = f.iloc[last:]
        if len(held) > 1:
            # the rest of this prefix is still to come: what is known of it goes on as one row
            yield held.loc[held["once"], ["id", "key", "prefix"]].assign(size=0)
            held = held.iloc[:1].assign(once=False, again=True, size=held["size"].sum())
    if held is not None and len(held):
        yield from done(held, held["prefix"].to_numpy(), np.zeros(1, dtype=np.int64))


LEAVES = "place long, id long, key long, start int, n int, leaves int, words binary"


def _leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each node of a slice the earliest leaf, by marked suffix: the words of its windows, and a bit for each window that
    is a leaf; without words, runs of windows that repeat an earlier one of the slice."""
    for f in slices(frames, SLICE):
        s = Suffixes(f)
        wanted = np.array([(x["prefix"], x["large"]) for p in f["prefixes"] for x in p], dtype=np.int64).reshape(-1, 2)
        some = np.flatnonzero(np.isin(s.prefix, wanted[:, 0]))
        order = some[np.lexsort((s.inside[some], s.id[some], s.path[some]))]
        new = _first(s.path[order])
        head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        same = s.same_words(order, head)  # a leaf whose hash deceives stays one of its own
        gone = order[same & ((s.id[order] != s.id[head]) | (s.inside[order] != s.inside[head]))]
        known = _runs(s.id[gone], s.key[gone], s.inside[gone])
        known["place"], known["leaves"], known["words"] = mixed(known["key"].to_numpy().view(np.uint64)).view(np.int64), 0, None
        yield known[["place", "id", "key", "start", "n", "leaves", "words"]]
        leaf = np.zeros(len(s.mark), dtype=bool)
        leaf[order[new | ~same]] = True
        at = np.flatnonzero(leaf)
        large = np.isin(s.prefix[at], wanted[wanted[:, 1] == 1, 0])
        first = np.flatnonzero(_first(s.mark[at]) | large)  # windows at a lengthened prefix go by themselves
        begin, end = at[first], at[np.append(first[1:], len(at)) - 1] + 1 if len(at) else at
        bits = np.add.reduceat(1 << (at - np.repeat(begin, np.diff(np.append(first, len(at))))), first) if len(at) else at
        words = s.words
        for few in range(0, len(begin), 20_000):
            b, e, part = begin[few : few + 20_000], end[few : few + 20_000], slice(few, few + 20_000)
            yield pd.DataFrame(
                {
                    "place": np.where(large[first[part]], s.path[b].view(np.int64), s.prefix[b]),
                    "id": s.id[b], "key": s.key[b], "start": s.inside[b].astype(np.int32), "n": (e - b).astype(np.int32), "leaves": bits[part].astype(np.int32),
                    "words": [b" ".join(words[i:j]) for i, j in zip(s.at[b].tolist(), (s.at[e - 1] + WINDOW).tolist(), strict=True)],
                }
            )


def _deep_nodes(codes: np.ndarray) -> np.ndarray:
    """By position, the name of the tree's node at depth WINDOW on the path of the words from there."""

    def below(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return pd.factorize(a * np.int64(len(codes) + 1) + b)[0].astype(np.int64)

    def ahead(x: np.ndarray, by: int) -> np.ndarray:
        return np.append(x[by:], np.full(min(by, len(x)), len(codes)))

    levels = [codes.astype(np.int64)]
    while 2 ** len(levels) <= WINDOW:
        levels.append(below(levels[-1], ahead(levels[-1], 2 ** (len(levels) - 1))))
    name, depth = levels[-1], 2 ** (len(levels) - 1)
    for k in range(len(levels) - 2, -1, -1):
        if depth + 2**k <= WINDOW:
            name, depth = below(name, ahead(levels[k], depth)), depth + 2**k
    return name


def _subtrees(f: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
    """(runs of windows that aren't the earliest leaf of their node, bits of those that are by row) of whole groups."""
    _, codes, _, counts = coded_words([w.split(b" ") for w in f["words"]])
    bit = f["leaves"].to_numpy()[:, None] >> np.arange(WINDOW) & 1
    row, j = np.nonzero(bit)
    node = _deep_nodes(codes)[(np.cumsum(counts) - counts)[row] + j]
    ids, start = f["id"].to_numpy()[row], f["start"].to_numpy()[row] + j
    order = np.lexsort((start, ids, node))
    new = _first(node[order])
    head = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    later = np.zeros(len(row), dtype=bool)
    later[order] = (ids[order] != ids[head]) | (start[order] != start[head])
    kept = np.zeros(len(f), dtype=np.int64)
    np.add.at(kept, row[order[new]], 1 << j[order[new]])
    return _runs(ids[later], f["key"].to_numpy()[row[later]], start[later]), kept


def _nodes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, key, start, n): runs of windows that aren't the earliest leaf of their node; rows come sorted by place, id, start."""
    held = None
    for f in frames:
        known = f["words"].isna().to_numpy()
        yield f.loc[known, ["id", "key", "start", "n"]]
        f = f[~known]
        if held is not None:
            f = pd.concat([held, f], ignore_index=True)
        if not len(f):
            continue
        last = np.flatnonzero(_first(f["place"].to_numpy()))[-1]
        if last:
            yield _subtrees(f.iloc[:last])[0]
        held = f.iloc[last:]
        if len(held) > GROUP:
            # more rows than windows: a passage of very many slices, of which the earliest leaf goes on
            runs, leaves = _subtrees(held)
            yield runs
            held = held.assign(leaves=leaves.astype(np.int32))[leaves > 0]
    if held is not None and len(held):
        yield _subtrees(held)[0]


def cut(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
    """(n_words, n_removed, kept) of each text without the words that the runs of windows cover."""
    n_words, n_removed, kept = [], [], []
    for text_, runs_ in zip(text, runs, strict=True):
        words = words_of(text_)
        covered = np.zeros(len(words) + 1, dtype=np.int32)
        for r in runs_ if runs_ is not None else ():
            covered[r["start"]] += 1
            covered[r["start"] + r["n"] + WINDOW - 1] -= 1
        stay = np.cumsum(covered[:-1]) == 0
        n_words.append(len(words))
        n_removed.append(len(words) - int(stay.sum()))
        kept.append(b" ".join(w for w, s in zip(words, stay.tolist(), strict=True) if s).decode("utf-8", "surrogatepass"))
    return pd.DataFrame({"n_words": n_words, "n_removed": n_removed, "kept": kept})


def remove(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed long, kept string: the kept words joined by one space) of every row of docs.

    The columns named in carry follow, as they are.
    """
    names = {f"carried_{k}": name for k, name in enumerate(["doc_id", *(carry or [])])}
    rows = docs.select(
        F.coalesce("doc_id", F.lit(LAST)).alias("id"), F.xxhash64("doc_id", "text").alias("key"), F.coalesce("text", F.lit("")).alias("text"), *[F.col(f"`{old}`").alias(new) for new, old in names.items()]
    )
    marked = rows.select("id", "key", "text").mapInPandas(_marked, "place long, id long, key long, prefix long, once boolean, known boolean, size long")
    repeated = marked.repartition("place").sortWithinPartitions("place", "prefix").mapInPandas(_repeated, "id long, key long, prefix long, size long")
    repeated = written(repeated, "op5-repeated")
    large = repeated.filter("size > 0").select("prefix", F.lit(1).alias("large"))
    prefixes = repeated.filter("size = 0").join(large, "prefix", "left").groupBy("id", "key").agg(F.collect_set(F.struct("prefix", F.coalesce("large", F.lit(0)).alias("large"))).alias("prefixes"))
    # both joins read one exchange of the rows with all their columns; it is the joins' own, so that adaptive execution may
    # split very many rows of one id and text
    leaves = rows.join(growing(prefixes), ["id", "key"]).mapInPandas(_leaves, LEAVES)
    gone = leaves.repartition("place").sortWithinPartitions("place", "id", "start").mapInPandas(_nodes, "id long, key long, start int, n int")
    runs = gone.groupBy("id", "key").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    shorten = F.pandas_udf(cut, "n_words long, n_removed long, kept string")
    out = rows.join(growing(runs), ["id", "key"], "left").select("*", shorten("text", "runs").alias("out"))
    doc_id, *others = [F.col(new).alias(old) for new, old in names.items()]
    return out.select(doc_id, "out.*", *others)
