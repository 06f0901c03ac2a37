"""Spelling variants: for each word, the words that differ from it by one code point, and the frequent form it leads to.

A word at one error from w agrees with it on one half at least: on the first, and the error is in the second, or the other
way round. So each word asks twice: in its own spelling, keyed by its first half, and reversed, keyed by its second half
read from the end. Words of one code point more or less have halves of other lengths, so each word is also told to the keys
of the askers that it could be near to: two keys a direction.

Groups of a key go to tasks in whole. A task gathers some groups, builds the minimal acyclic automaton of their words (the
forward one of spellings and the backward one of reversed spellings lie in one automaton under two first letters) and
numbers the words by the automaton itself: each transition knows how many words come before it, so the sum along a path is
the word's place in order, which is where its frequency stands. Each asker walks its half exactly and completes the rest
with one error. What both directions find (an error at the seam, or in a run of one letter over it) counts in the first.

A key with more than GROUP words, such as a prefix of a third of all words, is split: an asker's error lies in the first or
the second half of what is left, so it asks twice more, with a longer agreement each. This is repeated until no key is too
large; with one code point left a key has 8,191 words at most. The result is the same whatever GROUP is.

Words come from maximal runs of letters; a stated hash of id and run deletes one code point of some runs (the fixed noise of
the contract, off with ``noise=None``). A null text has no words, a null id counts as the empty text, repeated rows count each time, an
empty table gives none. Very long runs are words like any others: automata are walked step by step, without recursion.
Columns of documents other than doc_id and text aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import discard, growing, slices, written

#: Letters of words: A to Z and a to z, and the code points from U+00C0 to U+00FF.
LETTERS = "A-Za-zÀ-ÿ"
#: Words that a key has at most before it is split, and rows that a task gathers for one automaton.
GROUP, CHUNK = 20_000, 20_000


def words(docs: DataFrame, shortest: int = 7, least: int = 2, noise: int | None = 31) -> DataFrame:
    """(word, n long) of the words of at least ``shortest`` code points and ``least`` occurrences."""
    find = re.compile(f"[{LETTERS}]{{{max(1, shortest)},}}").findall

    def run(frames: Iterator[pd.DataFrame]):
        for f in slices(frames):
            counts: Counter = Counter()
            for doc_id, text in zip(f.doc_id, f.text, strict=True):
                # bytes are lowered in A to Z alone
                runs = Counter(find((text or "").encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
                if noise:
                    begin = zlib.crc32(f"{doc_id or ''}:".encode())
                    for word in [w for w in runs if zlib.crc32(w.encode(), begin) % noise == 0]:
                        n, at = runs.pop(word), zlib.crc32(word.encode(), begin) % len(word)
                        cut = word[:at] + word[at + 1 :]
                        if len(cut) >= shortest:
                            counts[cut] += n  # not a run of this text, so it isn't deleted from again
                counts.update(runs)
            if counts:
                yield pd.DataFrame({"word": list(counts), "n": np.fromiter(counts.values(), dtype=np.int64, count=len(counts))})

    found = docs.select(F.col("doc_id").cast("string"), "text").mapInPandas(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def _first(table: DataFrame) -> DataFrame:
    """(side, form, n, size, asker, s, t, x) for each word, direction and length of askers that it could be near to.

    form is the word or the reversed word; an asker agrees with it up to s and from t on, counted in the asker's length, and
    leaves to others what begins with the asker's first x code points (0: nothing is left).
    """
    m = F.length("word")
    sides = F.explode(F.array(F.lit("f"), F.lit("b"))).alias("side")
    rows = table.select("word", "n", m.alias("size"), sides).withColumn("form", F.when(F.col("side") == "f", F.col("word")).otherwise(F.reverse("word"))).drop("word")
    rows = rows.withColumn("asker", F.explode(F.array(*[(F.col("size") + k).cast("int") for k in (-1, 0, 1)])))
    half = F.when(F.col("side") == "f", F.floor(F.col("asker") / 2)).otherwise(F.ceil(F.col("asker") / 2)).cast("int")
    return rows.select("side", "form", "n", "size", "asker", half.alias("s"), F.col("asker").alias("t"), F.lit(0).alias("x"))


def _key(level: int) -> Column:
    """A hash of what askers and words of a group share; a collision joins two groups, which changes nothing."""
    before = F.substring("form", 1, F.col("s"))
    behind = F.expr("right(form, asker - t)")
    return F.xxhash64("side", before, behind, F.lit(level), F.lit(0) if level == 0 else F.col("t") - F.col("s"))


def _halved(rows: DataFrame) -> DataFrame:
    """Each row as two: the error in the second half of what was left, then in the first."""
    middle = F.col("s") + F.floor((F.col("t") - F.col("s")) / 2).cast("int")
    cut = F.explode(F.array(F.struct(middle.alias("s"), F.col("t").alias("t"), F.col("x").alias("x")), F.struct(F.col("s").alias("s"), middle.alias("t"), middle.alias("x")))).alias("part")
    return rows.select("side", "form", "n", "size", "asker", cut).select("side", "form", "n", "size", "asker", "part.s", "part.t", "part.x")


def _groups(table: DataFrame, group: int) -> tuple[DataFrame, list[DataFrame]]:
    """(key, form, n, size, s, t, x) of all groups, with s = -1 for words that don't ask there; tables to discard."""
    rows, level, done, kept = _first(table), 0, None, []
    while True:
        # a word that is too short for the agreement of an asker isn't near to it
        rows = rows.filter(F.col("s") + F.col("asker") - F.col("t") <= F.col("size")).withColumn("key", _key(level))
        asks = F.col("asker") == F.col("size")
        if level:
            twice = F.lit(False)
        else:
            # askers of two lengths share a key: of the askers of one length more and less, the word's own length has the
            # half of the one if it is even and of the other if it is odd, and the other way round from the end
            even, longer = F.pmod("size", F.lit(2)) == 0, F.col("asker") > F.col("size")
            twice = ~asks & ((even == longer) == (F.col("side") == "f"))
        # one code point is left: never split
        last = F.col("t") - F.col("s") <= 1
        large = written(rows.filter(~twice & ~last).groupBy("key").agg(F.count("*").alias("words")).filter(F.col("words") > group).select("key", F.lit(True).alias("large")), "variants-large")
        kept.append(large)
        more = large.limit(1).count() > 0
        if more:
            rows = rows.join(growing(large), "key", "left")
            small = rows.filter(F.when(F.col("large"), last).otherwise(~twice))
        else:
            small = rows.filter(~twice)
        part = small.select("key", F.concat("side", "form").alias("form"), "n", F.when(asks, F.col("s") + 1).otherwise(-1).alias("s"), (F.col("t") + 1).alias("t"), F.when(F.col("x") > 0, F.col("x") + 1).otherwise(0).alias("x"))
        done = part if done is None else done.unionByName(part)
        if not more:
            return done, kept
        rows = written(_halved(rows.filter(F.col("large") & ~last)), "variants-split")
        kept.append(rows)
        level += 1


class Automaton:
    """The minimal acyclic automaton of sorted distinct words. A word's number is its place among them."""

    def __init__(self, words: list[str]):
        #: state -> letter -> (next state, words that come before those behind this transition)
        self.next: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self._size: list[int] = []
        register: dict[tuple, int] = {}
        path: list[list] = [[False, []]]  # the states of the last word that may still change: (final, transitions)
        before = ""

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                final, out = path.pop()
                key = (final, *out)
                state = register.get(key)
                if state is None:
                    state = register[key] = self._add(final, out)
                path[-1][1].append((before[len(path) - 1], state))

        for word in words:
            same, most = 0, min(len(before), len(word))
            while same < most and before[same] == word[same]:
                same += 1
            close(same)
            path += [[False, []] for _ in range(len(word) - same)]
            path[-1][0] = True
            before = word
        close(0)
        self.root = self._add(*path[0])

    def _add(self, final: bool, out: list[tuple[str, int]]) -> int:
        so_far, moves = int(final), {}
        for letter, to in out:
            moves[letter] = to, so_far
            so_far += self._size[to]
        self.next.append(moves)
        self.final.append(final)
        self._size.append(so_far)
        return len(self.next) - 1

    def _rest(self, state: int, number: int, rest: str) -> int:
        """The number of the word that goes on with rest from a state, or -1."""
        following = self.next
        for letter in rest:
            move = following[state].get(letter)
            if move is None:
                return -1
            state, add = move
            number += add
        return number if self.final[state] else -1

    def near(self, word: str, s: int, t: int) -> set[int]:
        """Numbers of the words at one error from word, the error lying between its places s and t."""
        following, found = self.next, set()
        state, number, rest = self.root, 0, self._rest
        for at in range(t + 1):
            if at >= s:
                behind = word[at + 1 :]
                if at < t:
                    found.add(rest(state, number, behind))
                for letter, (to, add) in following[state].items():
                    moves = following[to]
                    if at < t and letter != word[at] and (not behind or behind[0] in moves):
                        found.add(rest(to, number + add, behind))
                    if at == len(word) or word[at] in moves:
                        found.add(rest(to, number + add, word[at:]))
            if at == len(word):
                break
            move = following[state].get(word[at])
            if move is None:
                break
            state, number = move[0], number + move[1]
        found.discard(-1)
        return found


def _gathered(frames: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """Sorted rows in runs of whole groups, of about so many rows."""
    held, size = [], 0
    for f in frames:
        held.append(f)
        size += len(f)
        if size >= rows:
            f = pd.concat(held, ignore_index=True)
            keys = f.key.to_numpy()
            end = int(np.searchsorted(keys, keys[-1]))
            if end:
                yield f.iloc[:end]
                f = f.iloc[end:]
            held, size = [f], len(f)
    if size:
        yield pd.concat(held, ignore_index=True)


def _compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in _gathered(frames, CHUNK):
        times = dict(zip(f.form, f.n, strict=True))
        forms = sorted(times)
        automaton = Automaton(forms)
        asking = f[f.s >= 0]
        out = []
        for form, s, t, x in zip(asking.form, asking.s.tolist(), asking.t.tolist(), asking.x.tolist(), strict=True):
            found = [forms[k] for k in automaton.near(form, s, t)]
            back = form[0] == "b"
            if x:
                found = [y for y in found if not y.startswith(form[:x])]
            if back:
                # what agrees on the first half of the word is found in the other direction
                first = form[len(form) - (len(form) - 1) // 2 :]
                found = [y for y in found if not y.endswith(first)]
            near = [(-times[y], y[:0:-1] if back else y[1:]) for y in found]
            if near or not back:
                n, best = min(near, default=(0, None))
                out.append((form[:0:-1] if back else form[1:], times[form], len(near), -n, best))
        if out:
            yield pd.DataFrame(out, columns=["word", "n", "n_near", "best_n", "best"])


def near(table: DataFrame, group: int | None = None) -> DataFrame:
    """(word, n, n_near, best, best_n) of every word of table (word, n): how many words are near, and the most frequent of
    them (ties: the smallest), null if there are none."""
    rows, kept = _groups(table, group or GROUP)
    dealt = rows.repartition("key").sortWithinPartitions("key")
    found = written(dealt.mapInPandas(_compared, "word string, n long, n_near long, best_n long, best string"), "variants-near")
    discard(*kept)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))))
    out = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("b"))
    return out.select("word", "n", "n_near", F.col("b.w").alias("best"), (-F.col("b.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms (word, form not null): the end of the chain of forms, by doubling the steps.

    A form is more frequent than its word by a factor, so chains end, and their length is a logarithm of the largest count.
    """
    steps = written(forms.select("word", F.col("form").alias("root")), "variants-steps")
    while True:
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("on"))
        more = written(steps.join(growing(on), "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "variants-steps")
        discard(steps)
        steps = more
        if not steps.filter("moved").limit(1).count():
            return steps.select("word", "root")


def group(docs: DataFrame, shortest: int = 7, least: int = 2, factor: int = 10, noise: int | None = 31) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs (doc_id, text)."""
    if factor < 2:
        raise ValueError("a form is at least twice as frequent as its word")
    table = written(words(docs, shortest, least, noise), "variants-words")
    found = near(table)
    leads = F.col("best_n") >= factor * F.col("n")
    formed = written(found.select("word", F.when(leads, F.col("best")).alias("form"), "n", "n_near", F.when(leads, F.col("best_n")).alias("form_n")), "variants-forms")
    ends = roots(formed.filter(F.col("form").isNotNull()))
    out = formed.join(growing(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    result = written(out, "variants")
    discard(table, formed, ends)
    return result
