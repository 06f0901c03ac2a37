"""Language by cross-parsing: suffix automata of labelled text tell how few phrases a text needs in each language.

A text is parsed greedily into the longest phrases that occur in a language's training text; the language that needs the
fewest bits (phrases times the bits that point at one in the training text) wins. The transitions of an automaton are a
table for the language's DENSE most frequent signs, and a sorted list for the others, so memory follows the training text
and not the size of the alphabet. A missing transition leads on from the start state with its sign turned, which ends a
phrase. All blocks of a batch of texts walk the automaton in step, one character at a time, so the work per character is
a few vector operations and long texts cost what their length says. Phrases end at block borders.

Letters are lower-cased, marks stay beside them; each run of other characters counts as one space. The score is the
winner's share when each language weighs 2 to the power of minus a tenth of its bits. A text is ``explained`` if the
winner's phrases, but for one, take fewer bits than spelling each character by an even choice among that language's
signs. Null texts and texts without a letter (marks are none) are ``und`` with score 0 and not explained, as is everything
if no language could be learnt. Ties go to the first language in alphabetical order. Repeated rows come out alike; an
empty table gives no rows; only text (and doc_id and lang, to learn from) is read.
"""

from __future__ import annotations

import sys
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import by_text
from inkweave.llm.training import held_out, sample

BLOCK = 512
DENSE = 64


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton by state: symbol -> next state; state 0 starts."""
    nexts: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        new = len(nexts)
        nexts.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(nexts)
                nexts.append(dict(nexts[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return nexts


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point its lower-case letter's code point, negative for marks, 0 for all else."""
    if not _LETTERS:
        points = np.zeros(sys.maxunicode + 1, dtype=np.int32)
        for p in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(p))[0]
            if kind == "L":
                low = chr(p).lower()
                points[p] = ord(low) if len(low) == 1 else p
            elif kind == "M":
                points[p] = -p
        _LETTERS.append(points)
    return _LETTERS[0]


def code_points(text: str) -> np.ndarray:
    return letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]


def squeezed(points: np.ndarray) -> np.ndarray:
    """Without spaces (0) that follow a space."""
    keep = points != 0
    keep[1:] |= points[:-1] != 0
    return points[keep]


@dataclass
class Automaton:
    """A language's automaton. A state is a number times the number of columns; columns are signs. Nothing goes on from the
    last state: it is where a block begins, and what a sign that the language doesn't have leads to."""

    signs: np.ndarray  # code points, sorted
    column: np.ndarray  # of each sign: below width in the table, else in the list
    width: int  # columns of the table; the last one stands for signs that the language doesn't have
    table: np.ndarray  # [state + column] -> state, negative where a phrase ended
    keys: np.ndarray  # sorted state * 2^32 + column of the transitions outside of the table
    goes: np.ndarray  # where they go
    begins: np.ndarray  # by column: the state after a phrase that starts with it
    bits: float  # of one phrase

    @staticmethod
    def of(points: np.ndarray) -> "Automaton":
        signs, coded, times = np.unique(points, return_inverse=True, return_counts=True)
        width = min(DENSE, len(signs)) + 1
        column = np.empty(len(signs), dtype=np.int64)
        column[np.argsort(-times, kind="stable")] = np.arange(len(signs))
        column[column >= width - 1] += 1
        states = suffix_automaton(column[coded].tolist())
        where = [(s + 1, c, to + 1) for s, row in enumerate(states) for c, to in row.items()]
        state, at, to = np.array(where, dtype=np.int64).reshape(-1, 3).T
        state, to = state * width, to * width
        begins = np.full(len(signs) + 1, (len(states) + 1) * width, dtype=np.int64)
        begins[at[state == width]] = to[state == width]
        table = np.tile(-begins[:width], len(states) + 2)
        dense = at < width
        table[state[dense] + at[dense]] = to[dense]
        keys, goes = (state << 32 | at)[~dense], to[~dense]
        order = np.argsort(keys)
        return Automaton(signs, column.astype(np.int32), width, table.astype(np.int32), keys[order], goes[order], begins, float(np.log2(len(points) + 1)))

    def columns(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.signs, points), len(self.signs) - 1)
        return np.where(self.signs[at] == points, self.column[at], np.int32(self.width - 1))

    def counted(self, flat: np.ndarray, starts: np.ndarray, active: list[int]) -> np.ndarray:
        """Phrases of each block of flat, signs as columns; blocks are sorted by size, active[j] have a character at j."""
        listed = bool((flat >= self.width).any())
        state = np.full(len(starts), len(self.table) - self.width, dtype=np.int32)
        count = np.zeros(len(starts), dtype=np.int32)
        for j, n in enumerate(active):
            here, now = flat[starts[:n] + j], state[:n]
            if listed and (far := np.flatnonzero(here >= self.width)).size:
                rare = here[far].astype(np.int64)
                to = self.table[now + np.minimum(here, self.width - 1)]
                key = now[far].astype(np.int64) << 32 | rare
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                to[far] = np.where(self.keys[at] == key, self.goes[at], -self.begins[rare])
            else:
                to = self.table[now + here]
            count[:n] += to < 0
            np.abs(to, out=now)
        return count


@dataclass
class LanguageModel:
    names: list[str]
    automata: list[Automaton]

    @property
    def signs(self) -> np.ndarray:
        """The signs of all languages, sorted."""
        return np.unique(np.concatenate([a.signs for a in self.automata]))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrases [text, language], number of characters, whether there is a letter, both by text)."""
        rows = [squeezed(code_points(t)) for t in texts]
        sizes = np.array([len(r) for r in rows], dtype=np.int64)
        lettered = np.array([bool((r > 0).any()) for r in rows], dtype=bool)
        out = np.zeros((len(texts), len(self.names)))
        if not sizes.sum():
            return out, sizes, lettered
        signs, coded = self.signs, np.abs(np.concatenate(rows))
        at = np.minimum(np.searchsorted(signs, coded), len(signs) - 1)
        at[signs[at] != coded] = len(signs)  # no language has it
        per = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), per)
        begin = (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)) * BLOCK
        starts, size = begin + np.repeat(np.cumsum(sizes) - sizes, per), np.minimum(BLOCK, sizes[owner] - begin)
        order = np.argsort(-size, kind="stable")
        size, starts, owner = size[order], starts[order], owner[order]
        active = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right").tolist()
        for k, automaton in enumerate(self.automata):
            columns = automaton.columns(np.append(signs, -1))
            out[:, k] = np.bincount(owner, weights=automaton.counted(columns[at], starts, active), minlength=len(texts))
        return out, sizes, lettered

    def predict(self, texts: list[str]) -> dict:
        """lang_pred, score and explained of each text."""
        if not self.names or not texts:
            return {"lang_pred": ["und"] * len(texts), "score": np.zeros(len(texts)), "explained": np.zeros(len(texts), dtype=bool)}
        phrases, sizes, lettered = self.phrases(texts)
        each = np.array([a.bits for a in self.automata])
        spelling = np.array([np.log2(len(a.signs) + 1) for a in self.automata])
        bits = phrases * each
        best = bits.argmin(axis=1)
        share = np.exp2(-0.1 * (bits - bits.min(axis=1, keepdims=True)))
        fewer = bits.min(axis=1) - each[best] < sizes * spelling[best]
        return {
            "lang_pred": [self.names[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)],
            "score": np.where(lettered, 1 / share.sum(axis=1), 0.0),
            "explained": lettered & fewer,
        }


def spread(texts: list[np.ndarray], most: int, cuts: int = 4) -> np.ndarray:
    """At most so many signs of texts, in equal shares; a text longer than its share gives pieces from all over it."""
    parts, left = [], most
    for k, text in enumerate(sorted(texts, key=len)):
        share = left // (len(texts) - k)
        left -= min(share, len(text))
        if len(text) <= share:
            parts.append(text)
        else:
            size = max(1, share // cuts)
            parts += [text[int(at) : int(at) + size] for at in np.linspace(0, len(text) - size, cuts)][: share // size]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)


def fit(rows: pd.DataFrame, chars: int = 30_000) -> LanguageModel:
    """rows (text, mark: the language), of which at most chars signs are learnt from for each language."""
    learnt: dict[str, Automaton] = {}
    for name, group in rows.groupby("mark"):
        points = squeezed(np.append(0, spread([squeezed(np.append(code_points(t), 0)) for t in group["text"]], chars)))
        if (points > 0).any():
            learnt[name] = Automaton.of(np.abs(points))
    return LanguageModel(sorted(learnt), [learnt[n] for n in sorted(learnt)])


def labeller(docs: DataFrame, docs_per_language: int = 60, chars: int = 30_000):
    """A column function text -> struct (lang_pred string, score double, explained boolean), learnt from docs (doc_id,
    text, lang). docs_per_language and chars bound what is learnt from each language."""
    rows, _ = sample(docs.select("doc_id", "text", F.col("lang").alias("mark")), docs.select("doc_id", F.col("lang").alias("mark")), docs_per_language, 8_000_000, ["doc_id", "mark"])
    model = docs.sparkSession.sparkContext.broadcast(fit(rows, chars))
    return by_text(lambda texts: model.value.predict(texts), "lang_pred string, score double, explained boolean", 4_000_000)


def predict(docs: DataFrame, **bounds: int) -> DataFrame:
    """(doc_id, held_out boolean, lang_pred string, score double, explained boolean) of every row of docs; bounds are those of labeller()."""
    found = labeller(docs, **bounds)("text").alias("out")
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), found).select("doc_id", "held_out", "out.*")
