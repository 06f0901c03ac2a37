"""Toxicity behind disguises: a noisy channel restores obfuscated words, then the restored text is scored.

A word is suspicious if it mixes letters with digits or signs, holds separators between single letters, or repeats a
letter three times or more; so is a run of three or more words of one letter, or of one sign or digit of LEET beside
two letters or more. Words of any length are restored, in time that follows their length, and teach the letter model. A suspicious word becomes a lattice: a sign
or digit stands for the letters that it is written for, for itself or for nothing; a separator for nothing; a star for
nothing or one of the LIKELY likeliest letters behind the two before it; a repeated letter for one or two copies. The
search keeps the STATES cheapest states (two letters each) at a place, so a word of stars alone costs no more a place. A Viterbi search under a character trigram model of labelled training words, toxic ones
among them, finds the likeliest word. The channel's costs are CHANNEL. A word of letters and stars that fits a word of the score's own is that word.

The words of the restored text, and their beginnings of BEGINNINGS letters, are looked up among those that training
rows of the two classes show to differ; a logistic model over their presence, with the text's length, gives the score.

All labelled rows outside the held-out fold are learnt from, and all of each text: Spark counts words, beginnings and
letters over them, and each step of the logistic regression sums its derivatives over all of them. What reaches the driver
and the tasks is the model: MOST_FEATURES features, and the LETTERS most frequent letters behind a context, with exact
counts and totals.

All of a text is read. Null and empty texts take the model's value for no evidence. Without labelled rows of both
classes, or if no word tells them apart, every score is the share of toxic rows (0 without any); a word counts if three
toxic rows hold it (all of them, where there are fewer). Repeated rows score alike; an empty table gives no rows;
other columns aren't read. Labels only teach; language, source and id are never inputs of a score.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.llm.common import by_text, discard, slices, written
from inkweave.llm.training import class_weights, held_out, logistic, logistic_over, sample, sigmoid  # noqa: F401

#: The letters that digits and signs are written for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "(": "c", "#": "h"}
#: Cost of each channel step, as a negative natural logarithm.
CHANNEL = {"letter for a sign": 0.7, "sign kept": 9.0, "nothing for a sign": 2.5, "nothing for a digit": 7.0, "nothing for a separator": 0.1, "double letter": 1.5, "nothing for a star": 1.5, "any letter for a star": 0.5}
#: A star's letters: so many of the likeliest behind what was written. States that are kept at each place: the cheapest.
LIKELY, STATES = 8, 48
#: Size of the model: features, and pairs of a context and a letter.
MOST_FEATURES, LETTERS = 300, 300_000
BEGINNINGS = range(4, 9)
SHORTEST = BEGINNINGS[0]
SEPARATORS = ".-_*~·'`,:/\\"

FRONT, BACK = re.compile(r"[^\w@$€]*"), re.compile(r"[^\w@$€!+|]*")
MASKED = re.compile(r"[^\W\d_][^\w\s]*[\d@$!|+€(#]|\d[^\w\s]*[^\W\d_]|(?<![^\w\s])(?=[^\w\s]*+[^\W\d_])[^\w\s]*[@$!|+€(#]|[^\W\d_][.\-_*~·'`:/\\]+[^\W\d_]|([^\W\d_])\1\1")
#: All that is MASKED in a word of letters alone.
TRIPLE = re.compile(r"(.)\1\1")
RUN = re.compile(r"(.)\1{3,}")
SPACED = re.compile(r"(?<!\S)[^\W\d_](?:\s[^\W\d_]){2,}(?!\S)")
#: The same with signs and digits beside letters.
SPACED_LEET = re.compile(r"(?<!\S)(?:[^\W\d_]|[0-9@$!|+€(#])(?:\s(?:[^\W\d_]|[0-9@$!|+€(#])){2,}(?!\S)")


def bared(word: str) -> str:
    """The word without signs at its edges."""
    if word.isalnum():
        return word
    word = word[FRONT.match(word).end() :]
    return word[: len(word) - BACK.match(word[::-1]).end()]


def hides(run: str) -> bool:
    """Whether a run of one-letter words, signs and digits may hide a word."""
    return sum(map(str.isalpha, run)) > 1


def spaced(text: str) -> list[str]:
    """Runs of one-letter words that may hide a word, by letters alone and with signs and digits."""
    wide = [m for m in SPACED_LEET.findall(text) if hides(m)]
    return SPACED.findall(text) + [m for m in wide if not SPACED.fullmatch(m)] if wide else []


def names_of(word: str, names: Container[str] | None = None, heads: Container[str] = ()) -> list[str]:
    """The names that a word shows: itself and its beginnings; or those of them among names, heads being the first letters of
    all beginnings there."""
    if names is None:
        return [word, *(word[:k] + "…" for k in BEGINNINGS if k < len(word))]
    found = [word] if word in names else []
    if word[:SHORTEST] in heads:
        found += [n for k in BEGINNINGS if k < len(word) and (n := word[:k] + "…") in names and n != word]
    return found


def heads_of(names: Iterable[str]) -> frozenset[str]:
    return frozenset(n[:SHORTEST] for n in names if n[-1:] == "…")


class Tally:
    """What texts show: the rows of each mark that hold a name (any, or one of ``wanted``), and the words of the letter model,
    three times as heavy in toxic rows; there a letter's run of four or more counts as three."""

    def __init__(self, wanted: Container[str] | None = None):
        self.wanted, self.heads = wanted, heads_of(wanted or ())
        self.seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        self.words: Counter = Counter()
        self.known: dict[str, tuple] = {}

    def forms(self, token: str) -> tuple[list[str], str | None]:
        """(names, word of the letter model) of a token in lower case."""
        bare = bared(token)
        word = (RUN.sub(r"\1\1\1", bare) if TRIPLE.search(bare) else bare) if bare.isalpha() else None
        return names_of(bare, self.wanted, self.heads) if bare else [], word

    def add(self, text: str, mark: int) -> None:
        known, words, weight = self.known, self.words, 3 if mark else 1
        if len(known) > 200_000:
            known.clear()
        names: set[str] = set()
        for token in set(text.lower().split()):
            form = known.get(token)
            if form is None:
                form = self.forms(token)
                if len(token) <= 64:
                    known[token] = form
            if form[0]:
                names.update(form[0])
            if form[1] is not None:
                words[form[1]] += weight
        self.seen[mark].update(names)


def tally_of(texts: list[str], marks: np.ndarray) -> Tally:
    tally = Tally()
    for text, mark in zip(texts, marks, strict=True):
        tally.add(text, mark)
    return tally


def known_words(texts: list[str], marks: np.ndarray) -> Counter:
    """The words that texts teach the letter model."""
    return tally_of(texts, marks).words


def least_rows(ones: int) -> float:
    """Toxic rows that a feature needs."""
    return max(min(3, ones), ones / 400)


def choose(seen: dict[int, Counter], ones: int, zeros: int, most: int) -> tuple[list[str], dict[str, float]]:
    """(features, how much more often toxic rows hold each name) from the rows of each mark that hold a name."""
    rated = {w: (n + 0.5) / (ones + 1) / ((seen[0][w] + 0.5) / (zeros + 1)) for w, n in seen[1].items() if n >= least_rows(ones)}
    # the strongest by how often and how much more they occur in toxic rows
    gain = {w: (seen[1][w] / ones - seen[0][w] / zeros) * log(r) for w, r in rated.items() if r > 3}
    return sorted(gain, key=lambda w: (-gain[w], w))[:most], rated


def distinctive(chosen: list[str], rated: dict[str, float], total: int) -> Counter:
    """Words that the lattice should find, with their weights in a corpus of so many words."""
    return Counter({w: max(1, total // 200) for w in chosen if w.isalpha() and len(w) > 3 and rated[w] > 10})


def triples_of(words: Counter) -> Counter:
    """The weights of all runs of three letters, with two signs before a word and one behind it."""
    counts: Counter = Counter()
    for w, n in words.items():
        marked = f"^^{w}$"
        for i in range(len(marked) - 2):
            counts[marked[i : i + 3]] += n
    return counts


def letters_of(triples: Counter) -> Counter:
    """(context, letter) -> weight, for contexts of two, one and no letters."""
    counts: Counter = Counter()
    for t, n in triples.items():
        for context in (t[:2], t[1], ""):
            counts[context, t[2]] += n
    return counts


@dataclass
class LetterModel:
    """Character trigrams with the weights of two, one and no letters of context."""

    counts: dict = field(default_factory=dict)
    #: what a star may stand for, by the two letters before it, as far as asked
    stars: dict = field(default_factory=dict)

    @staticmethod
    def of(words: Counter, distinctive: Counter) -> "LetterModel":
        """distinctive: words that the lattice should find, added to the corpus with their own weights."""
        return LetterModel.counted(letters_of(triples_of(words + distinctive)))

    @staticmethod
    def counted(counts: Counter, totals: Counter | None = None) -> "LetterModel":
        """From weights by (context, letter); totals: those of contexts, where counts lack letters."""
        if totals is None:
            totals = Counter()
            for (context, _), n in counts.items():
                totals[context] += n
        shares: dict[str, dict] = defaultdict(dict)
        for (context, letter), n in counts.items():
            shares[context][letter] = n / totals[context]
        return LetterModel(dict(shares))

    def cost(self, before: str, letter: str) -> float:
        get = self.counts.get
        p = 0.7 * get(before, {}).get(letter, 0) + 0.2 * get(before[1:], {}).get(letter, 0) + 0.09 * get("", {}).get(letter, 0) + 1e-6
        return -log(p)

    def restore(self, word: str) -> str:
        """The likeliest word behind a suspicious one (lower case)."""
        # what was written so far is a chain of pairs: long words take no copies
        paths: dict[str, tuple[float, tuple]] = {"^^": (0.0, ())}
        i = 0
        while i < len(word):
            c = word[i]
            run = 1
            while i + run < len(word) and word[i + run] == c:
                run += 1
            if c.isalpha():
                options = [(c, 0.0)] if run == 1 else [(c, 0.0), (c + c, 0.0 if run == 2 else CHANNEL["double letter"])]
            elif c in LEET:
                options = [(x * k, CHANNEL["letter for a sign"] + (CHANNEL["double letter"] if k == 1 and run == 2 else 0)) for x in LEET[c] for k in range(1, min(run, 2) + 1)]
                options += [("", CHANNEL["nothing for a digit" if c.isdigit() else "nothing for a sign"]), (c, CHANNEL["sign kept"])]
            else:
                options = [("", CHANNEL["nothing for a separator"])]
            if c == "*":
                run = 1  # each star is a letter of its own, or nothing
            i += run
            following: dict[str, tuple[float, tuple]] = {}
            for before, (cost, chain) in paths.items():
                if c == "*":
                    for letters, price, at in self._for_a_star(before):
                        if at not in following or cost + price < following[at][0]:
                            following[at] = cost + price, (chain, letters) if letters else chain
                    continue
                for letters, price in options:
                    at, total = before, cost + price
                    for x in letters:
                        total += self.cost(at, x)
                        at = at[1] + x
                    if at not in following or total < following[at][0]:
                        following[at] = total, (chain, letters) if letters else chain
            if len(following) > STATES:
                following = dict(sorted(following.items(), key=lambda s: (s[1][0], s[0]))[:STATES])
            paths = following
        ends = [(cost + self.cost(before, "$"), chain) for before, (cost, chain) in paths.items()]
        least = min(cost for cost, _ in ends)
        return min(self._text(chain) for cost, chain in ends if cost == least)

    def _for_a_star(self, before: str) -> list[tuple[str, float, str]]:
        """What a star may stand for behind two letters: nothing, or a letter that is likely there; with its whole cost and
        the two letters after it."""
        options = self.stars.get(before)
        if options is None:
            letters = {x for context in (before, before[1:]) for x in self.counts.get(context, {}) if x.isalpha()}
            likely = sorted(letters, key=lambda x: (self.cost(before, x), x))[:LIKELY]
            options = self.stars[before] = [("", CHANNEL["nothing for a star"], before), *((x, CHANNEL["any letter for a star"] + self.cost(before, x), before[1] + x) for x in likely)]
        return options

    @staticmethod
    def _text(chain: tuple) -> str:
        letters = []
        while chain:
            chain, last = chain
            letters.append(last)
        return "".join(reversed(letters))


@dataclass
class ToxicityModel:
    letters: LetterModel
    features: dict[str, int]
    weights: np.ndarray
    share: float
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __post_init__(self):
        self.heads = heads_of(self.features)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def restored(self, word: str) -> str:
        """The word as it is scored: lower case, without signs at its edges, restored if it is suspicious."""
        word = word.lower()
        if word.isalpha() and not TRIPLE.search(word):
            return word
        bare = bared(word)
        if bare.isalpha() and not MASKED.search(bare):
            return bare
        if len(bare) > 1 and bare[-1] == bare[-2] and not bare[-1].isalnum() and bare[-1] != "_":
            bare = bare.rstrip(bare[-1])  # junk signs behind a word
        if len(bare) > 2 and MASKED.search(short := RUN.sub(r"\1\1\1", bare)):  # longer runs say no more
            bare = self.starred(short) if "*" in short else None
            bare = bare or self.letters.restore(short)
        return bare

    def starred(self, word: str) -> str | None:
        """The word that training knows as toxic behind stars: one letter for each of them, or else one or none."""
        if len(word) > 64 or not word.replace("*", "").isalpha():
            return None
        for letters in (r"[^\W\d_]", r"[^\W\d_]?"):
            fits = re.compile(word.replace("*", letters)).fullmatch
            for known in self.features:  # the most telling first
                if known.isalpha() and len(known) > 3 and fits(known):
                    return known
        return None

    def clean(self, text: str) -> str:
        """The whole restored text."""
        text = SPACED_LEET.sub(lambda m: self.letters.restore(re.sub(r"\s", ".", m[0].lower())) if hides(m[0]) else m[0], text)
        return " ".join(self.restored(w) for w in text.split())

    def evidence(self, text: str) -> tuple[dict[int, int], int]:
        """(feature -> words that show it, number of words) of a text."""
        known = self.known
        hidden = spaced(text)
        if hidden:
            text += " " + " ".join(self.letters.restore(re.sub(r"\s", ".", m.lower())) for m in hidden)
        words = text.split()
        found: dict[int, int] = {}
        for w, k in Counter(words).items():
            hits = known.get(w)
            if hits is None:
                if len(known) > 100_000:
                    known.clear()
                hits = tuple(self.features[n] for n in names_of(self.restored(w), self.features, self.heads))
                if len(w) <= 64:
                    known[w] = hits
            for h in hits:
                found[h] = found.get(h, 0) + k
        return found, len(words)

    def row(self, text: str) -> dict[int, float]:
        """The columns of a text that aren't 0: features, the text's length, and the constant."""
        found, n = self.evidence(text)
        return {h: 1 + log(k) for h, k in found.items()} | {len(self.features): log(n + 1) / 4, len(self.features) + 1: 1.0}

    def matrix(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.features) + 2))
        for i, text in enumerate(texts):
            for h, v in self.row(text).items():
                x[i, h] = v
        return x

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.features:
            return np.full(len(texts), self.share)
        out = np.empty(len(texts))
        for at in range(0, len(texts), 512):
            out[at : at + 512] = sigmoid(self.matrix(texts[at : at + 512]) @ self.weights)
        return out


def fit(rows: pd.DataFrame, counts: dict, most_features: int = MOST_FEATURES) -> ToxicityModel:
    """The model of rows at hand (text, mark 0 or 1); counts of all training rows by mark. fit_all() does the same over a table."""
    texts, y = rows["text"].tolist(), rows["mark"].to_numpy().astype(int)
    ones, zeros = int((y == 1).sum()), int((y == 0).sum())
    if min(ones, zeros) == 0:
        return unlearnt(counts)
    tally = tally_of(texts, y)
    chosen, rated = choose(tally.seen, ones, zeros, most_features)
    letters = LetterModel.of(tally.words, distinctive(chosen, rated, sum(tally.words.values())))
    model = ToxicityModel(letters, {w: i for i, w in enumerate(chosen)}, np.zeros(len(chosen) + 2), share_of(counts))
    model.weights = logistic(model.matrix(texts), y, class_weights(y, counts), ridge=1.0)
    return model


def share_of(counts: dict) -> float:
    total = sum(counts.values())
    return counts.get(1, 0) / total if total else 0.0


def unlearnt(counts: dict) -> ToxicityModel:
    return ToxicityModel(LetterModel(), {}, np.zeros(0), share_of(counts))


def tallied(rows: DataFrame, wanted: Broadcast | None = None, at_once: int = 300_000) -> DataFrame:
    """Sums over rows (text, mark): (name, letters, n). Without ``wanted``: all names, with the rows that hold each. With it:
    those of its names with the clean rows that hold each, runs of three letters with their weight (no name), and in the row
    without either the weight of all words. A task hands on its sums when it holds at_once of them."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = Tally(wanted.value if wanted else None)
        seen = tally.seen

        def sums() -> pd.DataFrame:
            names = seen[0] if wanted else seen[0] + seen[1]
            triples = triples_of(tally.words) if wanted else Counter()
            out = {"name": [*names, *[None] * (len(triples) + 1)], "letters": [*[None] * len(names), *triples, None], "n": [*names.values(), *triples.values(), sum(tally.words.values())]}
            seen[0].clear(), seen[1].clear(), tally.words.clear()
            return pd.DataFrame(out)

        for frame in slices(frames):
            for text, mark in zip(frame["text"], frame["mark"], strict=True):
                tally.add(text, mark)
                if len(seen[0]) + len(seen[1]) + len(tally.words) > at_once:
                    yield sums()
        yield sums()

    return rows.select("text", "mark").mapInPandas(run, "name string, letters string, n long").groupBy("name", "letters").agg(F.sum("n").alias("n"))


def fit_all(docs: DataFrame, marks: DataFrame, most_features: int = MOST_FEATURES, letters: int = LETTERS) -> ToxicityModel:
    """The model of all rows of docs (doc_id, text) that marks (doc_id, mark 0 or 1) label outside the held-out fold; nulls are
    left out. Texts that are learnt from are written once, with their marks."""
    usable = marks.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["mark"]: r["n"] for r in usable.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    if min(counts.get(0, 0), counts.get(1, 0)) == 0:
        return unlearnt(counts)
    # labels grow with the corpus: both sides are dealt by id at every size, and texts aren't sorted
    labelled = docs.filter(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).join(usable.distinct().hint("shuffle_hash"), "doc_id")
    rows = written(labelled.select("text", "mark"), "toxic-texts")
    found = {r["mark"]: r["n"] for r in rows.groupBy("mark").agg(F.count("*").alias("n")).collect()}
    ones, zeros = found.get(1, 0), found.get(0, 0)
    if min(ones, zeros) == 0:
        discard(rows)
        return unlearnt(counts)
    # a feature is held by one of 400 toxic rows at least, so of candidates there are 400 times a row's names at most
    often = tallied(rows.filter("mark = 1")).filter(F.col("name").isNotNull() & (F.col("n") >= least_rows(ones))).select("name", "n").toPandas()
    in_toxic = Counter(dict(zip(often["name"], often["n"].tolist(), strict=True)))
    context = docs.sparkSession.sparkContext
    sums = written(tallied(rows, context.broadcast(frozenset(in_toxic))), "toxic-sums")
    in_clean = sums.filter("name is not null").toPandas()
    chosen, rated = choose({0: Counter(dict(zip(in_clean["name"], in_clean["n"].tolist(), strict=True))), 1: in_toxic}, ones, zeros, most_features)
    triples = sums.filter("letters is not null")
    pairs = triples.select("n", F.substring("letters", 3, 1).alias("letter"), F.explode(F.array(F.substring("letters", 1, 2), F.substring("letters", 2, 1), F.lit(""))).alias("context"))
    pairs = pairs.groupBy("context", "letter").agg(F.sum("n").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy("context")))
    kept = pairs.orderBy(F.desc("n"), "context", "letter").limit(letters).toPandas()
    weights = Counter(dict(zip(zip(kept["context"], kept["letter"], strict=True), kept["n"].tolist(), strict=True)))
    totals = Counter(dict(zip(kept["context"], kept["total"].tolist(), strict=True)))
    total = sums.filter("name is null and letters is null").first()["n"]
    for pair, n in letters_of(triples_of(distinctive(chosen, rated, total))).items():
        weights[pair] += n
        totals[pair[0]] += n
    model = ToxicityModel(LetterModel.counted(weights, totals), {w: i for i, w in enumerate(chosen)}, np.zeros(len(chosen) + 2), share_of(counts))
    if chosen:
        shared = context.broadcast(model)

        def evidence(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in slices(frames):
                shown = [shared.value.row(text) for text in frame["text"]]
                yield pd.DataFrame({"mark": frame["mark"].to_numpy(), "at": [list(r) for r in shown], "value": [list(r.values()) for r in shown]})

        shown = written(rows.mapInPandas(evidence, "mark int, at array<int>, value array<double>"), "toxic-evidence")
        per_row = {m: counts[m] / sum(counts.values()) * (ones + zeros) / n for m, n in found.items()}
        model.weights = logistic_over(shown, len(chosen) + 2, per_row, ridge=1.0)
        discard(shown)
    discard(rows, sums)
    return model


def scorer(docs: DataFrame, labels: DataFrame, **sizes: int):
    """A column function text -> struct (score), learnt from all labelled rows of docs (doc_id, text) and labels (doc_id, toxic).

    sizes are those of fit_all(): of the model, not of what it learns from.
    """
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("mark")).filter("mark in (0, 1)")
    model = docs.sparkSession.sparkContext.broadcast(fit_all(docs.select("doc_id", "text"), marks, **sizes))
    return by_text(lambda texts: {"score": model.value.score(texts)}, "score double")


def score(docs: DataFrame, labels: DataFrame, **sizes: int) -> DataFrame:
    """(doc_id, held_out boolean, score double) of every row of docs; sizes are those of scorer()."""
    scored = scorer(docs, labels, **sizes)("text").alias("out")
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored).select("doc_id", "held_out", "out.score")
