"""Phrase collocation mining over dictionary-encoded words.

1. ``encode`` cuts texts into pieces and words, slice by slice of documents, and stores each slice as its own vocabulary and
   an array of numbers into it, with a mark where a piece ends. A table in the shared folder holds them.
2. ``dictionary`` sums the slices' vocabularies and numbers the words that occur at least ``least`` times in their language.
   A phrase that occurs ``least`` times has such words only, so pieces break at all others.
3. ``grams`` gives each slice the numbers of its own words by a join, so no task holds the whole dictionary. It sorts and
   counts the slice's runs of two to ``longest`` numbers, packs each into a fixed-width binary key (five bytes a word, high
   byte first, so keys sort as the numbers do) and cuts the sorted keys at bounds that a sample of keys sets. A slice sends
   one compressed block to each range of keys, and a phrase once, however often it stands there.
4. ``counted`` sorts each range by radix, 16 bits at a time from the last to the first, and counts the runs of equal keys.
5. ``scored`` joins the parts' frequencies, takes the worst cut of each phrase in exact decimals, drops what lies in a longer
   phrase that is nearly as frequent, and ranks each language.

The sample that sets the bounds only balances the ranges; every key is counted whatever the bounds are. A range that would
be too large for a task is divided once more by a hash of the key.

A null text counts as empty, a null language as ``und``; rows without an id and repeated rows count as any others; an empty
table gives no rows. A very long text is a slice of its own. Other columns of documents aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkweave.llm.common import discard, growing, slices, written
from inkweave.llm.grouped import sorted_groups
from inkweave.llm.words import mixed

#: Upper to lower case, tabs to spaces, what ends a piece to a line feed; all of it ASCII, so UTF-8 stays valid.
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)
#: Stands for the end of a piece among the words; this byte is in no UTF-8 text.
BREAK = b"\xff"
#: Bytes of a word's number in a key.
WIDE = 5
#: Characters of a slice, and runs that a slice packs at a time: they bound a task's memory.
SLICE, PACKED = 5_000_000, 250_000
#: Keys (before equal ones meet) that a range should get, sampled keys for each range, and ranges that are cut by bounds.
RANGE, SAMPLED, MOST_BOUNDS = 4_000_000, 64, 20_000


def tokens(texts: list[str | None]) -> list[bytes]:
    """The words of the texts in order, with BREAK after each piece."""
    joined = "\n".join([t or "" for t in texts]).encode("utf-8", "surrogatepass")
    return (joined.translate(LOWER) + b"\n").replace(b"\n", b" " + BREAK + b" ").split()


def encode(docs: DataFrame) -> DataFrame:
    """(slice long, lang, words array<string>, counts array<int>, n_words long, codes binary) of slices of documents.

    codes are little-endian 32-bit places in words, -1 where a piece ends.
    """

    def run(frames: Iterator[pd.DataFrame]):
        number = TaskContext.get().partitionId() << 32
        for f in slices(frames, SLICE):
            for lang, g in f.groupby("lang", sort=False):
                words = np.array(tokens(g.text.tolist()), dtype=object)
                codes, distinct = pd.factorize(words)
                ends = np.flatnonzero(distinct == BREAK)[0]
                codes = np.where(codes == ends, -1, codes - (codes > ends))
                counts = np.bincount(codes[codes >= 0], minlength=len(distinct) - 1)
                shown = [w.decode("utf-8", "replace") for w in np.delete(distinct, ends)]
                yield pd.DataFrame({"slice": [number], "lang": [lang], "words": [shown], "counts": [counts.astype(np.int32)], "n_words": [int(counts.sum())], "codes": [codes.astype("<i4").tobytes()]})
                number += 1

    asked = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    return asked.mapInPandas(run, "slice long, lang string, words array<string>, counts array<int>, n_words long, codes binary")


def dictionary(encoded: DataFrame, least: int, buckets: int = 4096) -> DataFrame:
    """(lang, word, f, id) of the words of at least ``least`` occurrences in their language; ids are distinct, from 1, and
    number the words of a bucket of hashes in turn, so that no task sees all words."""
    each = encoded.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    found = each.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    found = found.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    return found.select("lang", "word", "f", ((place - 1).cast("long") * buckets + F.col("bucket") + 1).alias("id"))


def packed(ids: np.ndarray) -> np.ndarray:
    """Rows of numbers below 2^40 as rows of bytes: WIDE bytes a number, high byte first."""
    wide = ids.astype(">u8").reshape(*ids.shape, 1).view(np.uint8).reshape(*ids.shape, 8)
    return wide[:, :, 8 - WIDE :].reshape(len(ids), WIDE * ids.shape[1])


def unpacked(keys: np.ndarray) -> np.ndarray:
    n = keys.shape[1] // WIDE
    wide = np.zeros((len(keys), n, 8), dtype=np.uint8)
    wide[:, :, 8 - WIDE :] = keys.reshape(len(keys), n, WIDE)
    return wide.view(">u8").reshape(len(keys), n).astype(np.int64)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts rows of bytes: a stable pass for each two bytes, from the last to the first.

    Two bytes that are alike in all rows need no pass.
    """
    if keys.shape[1] % 2:
        keys = np.concatenate([np.zeros((len(keys), 1), np.uint8), keys], axis=1)
    digits = np.ascontiguousarray(keys).view(">u2").astype(np.uint16).T
    order = np.arange(len(keys))
    for digit in digits[::-1]:
        if len(digit) and (digit != digit[0]).any():
            order = order[np.argsort(digit[order], kind="stable")]
    return order


def run_lengths(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys, their summed counts) of sorted rows of bytes."""
    if not len(keys):
        return keys, counts
    begins = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
    return keys[begins], np.add.reduceat(counts, begins)


class SliceRuns:
    """A slice's runs of frequent words, as numbers of the slice's own ranks, which sort as ids do."""

    def __init__(self, codes: bytes, places: np.ndarray, ids: np.ndarray):
        code = np.frombuffer(codes, dtype="<i4")
        order = np.argsort(ids)
        rank = np.zeros(int(max(code.max(initial=-1), places.max(initial=-1))) + 2, dtype=np.int64)
        rank[places[order]] = np.arange(1, len(ids) + 1)
        self.ranks = rank[code]  # the mark -1 reads the last entry, which stays 0
        self.known = np.append(0, ids[order])

    def of(self, n: int) -> np.ndarray:
        """The runs of n words: numbers, or rows of ranks where numbers would pass 64 bits."""
        ranks, size = self.ranks, len(self.known)
        run = [ranks[k : max(k, len(ranks) - n + 1 + k)] for k in range(n)]
        whole = np.logical_and.reduce([r > 0 for r in run])
        if size**n >= 2**62:
            return np.stack([r[whole] for r in run], axis=1)
        keys = np.zeros(int(whole.sum()), dtype=np.int64)
        for r in run:
            keys = keys * size + r[whole]
        return keys

    def ids(self, runs: np.ndarray, n: int) -> np.ndarray:
        """Rows of n ids of runs of n words."""
        if runs.ndim == 1:
            parts, size = [], len(self.known)
            for _ in range(n):
                parts.append(runs % size)
                runs = runs // size
            runs = np.stack(parts[::-1], axis=1)
        return self.known[runs]

    def counted(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(sorted distinct runs of n words, counts)."""
        return np.unique(self.of(n), axis=0, return_counts=True)

    def some(self, n: int, step: int) -> np.ndarray:
        """Rows of ids of about one in ``step`` of the distinct runs of n words, chosen by a hash, without sorting the others."""
        runs = self.of(n)
        h = runs.astype(np.uint64) if runs.ndim == 1 else (runs.astype(np.uint64) * np.arange(1, 2 * n, 2, dtype=np.uint64)).sum(axis=1)
        return self.ids(np.unique(runs[mixed(h) % np.uint64(step) == 0], axis=0), n)


def _mixed(keys: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    h = np.zeros(len(keys), dtype=np.uint64)
    for at in range(0, keys.shape[1], WIDE):
        for b in range(at, at + WIDE):
            h = (h << np.uint64(8)) ^ (h >> np.uint64(56)) ^ keys[:, b]
        h = h * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def block(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys with counts, column by column and compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(keys.T).tobytes() + counts.astype("<u4").tobytes())


def opened(data: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    n = len(raw) // (width + 4)
    keys = np.frombuffer(raw, dtype=np.uint8, count=n * width).reshape(width, n).T
    return keys, np.frombuffer(raw, dtype="<u4", offset=n * width).astype(np.int64)


def grams(encoded: DataFrame, words: DataFrame, longest: int, n_words: int) -> DataFrame:
    """(size int, range int, part int, keys binary) of every slice's phrases: blocks of sorted keys of size words with counts."""
    spots = encoded.select("slice", "lang", F.posexplode("words").alias("place", "word"))
    of_slice = spots.join(growing(words.select("lang", "word", "id")), ["lang", "word"]).groupBy("slice").agg(F.collect_list(F.struct("place", "id")).alias("known"))
    known = of_slice.select("slice", F.col("known.place").alias("places"), F.col("known.id").alias("ids"))
    mapped = written(encoded.select("slice", "codes").join(growing(known), "slice"), "phrases-slices")
    wanted = max(1, -(-n_words // RANGE))
    parts, ranges = -(-wanted // MOST_BOUNDS), min(wanted, MOST_BOUNDS)
    step = max(1, n_words // (ranges * SAMPLED))

    def runs_of(f: pd.DataFrame) -> Iterator[SliceRuns]:
        for codes, places, ids in zip(f.codes, f.places, f.ids, strict=True):
            yield SliceRuns(codes, np.asarray(places, dtype=np.int64), np.asarray(ids, dtype=np.int64))

    def sampled(frames: Iterator[pd.DataFrame]):
        for f in frames:
            for number, runs in zip(f.slice, runs_of(f), strict=True):
                for n in range(2, longest + 1):
                    if len(keys := packed(runs.some(n, step))):
                        yield pd.DataFrame({"slice": number, "size": n, "key": [k.tobytes() for k in keys]})

    bounds: dict[int, list[bytes]] = {n: [] for n in range(2, longest + 1)}
    if ranges > 1:
        # a key counts once for each slice that has it, as it does in the blocks; at most SAMPLED keys a range and size reach
        # the driver
        some = mapped.mapInPandas(sampled, "slice long, size int, key binary").orderBy(F.xxhash64("slice", "key")).limit(ranges * SAMPLED * (longest - 1))
        drawn = some.collect()
        for n in bounds:
            seen = sorted(bytes(r["key"]) for r in drawn if r["size"] == n)
            bounds[n] = [seen[len(seen) * k // ranges] for k in range(1, ranges)] if seen else []

    def cut(frames: Iterator[pd.DataFrame]):
        for f in frames:
            for runs in runs_of(f):
                for n in range(2, longest + 1):
                    found, counts = runs.counted(n)
                    for begin in range(0, len(found), PACKED):
                        keys = packed(runs.ids(found[begin : begin + PACKED], n))
                        out = _blocks(keys, counts[begin : begin + PACKED], bounds[n], parts)
                        yield pd.DataFrame([(n, *x) for x in out], columns=["size", "range", "part", "keys"])

    return mapped.mapInPandas(cut, "size int, range int, part int, keys binary")


def _blocks(keys: np.ndarray, counts: np.ndarray, bounds: list[bytes], parts: int) -> Iterator[tuple[int, int, bytes]]:
    """(range, part, block) of sorted keys, cut at the bounds and divided by a hash."""
    ends = [0, *_places(keys, bounds), len(keys)]
    for r, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
        if a == b:
            continue
        if parts == 1:
            yield r, 0, block(keys[a:b], counts[a:b])
            continue
        part = _mixed(keys[a:b]) % np.uint64(parts)
        for p in np.unique(part).tolist():
            yield r, p, block(keys[a:b][part == p], counts[a:b][part == p])


def _places(keys: np.ndarray, bounds: list[bytes]) -> list[int]:
    """Where each bound comes in among sorted keys (bytes compared from the left)."""
    from bisect import bisect_left

    class Rows:
        def __len__(self):
            return len(keys)

        def __getitem__(self, k):
            return keys[k].tobytes()

    rows = Rows()
    return [bisect_left(rows, b) for b in bounds]


def counted(blocks: DataFrame, longest: int, least: int) -> DataFrame:
    """(id1, id2, ... , f) of the phrases of at least ``least`` occurrences; a phrase of fewer words has nulls at the end."""
    names = [f"id{k + 1}" for k in range(longest)]

    def work(group: pd.DataFrame) -> pd.DataFrame:
        size = int(group["size"].iloc[0])
        keys, counts = (np.concatenate(x) for x in zip(*(opened(b, WIDE * size) for b in group["keys"]), strict=True))
        order = radix_order(keys)
        keys, counts = run_lengths(keys[order], counts[order])
        keep = counts >= least
        ids = unpacked(keys[keep])
        return pd.DataFrame({name: ids[:, k] if k < size else 0 for k, name in enumerate(names)}, columns=names).assign(f=counts[keep])

    rows = sorted_groups(blocks, ["size", "range", "part"], work, ", ".join(f"{n} long" for n in [*names, "f"]))
    return rows.select(*[F.nullif(n, F.lit(0)).alias(n) for n in names], "f")


def score(a: str, left: str, right: str):
    """floor(1,000,000 a a / (l r)) in exact decimals; right for frequencies below 10^15."""
    wide = lambda c: f"cast({c} as decimal(15, 0))"
    return F.expr(f"(cast(1000000 as decimal(7, 0)) * ({wide(a)} * {wide(a)})) div ({wide(left)} * {wide(right)})")


def scored(phrases: DataFrame, words: DataFrame, longest: int, cover: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that no longer one covers."""
    ids = [f"id{k + 1}" for k in range(longest)]
    named = phrases
    for k in ids:
        own = words.select(F.col("id").alias(k), F.struct("word", F.col("f").alias("f")).alias(f"w_{k}"), *([F.col("lang")] if k == "id1" else []))
        named = named.join(growing(own), k, "inner" if k in ids[:2] else "left")
    size = sum((F.col(k).isNotNull().cast("int") for k in ids[1:]), F.lit(1))
    named = named.withColumn("size", size).withColumnRenamed("f", "a")
    phrases_of = {n: phrases.filter(F.col(f"id{n}").isNotNull() & (F.col(f"id{n + 1}").isNull() if n < longest else F.lit(True))) for n in range(2, longest + 1)}
    out = None
    for n in range(2, longest + 1):
        rows = named.filter(F.col("size") == n)
        cuts = []
        for k in range(1, n):
            for side, part in (("l", ids[:k]), ("r", ids[k:n])):
                name = f"{side}{k}"
                if len(part) == 1:
                    rows = rows.withColumn(name, F.col(f"w_{part[0]}.f"))
                else:
                    of = phrases_of[len(part)].select(*[F.col(f"id{j + 1}").alias(p) for j, p in enumerate(part)], F.col("f").alias(name))
                    rows = rows.join(growing(of), part)
            cuts.append(F.struct(score("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        rows = rows.withColumn("cut", F.least(*cuts) if len(cuts) > 1 else cuts[0])
        # the most frequent longer phrase around each phrase of n words
        around = [phrases_of[m].select(*[F.col(ids[s + j]).alias(ids[j]) for j in range(n)], F.col("f").alias("over")) for m in range(n + 1, longest + 1) for s in range(m - n + 1)]
        if around:
            every = around[0]
            for more in around[1:]:
                every = every.unionByName(more)
            most = every.groupBy(*ids[:n]).agg(F.max("over").alias("over"))
            rows = rows.join(growing(most), ids[:n], "left").filter(F.col("over").isNull() | (F.lit(100).cast("decimal(7, 0)") * F.col("over") < F.lit(cover).cast("decimal(7, 0)") * F.col("a")))
        text = F.concat_ws(" ", *[F.col(f"w_{i}.word") for i in ids[:n]])
        made = rows.select("lang", text.alias("phrase"), "a", "cut.l", "cut.r", "cut.score")
        out = made if out is None else out.unionByName(made)
    return out


def ranked(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` phrases of each language with their rank; first within 64 shares of a language, so that a large
    language reaches its last task as 64 times ``most`` rows at most."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = found.withColumn("share", share).withColumn("at", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).filter(F.col("at") <= most)
    at = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    kept = first.withColumn("rank", at.cast("long")).filter(F.col("rank") <= most)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "score")


def mine(docs: DataFrame, least: int = 10, longest: int = 3, cover: int = 50, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of two to ``longest`` words of each language.

    a, l and r are the frequencies of the phrase and of the two parts of its worst cut, n all words of the language. A
    phrase inside a longer one with at least ``cover`` percent of its frequency is dropped.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have two words or more and occur at least once")
    encoded = written(encode(docs), "phrases-encoded")
    words = written(dictionary(encoded, least), "phrases-words")
    totals = encoded.groupBy("lang").agg(F.sum("n_words").alias("n"))
    n_words = encoded.agg(F.sum("n_words").alias("n")).first()["n"] or 0
    phrases = written(counted(grams(encoded, words, longest, n_words), longest, least), "phrases-counted")
    best = ranked(scored(phrases, words, longest, cover), most).join(growing(totals), "lang")
    best = written(best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases-best")
    discard(encoded, words, phrases)
    return best
