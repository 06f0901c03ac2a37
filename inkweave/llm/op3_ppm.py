"""Language-model scoring by prediction by partial matching (PPM) over a byte-context trie.

Text is lower-cased (A-Z) and read as its tokens: words without white space, joined by one space, and an end sign. The
trie holds, for contexts of 0 to ORDER bytes, how often each byte followed in all training documents; nothing is pruned,
so it grows with the corpus. A byte is coded in the longest known context; a byte that was not seen there costs an escape
(method D: half an occurrence of each symbol seen), then goes on in the next shorter context, where all symbols that the
longer one knows are excluded, down to an even choice among the bytes never seen. The sum is the code length.

One pass deals the documents to slices of about HELD bytes and writes them with each slice's different grams (ORDER bytes
and the next one) and their training counts, packed by part: a hash of the last two bytes of the context. All that a gram's
value takes lies in its part, but for the counts of one and two bytes, which are broadcast (65,536 at most). A task so
builds the trie of one part, then answers each slice's grams of that part; the values meet the documents again by slice.
Contexts that end in the same bytes more than CROWD times (or, if that is more, a CROWDS-th of all bytes) leave their part
and are dealt by one byte more, again and again up to ORDER bytes. What they then lack, the counts behind each crowded
ending itself, is broadcast: 256 numbers for each of at most CROWDS endings of a length. Which parts there are changes no
value. Memory follows the different grams of a part and of a slice. The unigram baseline needs exact counts of all tokens: those
that make up at least one of HOT tokens (at most HOT of them) are broadcast, the rest are joined by a 64-bit hash.

Null and empty texts have the end sign alone. A null id belongs to the fold of the empty text. Repeated rows are scored
each and counted each. If there is nothing to learn from, all bytes are equally likely. Very long texts are one row of a
slice; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import discard, fold, slices, written

ORDER = 6
PARTS = 256
HOT = 1_000_000
SLICE = 1_000_000
HELD = 32_000_000
CROWD, CROWDS = 20_000_000, 4096
SCORED = 500_000, 256  # characters and rows scored at once: a gram and a row's number share 64 bits
END = b"\n"


def normal(text: str | None) -> list[bytes]:
    """The words of a text."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(gram, stream number) of every byte of every stream: the ORDER bytes before it and itself, in one number.

    Each stream is taken to follow ORDER end signs.
    """
    pad = END * ORDER
    flat = np.frombuffer(b"".join([x for s in streams for x in (pad, s)]), dtype=np.uint8)
    sizes = np.array([len(s) for s in streams])
    key = np.zeros(len(flat) - ORDER, dtype=np.uint64)
    wide = flat.astype(np.uint64)
    for k in range(ORDER + 1):
        key |= wide[k : len(flat) - ORDER + k] << np.uint64(8 * (ORDER - k))
    # what would predict the padding before a stream goes
    keep = np.ones(len(key), dtype=bool)
    keep[(np.cumsum(sizes[:-1] + ORDER)[:, None] - np.arange(1, ORDER + 1)).ravel()] = False
    return key[keep], np.repeat(np.arange(len(streams)), sizes)


def tallied(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, sums of their weights)."""
    if weights is None:
        values = np.sort(values)
        first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=int)
        return values[first], np.diff(np.append(first, len(values)))
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, dtype=int)
    return values[first], np.add.reduceat(weights, first) if len(first) else weights


def token_keys(docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of all tokens in order, hashes by code, the tokens' document); the end sign is every document's last."""
    import xxhash

    flat = np.empty(sum(map(len, docs)) + len(docs), dtype=object)
    at = 0
    for words in docs:
        flat[at : at + len(words)] = words
        flat[at + len(words)] = END
        at += len(words) + 1
    codes, distinct = pd.factorize(flat)
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in distinct], dtype=np.uint64).view(np.int64)
    return codes, hashes, np.repeat(np.arange(len(docs)), [len(w) + 1 for w in docs])


class Tally:
    """Sums by key that are handed on when they are many."""

    def __init__(self, kind: int, most: int = 700_000):
        self.kind, self.most, self.parts, self.size = kind, most, [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> Iterator[pd.DataFrame]:
        self.parts.append((keys, counts))
        self.size += len(keys)
        if self.size > 2 * self.most:
            keys, counts = self._merged()
            if len(keys) > self.most:
                yield from self._frames(keys, counts)
            else:
                self.parts, self.size = [(keys, counts)], len(keys)

    def rest(self) -> Iterator[pd.DataFrame]:
        if self.parts:
            yield from self._frames(*self._merged())

    def _merged(self):
        parts, self.parts, self.size = self.parts, [], 0
        return tallied(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))

    def _frames(self, keys, counts, most: int = 50_000):
        for at in range(0, len(keys), most):
            key, n = keys[at : at + most], counts[at : at + most]
            yield _rows(self.kind, len(key), key=key.view(np.int64), n=n.astype(np.int64))


class Merged:
    """Sums by key, held as one sorted array and a few additions."""

    def __init__(self):
        self.parts, self.size, self.base = [], 0, 0

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        self.size += len(keys)
        if self.size > self.base + max(500_000, self.base // 2):
            merged = self.take()
            self.parts, self.size, self.base = [merged], len(merged[0]), len(merged[0])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts, self.size, self.base = self.parts, [], 0, 0
        return tallied(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers, compressed byte by byte."""
    import zstandard

    return zstandard.compress(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


READ = "kind int, part int, slice long, grams binary, counts binary, key long, n long, row long, doc_ids array<string>, held_out array<boolean>, sizes array<int>, texts binary"
DOCUMENT, GRAMS, PAIR, TOKEN = range(4)


def _rows(kind: int, size: int, **columns) -> pd.DataFrame:
    names = [c.split()[0] for c in READ.split(", ")]
    return pd.DataFrame({c: np.full(size, kind, dtype=np.int32) if c == "kind" else columns.get(c, np.full(size, None)) for c in names})


def _documents(slice_: int, row: int, f: pd.DataFrame, streams: list[bytes]) -> pd.DataFrame:
    """Documents to be scored at once, as one row."""
    import zstandard

    return _rows(DOCUMENT, 1, slice=[slice_], row=[row], doc_ids=[list(f.doc_id)], held_out=[f.held_out.to_numpy().astype(bool)], sizes=[np.array([len(s) for s in streams], dtype=np.int32)], texts=[zstandard.compress(b"".join(streams))])


def _slice_rows(slice_: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pd.DataFrame]:
    """The packed grams of a slice by part, and its training counts of the last two bytes."""
    part = _part(_last(keys >> np.uint64(8), 2))
    order = np.argsort(part, kind="stable")
    keys, n, part = keys[order], n[order], part[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    each = list(zip(np.split(keys, first[1:]), np.split(n, first[1:]), strict=True))
    yield _rows(GRAMS, len(first), part=part[first].astype(np.int32), slice=np.full(len(first), slice_), grams=[packed(np.diff(k, prepend=np.uint64(0))) for k, _ in each], counts=[packed(c) for _, c in each])
    pairs, times = tallied(keys[n > 0] & np.uint64(65535), n[n > 0])
    yield _rows(PAIR, len(pairs), key=pairs.view(np.int64), n=times)


def read(docs: DataFrame, held_bytes: int = HELD) -> DataFrame:
    """Rows of four kinds: the documents with their slices, the slices' grams, training counts of two bytes and of hashed tokens."""

    def run(frames):
        tokens, own = Tally(TOKEN), Merged()
        slice_ = row = TaskContext.get().partitionId() << 33
        size = 0
        for f in slices(frames, SLICE):
            words = [normal(t) for t in f.text]
            streams = [b" ".join(w) + END for w in words]
            held_out = f.held_out.to_numpy().astype(bool)
            key, owner = grams(streams)
            both, times = tallied(key << np.uint64(1) | held_out[owner].astype(np.uint64))
            own.add(both >> np.uint64(1), np.where(both & np.uint64(1), 0, times))
            at = 0
            for few in slices(iter([f]), *SCORED):
                yield _documents(slice_, row, few, streams[at : at + len(few)])
                at += len(few)
                row += len(few)
            size += len(key)
            codes, hashes, _ = token_keys([w for w, h in zip(words, held_out, strict=True) if not h])
            yield from tokens.add(hashes, np.bincount(codes, minlength=len(hashes)))
            if size >= held_bytes:
                yield from _slice_rows(slice_, *own.take())
                size = 0
                slice_ += 1
        if size:
            yield from _slice_rows(slice_, *own.take())
        yield from tokens.rest()

    return docs.select("doc_id", "held_out", "text").mapInPandas(run, READ)


@dataclass
class Level:
    """One order of the trie: grams (context and symbol) and contexts, both sorted."""

    grams: np.ndarray
    log_count: np.ndarray
    contexts: np.ndarray
    own: np.ndarray  # log of the total, and of the escape's share, in this context
    own_escape: np.ndarray
    shorter: np.ndarray  # the same for the next shorter context without the symbols that this one knows
    shorter_escape: np.ndarray


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted values in sorted keys, -1 where they are missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _log(x):
    with np.errstate(divide="ignore"):
        return np.log10(x).astype(np.float32)


class Trie:
    """The trie; orders[k] = (sorted grams of k context bytes and a symbol, counts)."""

    def __init__(self, orders: list[tuple[np.ndarray, np.ndarray]]):
        self.levels: list[Level] = []
        before = None
        for k, (keys, n) in enumerate(orders):
            contexts, first = np.unique(keys >> np.uint64(8), return_index=True)
            if not len(keys):
                self.levels.append(Level(*[np.zeros(0, dtype=t) for t in (np.uint64, np.float32, np.uint64, *[np.float32] * 4)]))
                before = (keys, n, contexts, n, n)
                continue
            kept, kinds = np.add.reduceat(n, first), np.diff(np.append(first, len(keys)))
            total = kept
            shorter = shorter_escape = np.zeros(len(contexts), dtype=np.float32)
            if k:
                at = _find(before[0], contexts)
                total = np.maximum(kept, np.where(at >= 0, before[1][at], 0))
            escape = kinds / 2 + (total - kept)
            if k:
                # a gram's shorter gram is never rarer, so it is there
                excluded = np.add.reduceat(before[1][_find(before[0], keys & np.uint64(256**k - 1))] - 0.5, first)
                home = _find(before[2], contexts & np.uint64(256 ** (k - 1) - 1))
                left = np.maximum(before[3][home] - excluded, before[4][home])
                shorter, shorter_escape = _log(left), _log(before[4][home]) - _log(left)
            self.levels.append(Level(keys, _log(n - 0.5), contexts, _log(total), _log(escape) - _log(total), shorter, shorter_escape))
            before = (keys, n, contexts, total, escape)
        known = len(self.levels[0].grams)
        self.never = float(np.log10(max(1, 256 - known)))

    def log10(self, wanted: np.ndarray) -> np.ndarray:
        """The log10 probability of the last byte of each gram after the bytes before it."""
        out = np.zeros(len(wanted))
        left = np.arange(len(wanted))
        longer = np.full(len(wanted), -1)  # where the next longer context is in its level, if it is known
        for k in range(len(self.levels) - 1, -1, -1):
            level = self.levels[k]
            if not len(level.contexts):
                continue
            key = wanted[left] & np.uint64(256 ** (k + 1) - 1)
            above = self.levels[k + 1] if k + 1 < len(self.levels) else None
            gram = _find(level.grams, key)
            context = _find(level.contexts, key >> np.uint64(8))
            fresh = longer < 0
            if above is None or not len(above.contexts):
                total, escape = level.own[context], level.own_escape[context]
            else:
                total = np.where(fresh, level.own[context], above.shorter[longer])
                escape = np.where(fresh, level.own_escape[context], above.shorter_escape[longer])
            seen = gram >= 0
            out[left[seen]] += level.log_count[gram[seen]] - total[seen]
            rest = ~seen
            known = rest & (context >= 0)
            out[left[known]] += escape[known]
            left, longer = left[rest], context[rest]
        out[left] -= self.never
        return out


def _part(pair: np.ndarray) -> np.ndarray:
    """The part of contexts by their last two bytes."""
    return (pair * np.uint64(40503) & np.uint64(65535)) * np.uint64(PARTS) >> np.uint64(16)


def _last(keys: np.ndarray, size: int) -> np.ndarray:
    """The last bytes of keys."""
    return keys & np.uint64(256**size - 1)


def crowded(rows: DataFrame, pairs: tuple[np.ndarray, np.ndarray], crowd: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length from two bytes on: the endings of contexts that stand there too often for one part, and the (sorted grams of
    that order, counts) behind them."""
    keys, n = pairs
    least, found = max(crowd, int(n.sum()) // CROWDS), []
    endings = keys[n > least]
    parts = [int(p) for p in np.unique(_part(endings))]
    for size in range(2, ORDER):
        if not len(endings):
            break

        def run(frames, endings=endings, size=size):
            kept = [Merged(), Merged()]
            for f in frames:
                for data, counts in zip(f.grams, f.counts, strict=True):
                    grams_, times = np.cumsum(unpacked(data), dtype=np.uint64), unpacked(counts).astype(np.int64)
                    inside = (times > 0) & np.isin(_last(grams_ >> np.uint64(8), size), endings)
                    if inside.any():
                        kept[0].add(_last(grams_[inside], size + 1), times[inside])
                        kept[1].add(_last(grams_[inside] >> np.uint64(8), size + 1), times[inside])
            for longer, sums in enumerate(kept):
                if sums.parts:
                    k, t = sums.take()
                    yield pd.DataFrame({"longer": bool(longer), "key": k.view(np.int64), "n": t})

        some = rows.filter((F.col("kind") == GRAMS) & F.col("part").isin(parts)).select("grams", "counts")
        sums = some.mapInPandas(run, "longer boolean, key long, n long").groupBy("longer", "key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
        behind, longer = sums[~sums["longer"]], sums[sums["longer"] & (sums["n"] > least)]
        found.append((endings, behind["key"].to_numpy().astype(np.uint64), behind["n"].to_numpy().astype(np.int64)))
        endings = longer["key"].to_numpy().astype(np.uint64)
    return found


def answered(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(slice, grams, values): the log10 probabilities of each slice's grams, from the rows of read()."""
    pairs = rows.filter(F.col("kind") == PAIR).groupBy("key").agg(F.sum("n").alias("n")).toPandas().sort_values("key")
    two = pairs["key"].to_numpy().astype(np.uint64), pairs["n"].to_numpy().astype(np.int64)
    crowds = crowded(rows, two, crowd)
    low = rows.sparkSession.sparkContext.broadcast(([tallied(_last(two[0], 1), two[1]), two], crowds))

    def dealt(frames):
        """Packed grams of crowded endings by one byte more: ending is its length and its bytes, 0 for all others."""
        for f in frames:
            for part, slice_, data, counts in zip(f.part, f["slice"], f.grams, f.counts, strict=True):
                keys, n = np.cumsum(unpacked(data), dtype=np.uint64), unpacked(counts)
                ending = np.zeros(len(keys), dtype=np.uint64)
                for size, (endings, _, _) in enumerate(low.value[1], 2):
                    inside = np.isin(_last(keys >> np.uint64(8), size), endings)
                    ending[inside] = np.uint64((size + 1) << 48) | _last(keys[inside] >> np.uint64(8), size + 1)
                order = np.argsort(ending, kind="stable")
                first = np.flatnonzero(np.append(True, np.diff(ending[order]) > 0))
                each = [(packed(np.diff(keys[at], prepend=np.uint64(0))), packed(n[at])) for at in np.split(order, first[1:])]
                yield pd.DataFrame({"part": part, "ending": ending[order][first].view(np.int64), "slice": slice_, "grams": [g for g, _ in each], "counts": [c for _, c in each]})

    def orders(ending: int, keys: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        out = list(low.value[0])
        for k in range(2, ORDER + 1):
            if k < ending >> 48:
                _, behind, times = low.value[1][k - 2]
                context = (ending & (256**k - 1)) << 8
                begin, end = np.searchsorted(behind, np.array([context, context + 256], dtype=np.uint64))
                out.append((behind[begin:end], times[begin:end]))
            else:
                out.append(tallied(_last(keys, k + 1), n))
        return out

    def run(frames):
        part, learnt, trie = None, Merged(), None
        for f in frames:
            found = []
            for *at, asked, slice_, data, counts in zip(f.part, f.ending, f.asked, f["slice"], f.grams, f.counts, strict=True):
                if at != part:
                    part, learnt, trie = at, Merged(), None
                keys = np.cumsum(unpacked(data), dtype=np.uint64)
                if not asked:
                    n = unpacked(counts).astype(np.int64)
                    learnt.add(keys[n > 0], n[n > 0])
                    continue
                if trie is None:
                    trie = Trie(orders(int(at[1]), *learnt.take()))
                found.append((slice_, data, trie.log10(keys).astype(np.float32).tobytes()))
            yield pd.DataFrame(found, columns=["slice", "grams", "values"])

    own = rows.filter(F.col("kind") == GRAMS).select("part", F.lit(0).cast("long").alias("ending"), "slice", "grams", "counts")
    if crowds:
        split = F.col("part").isin([int(p) for p in np.unique(_part(crowds[0][0]))])
        own = own.filter(~split).unionByName(own.filter(split).mapInPandas(dealt, own.schema))
        own = written(own, "op3-dealt")
    own = own.withColumn("asked", F.lit(False)).unionByName(own.withColumn("asked", F.lit(True)).withColumn("counts", F.lit(None).cast("binary")))
    return own.repartition("part", "ending").sortWithinPartitions("part", "ending", "asked").mapInPandas(run, "slice long, grams binary, values binary")


def score(docs: DataFrame, parts: int = 7, held: int = 2, held_bytes: int = HELD, crowd: int = CROWD) -> DataFrame:
    """Scores of all docs (doc_id, text), learnt from those whose fold of parts isn't held.

    (doc_id, held_out boolean, n_tokens, n_known, train_tokens long, base_score, score double): base_score is the
    unigram log10 probability with add-one smoothing, score the trie's.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("string"), "text", (fold(F.col("doc_id"), parts) == held).alias("held_out"))
    rows = written(read(docs, held_bytes), "op3-read")
    tokens = written(rows.filter(F.col("kind") == TOKEN).groupBy("key").agg(F.sum("n").alias("n")), "op3-tokens")
    n, v = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = F.col("n") * HOT >= n
    common = tokens.filter(frequent).toPandas().sort_values("key")
    hot = spark.sparkContext.broadcast((common["key"].to_numpy(), common["n"].to_numpy()))

    def run(frames):
        import zstandard

        keys, n_hot = hot.value
        log_hot = np.log10(n_hot + 1)
        at_slice, values = None, None
        for r in (r for f in frames for r in f.itertuples(index=False)):
            if r.slice != at_slice:
                at_slice, values = r.slice, []
            if r.grams is not None:
                values.append((np.cumsum(unpacked(r.grams), dtype=np.uint64), np.frombuffer(r.values, dtype=np.float32)))
                continue
            if isinstance(values, list):
                # each part's grams are sorted, and no gram is in two parts
                every, logs_of = (np.concatenate(x) for x in zip(*values, strict=True))
                order = np.argsort(every)
                values = every[order], logs_of[order]
            size, ends = len(r.sizes), np.cumsum(r.sizes)
            flat = zstandard.decompress(r.texts)
            streams = [flat[end - n : end] for end, n in zip(ends, r.sizes, strict=True)]
            words = [s.split() for s in streams]
            key, owner = grams(streams)
            both, times = tallied(key << np.uint64(8) | owner.astype(np.uint64))
            gram = both >> np.uint64(8)
            first = np.append(True, gram[1:] != gram[:-1])
            value = values[1][np.searchsorted(values[0], gram[first])][np.cumsum(first) - 1].astype(float)
            scores = np.bincount((both & np.uint64(255)).astype(np.int64), weights=value * times, minlength=size)
            codes, hashes, doc = token_keys(words)
            at = _find(keys, hashes)
            known = (at >= 0)[codes]
            logs = np.where(at >= 0, log_hot[at] if len(keys) else 0.0, 0.0)[codes]
            rare = np.split(hashes[codes[~known]], np.cumsum(np.bincount(doc[~known], minlength=size))[:-1])
            yield pd.DataFrame(
                {
                    "row": r.row + np.arange(size), "doc_id": list(r.doc_ids), "held_out": r.held_out,
                    "n_tokens": np.bincount(doc, minlength=size), "n_known": np.bincount(doc[known], minlength=size),
                    "logs": np.bincount(doc, weights=logs, minlength=size), "score": scores, "rare": rare,
                }
            )

    texts = rows.filter(F.col("kind") == DOCUMENT).select("slice", "row", "doc_ids", "held_out", "sizes", "texts")
    # a slice's values, whose row is -1, come before its documents
    met = answered(rows, crowd).withColumn("row", F.lit(-1).cast("long")).unionByName(texts, allowMissingColumns=True)
    n_slices = rows.filter(F.col("kind") == DOCUMENT).agg(F.count_distinct("slice")).first()[0]
    # four tasks for each slice, so that few tasks hold several slices in one batch of Arrow
    met = met.repartition(max(1, 4 * n_slices), "slice").sortWithinPartitions("slice", "row")
    found = met.mapInPandas(run, "row long, doc_id string, held_out boolean, n_tokens long, n_known long, logs double, score double, rare array<long>")
    found = written(found, "op3-found")
    discard(rows)
    seldom = found.select("row", F.explode("rare").alias("key")).join(tokens.filter(~frequent), "key")
    seldom = seldom.groupBy("row").agg(F.count("*").alias("more_known"), F.sum(F.log10(F.col("n") + 1)).alias("more_logs"))
    scored = found.drop("rare").join(seldom, "row", "left")
    none = F.lit(0)
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return scored.select(
        F.col("doc_id").cast("long"),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", none)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (logs - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))).alias("base_score"),
        "score",
    )
