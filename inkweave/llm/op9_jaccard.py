"""N-gram Jaccard join by chosen paths: sets are split recursively on sampled shared tokens until buckets are small.

A document's set holds its shingles of five words (one shingle of all words where there are fewer). Rows with equal sets
are one class with a weight. As in the implementation that the method's authors recommend, a set is first embedded as
COORDINATES MinHash tokens (coordinate, value), of which two sets share about as many as their Jaccard similarity says;
one permutation hashing with densification makes them. One run of the search is:

* the root samples ROOTS coordinates; a set goes to the bucket of each (coordinate, value);
* buckets of one class are dropped, buckets of up to ``small`` classes are compared by brute force on the tokens;
* larger buckets sample BRANCHES coordinates each, by a hash of the path so far, and split again, DEPTH times at most; what
  is still larger then is compared in blocks, so nothing is lost to a bound.

A pair at similarity 0.8 misses all buckets of a run with probability 0.2 to the power ROOTS (0.0016) where buckets are
small, and at most 0.25 to that power (0.004) where every bucket splits DEPTH times. Runs with fresh coordinates are
repeated until the target recall: of the close pairs that a run meets, the share whose ends the runs before it hadn't
joined tells what they miss, and the search ends when that is at most 1 - ``recall``. That run's pairs count too.

Pairs whose tokens agree in at least ``loose`` of the coordinates are candidates (at similarity 0.8 a pair falls short of
36 in 64 with probability 3e-6), and only their connected components go on. Small components are verified at once, on
whole sets. Of larger ones, pairs of blocks are first compared on the tokens, and only the rows that have a candidate in a
pair of blocks meet there with their whole sets. Each set's links are added up there, and stars of verified links give the
final classes. So no pairs are written out, and no link inside a candidate component is missed, found by a bucket or not.

Classes are known by their set, never by an id: an id that stands on several texts names several classes. Texts without
words have no set, link with nothing and are classes of their own. Null texts count as such. Rows without a doc_id link
like all others; a class_id is null only if no row of the class has an id. Rows that share both class and id (or that have
none, in a class without ids) are one document: all of them are kept or none. Repeated rows are copies. An empty table
gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.llm.blocks import block_pairs, joins_across, stars
from inkweave.llm.common import by_text, components, discard, growing, slices, written
from inkweave.llm.grouped import sorted_groups
from inkweave.llm.words import hashed_words, mixed, windows, words_of

SHINGLE = 5
COORDINATES = 64
ROOTS, BRANCHES, DEPTH = 4, 2, 5
MOST_RUNS = 40
_SHIFT = np.uint64(64 - 6)
_BORDERS = np.arange(COORDINATES, dtype=np.uint64) << _SHIFT
_PROBES = np.argsort(mixed(np.arange(COORDINATES * COORDINATES, dtype=np.uint64)).reshape(COORDINATES, COORDINATES), axis=1)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    hashes, counts = hashed_words([words_of(t) for t in texts])
    all_ = windows(hashes, SHINGLE)
    out, at = [], 0
    for n in counts.tolist():
        if n >= SHINGLE:
            out.append(np.unique(all_[at : at + n - SHINGLE + 1]))
        elif n:
            out.append(windows(hashes[at : at + n], n))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        at += n
    return out


def tokens(sets: list[np.ndarray]) -> np.ndarray:
    """32-bit MinHash values [set, coordinate]; sets may not be empty."""
    out = np.zeros((len(sets), COORDINATES), dtype=np.uint32)
    for row, s in enumerate(sets):
        at = np.searchsorted(s, _BORDERS)
        least = s[np.minimum(at, len(s) - 1)]
        filled = (at < len(s)) & (least >> _SHIFT == np.arange(COORDINATES, dtype=np.uint64))
        donor = np.arange(COORDINATES)
        if not filled.all():
            empty = np.flatnonzero(~filled)
            donor[empty] = _PROBES[empty, filled[_PROBES[empty]].argmax(axis=1)]
        out[row] = (least[donor] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def _paths(parents: np.ndarray, coordinates: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The path that goes on from each parent with a token."""
    return mixed(parents ^ mixed(coordinates.astype(np.uint64) * np.uint64(2**32) + values.astype(np.uint64)))


def row_key(doc_id: Column, text: Column) -> Column:
    """The same for rows that have the same id and text (null: empty)."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(text, F.lit(""))))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, row_key string, set_key binary, size int, tokens, marks binary) of every row; nulls from set_key on where there
    are no words. Marks are the low bytes of the tokens: all that comparing them takes, at a quarter of the size."""

    def run(texts: list[str]) -> dict:
        sets = shingle_sets(texts)
        some = [i for i, s in enumerate(sets) if len(s)]
        made = tokens([sets[i] for i in some])
        out = {name: [None] * len(sets) for name in ("set_key", "tokens", "marks")} | {"size": [len(s) for s in sets]}
        for k, i in enumerate(some):
            out["set_key"][i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest()
            out["tokens"][i], out["marks"][i] = made[k].tobytes(), made[k].astype(np.uint8).tobytes()
        return out

    made = by_text(run, "set_key binary, tokens binary, marks binary, size int", 3_000_000)
    return docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), made("text").alias("out")).select("doc_id", "row_key", "out.*")


def _grid(column: pd.Series, kind=np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=kind).reshape(-1, COORDINATES)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tokens each row of a shares with each row of b."""
    out = np.zeros((len(a), len(b)), dtype=np.uint8)
    for k in range(COORDINATES):
        out += a[:, k][:, None] == b[:, k][None, :]
    return out


def _agreeing(share: float) -> int:
    return int(np.ceil(share * COORDINATES))


def _edges(u: np.ndarray, v: np.ndarray, close: np.ndarray | bool) -> pd.DataFrame:
    return pd.DataFrame({"u": u, "v": v, "close": np.broadcast_to(close, len(u))})


def candidates(classes: DataFrame, run: int, least: float, loose: float, small: int, block: int) -> DataFrame:
    """Of one run over classes (node, tokens, marks): star edges (u, v) of nodes whose tokens agree, from all buckets of all
    levels; and, marked as close, for each node of a bucket one that it shares at least ``least`` of the tokens with."""
    loose_, close_ = _agreeing(loose), _agreeing(least)

    def compare(f: pd.DataFrame):
        if len(f) < 2:
            return None
        grid, ids = _grid(f["marks"], np.uint8), f["node"].to_numpy()
        if len(f) == 2:
            same = (grid[0] == grid[1]).sum()
            return _edges(ids[1:], ids[:1], same >= close_) if same >= loose_ else None
        alike = np.triu(_alike(grid, grid), 1)
        near = alike >= loose_
        if not near.any():
            return None
        close = alike >= close_
        some = np.flatnonzero(close.any(axis=1))
        witnesses = _edges(ids[some], ids[close[some].argmax(axis=1)], True)
        if f["_i"].iloc[0] == f["_j"].iloc[0]:
            label = stars(*np.nonzero(near), len(f))
            at = np.flatnonzero(label != np.arange(len(f)))
            left, right = at, label[at]
        else:
            left, right = joins_across(near, f["_own"].to_numpy() != f["_i"].to_numpy())
        return pd.concat([witnesses, _edges(ids[left], ids[right], False)], ignore_index=True)

    def children(branches):
        def go(frames):
            for f in frames:
                parents, grid = f["path"].to_numpy().view(np.uint64), _grid(f["tokens"])
                order = mixed(parents[:, None] + np.arange(1, COORDINATES + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15))
                chosen = np.argpartition(order, branches, axis=1)[:, :branches]
                paths = _paths(parents[:, None].repeat(branches, axis=1), chosen, np.take_along_axis(grid, chosen, axis=1))
                yield pd.DataFrame({"path": paths.view(np.int64).ravel(), "node": f["node"].repeat(branches).to_numpy()})

        return go

    root = int(mixed(np.array([1000 + run], dtype=np.uint64)).view(np.int64)[0])
    rows = classes.select(F.lit(root).alias("path"), "node", "tokens").mapInPandas(children(ROOTS), "path long, node binary")
    edges, used = None, []
    for level in range(DEPTH + 1):
        rows = written(rows, "op9-rows")
        sizes = written(rows.groupBy("path").agg(F.count("*").alias("n")).filter("n > 1"), "op9-sizes")
        used += [rows, sizes]
        ready = sizes if level == DEPTH else sizes.filter(F.col("n") <= small)
        members = block_pairs(rows, "path", ready.select("path", F.ceil(F.col("n") / block).alias("parts")), "node").join(growing(classes.select("node", "marks")), "node")
        found = sorted_groups(members.select("path", "_i", "_j", "_own", "node", "marks"), ["path", "_i", "_j"], compare, "u binary, v binary, close boolean", ["node"])
        found = written(found, "op9-candidates")
        edges = found if edges is None else edges.unionByName(found)
        large = sizes.filter(F.col("n") > small)
        if level == DEPTH or not large.limit(1).count():
            break
        rows = rows.join(large, "path").join(growing(classes.select("node", "tokens")), "node").select("path", "node", "tokens").mapInPandas(children(BRANCHES), "path long, node binary")
    discard(*used)
    return edges


def joined(classes: DataFrame, least: float, loose: float, small: int, block: int, recall: float) -> DataFrame:
    """(node, component) of all nodes with a candidate, after as many runs as the recall takes. A table whose runs go on to
    meet pairs that were missed is an error after MOST_RUNS, never a short result."""
    labels = None
    for run in range(MOST_RUNS):
        found = pairs = candidates(classes, run, least, loose, small, block)
        if labels is None:
            labels = components(pairs.select("u", "v"), "op9-near")
            discard(pairs)
            continue
        for end in ("u", "v"):
            found = found.join(labels.select(F.col("node").alias(end), F.col("component").alias(f"{end}_at")), end, "left").withColumn(f"{end}_at", F.coalesce(f"{end}_at", end))
        found = written(found.select(F.col("u_at").alias("u"), F.col("v_at").alias("v"), "close"), "op9-met")
        discard(pairs)
        met, missed = found.filter("close").agg(F.count("*"), F.coalesce(F.sum((F.col("u") != F.col("v")).cast("long")), F.lit(0))).first()
        if not found.filter("u <> v").limit(1).count():
            discard(found)
            break  # nothing new
        more = components(found.select("u", "v"), "op9-more")
        moved = labels.join(more.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        fresh = more.join(labels.select(F.col("component").alias("node")).distinct(), "node", "left_anti")
        before, labels = labels, written(moved.unionByName(fresh), "op9-labels")
        discard(before, more, found)
        if missed <= (1 - recall) * met:
            break
    else:
        raise RuntimeError(f"after {MOST_RUNS} runs the last one still met {missed} of {met} close pairs anew: give a lower recall, or more roots")
    return labels


def intersections(sets: list[np.ndarray], wide: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
    common = np.flatnonzero(times > 1)
    column = np.full(len(times), -1)
    column[common] = np.arange(len(common))
    column = column[place]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for begin in range(0, len(common), wide):
        here = (column >= begin) & (column < begin + wide)
        has = np.zeros((len(sets), min(wide, len(common) - begin)), dtype=np.float32)
        has[owner[here], column[here] - begin] = 1
        out += has @ has.T
    return out


def link(docs: DataFrame, least: float = 0.8, loose: float = 0.55, small: int = 4096, block: int = 1024, exact_block: int = 1024, exact_bytes: int = 8_000_000, recall: float = 0.999) -> DataFrame:
    """(doc_id, class_id, n_links long, kept boolean, row_key string) of every row of docs (doc_id, text).

    n_links counts the other rows whose sets have a Jaccard similarity of at least ``least``; class_id is the smallest
    doc_id reachable by links; kept marks the rows that have it. row_key tells rows of one id apart, see row_key().
    """
    signed = written(signatures(docs), "op9-signatures")
    classes = signed.filter(F.col("set_key").isNotNull()).groupBy(F.col("set_key").alias("node"))
    classes = classes.agg(F.min("doc_id").alias("first_id"), F.count("*").alias("weight"), F.min("row_key").alias("row_key"), F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.first("marks").alias("marks"))
    classes = written(classes, "op9-classes")
    near = joined(classes.select("node", "tokens", "marks"), least, loose, small, block, recall).withColumnRenamed("component", "group")

    # exact verification inside candidate components, cut into blocks by number of sets and by their size
    group = written(near.join(classes.select("node", "row_key", "weight", "size", "marks"), "node"), "op9-groups")
    blocks = F.greatest(F.ceil(F.count("*") / exact_block), F.ceil(F.sum("size") * 8 / exact_bytes)).cast("int")
    parts = group.groupBy("group").agg(blocks.alias("parts"))
    whole = block_pairs(group.select("group", "node", "weight"), "group", parts.filter("parts = 1"), "node")
    sketched = block_pairs(group.select("group", "node", "weight", "marks"), "group", parts.filter("parts > 1"), "node")

    def needed(f: pd.DataFrame):
        grid, side = _grid(f["marks"], np.uint8), f["_own"].to_numpy() != f["_i"].to_numpy()
        left = np.flatnonzero(~side)
        right = np.flatnonzero(side) if f["_i"].iloc[0] != f["_j"].iloc[0] else left
        alike = _alike(grid[left], grid[right]) >= _agreeing(loose)
        if right is left:
            np.fill_diagonal(alike, False)
        some = np.union1d(left[alike.any(axis=1)], right[alike.any(axis=0)])
        return f.iloc[some][["group", "_i", "_j", "_own", "node", "weight"]]

    asked = sorted_groups(sketched.select("group", "_i", "_j", "_own", "node", "weight", "marks"), ["group", "_i", "_j"], needed, "group binary, _i int, _j int, _own int, node binary, weight long")
    places = written(whole.select("group", "_i", "_j", "_own", "node", "weight").unionByName(asked), "op9-places")

    def sets(frames):
        for f in slices(frames, 3_000_000):
            f = f.drop_duplicates("node")  # repeated rows of the class's text
            yield pd.DataFrame({"node": f["node"], "set": [s.tobytes() for s in shingle_sets(list(f["text"]))]})

    texts = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text").join(growing(group.select("row_key", "node")), "row_key").select("node", "text")
    pieces = texts.mapInPandas(sets, "node binary, set binary").join(growing(places), "node")

    def verify(f: pd.DataFrame):
        f = f.drop_duplicates("node")
        if len(f) < 2:
            return None
        members = [np.frombuffer(s, dtype=np.uint64) for s in f["set"]]
        size = np.array([len(s) for s in members], dtype=np.float32)
        shared = intersections(members)
        near_ = shared >= np.float32(least) * (size[:, None] + size[None, :] - shared) - np.float32(1e-3)
        # float32 only picks what comes close; whole numbers decide
        a, b = np.nonzero(near_)
        near_[a, b] = shared[a, b].astype(np.int64) >= least * (size[a].astype(np.int64) + size[b].astype(np.int64) - shared[a, b].astype(np.int64)) - 1e-9
        np.fill_diagonal(near_, False)
        side = f["_own"].to_numpy() != f["_i"].to_numpy()
        ids, weight = f["node"].to_numpy(), f["weight"].to_numpy()
        if f["_i"].iloc[0] == f["_j"].iloc[0]:
            counted, label = near_ @ weight, stars(*np.nonzero(np.triu(near_)), len(f))
            met = np.flatnonzero(label != np.arange(len(f)))
            left, right = ids[met], ids[label[met]]
        else:
            counted = (near_ & (side[:, None] != side[None, :])) @ weight
            left, right = (ids[x] for x in joins_across(np.triu(near_), side))
        some = np.flatnonzero(counted)
        return pd.DataFrame(
            {
                "u": np.concatenate([ids[some], left]),
                "v": np.concatenate([np.full(len(some), None, dtype=object), right]),
                "n": np.concatenate([counted[some], np.zeros(len(left), dtype=np.int64)]),
            }
        )

    found = sorted_groups(pieces.select("group", "_i", "_j", "_own", "node", "weight", "set"), ["group", "_i", "_j"], verify, "u binary, v binary, n long", ["node"])
    found = written(found, "op9-found")
    discard(places, group, near)
    links = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    final = components(found.filter("v is not null").select("u", "v"), "op9")
    known = classes.select("node", "first_id", "weight").join(links, "node", "left").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = written(known, "op9-known")
    discard(found, final, classes)
    # only components of several classes are looked up; the others have the smallest id of their own
    smallest = known.join(final_ids(known), "component", "left")
    smallest = smallest.select(F.col("node").alias("set_key"), F.coalesce("least_id", "first_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # adaptive execution may split this join where one set is very common
    rows = signed.select("doc_id", "row_key", "set_key").join(growing(smallest), "set_key", "left")
    class_id = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return rows.select("doc_id", class_id.alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.col("doc_id").eqNullSafe(class_id).alias("kept"), "row_key")


def final_ids(known: DataFrame) -> DataFrame:
    """(component, least_id) of components that join several classes."""
    linked = known.filter(F.col("links") > 0)
    return linked.groupBy("component").agg(F.min("first_id").alias("least_id"))
