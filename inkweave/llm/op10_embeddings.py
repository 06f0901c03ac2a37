"""Near-duplicate embeddings by spherical-cap filters: product-code directions, a join on filters, exact verification.

Vectors are normalised and turned by a fixed random rotation (short ones are padded with zeros to LEAST_DIMS first, which
keeps their angles). A direction is one codeword of each half: with C random unit vectors in each half there are C squared
directions, none of which is ever written out. A vector is list-decoded to all directions whose inner product with it
exceeds a height; the height is the one that random vectors exceed for a list's mean length, and is lowered for a vector
that it would give fewer. No list is cut, however long. Vectors that share a direction meet there and are compared in
double precision. Each pair is counted at its smallest shared direction, so counts of links add up without writing out
pairs. Of a direction's links only a star for each of its components goes on to the distributed connected components.

C grows with the square root of the number of vectors, so that a direction holds about PER_DIRECTION of them at any size,
and a vector is copied to some 30 to 50 directions; a direction that one vector alone has is dropped before vectors move.
Only directions that hold more than ``block`` vectors, as a dense cluster makes them, are cut into blocks, all pairs of
which are compared. Recall of random pairs at exactly 0.95 (the tests repeat some): with 128 codewords 0.9997 or more in 4, 16, 64
and 768 dimensions, with 4,096 codewords (130 million vectors) 0.98 in 4 and 16 and 0.999 in 64 and 768; closer pairs share
more.

Equal vectors are one row with a weight throughout, known by the vector itself and never by an id: an id that stands on
several vectors names several rows. Vectors that are null, empty, zero, or hold null or non-finite components link with
nothing; vectors of different lengths don't link with each other. Vectors without a vec_id link with nothing. Repeated
rows are vectors of their own that link. An empty table gives no rows; labels and other columns aren't read.
"""

from __future__ import annotations

from math import ceil, log2, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.blocks import block_pairs, stars
from inkweave.llm.common import components, discard, growing, written
from inkweave.llm.grouped import sorted_groups

LEAST_DIMS = 16
#: Rows times codewords that are decoded at a time.
DECODED = 1_000_000
PER_DIRECTION = 256
_CODES: dict[tuple[int, int], tuple] = {}


def codewords_for(n: int, per_direction: int = PER_DIRECTION) -> int:
    """Codewords in a half for n vectors."""
    return max(16, ceil(sqrt(n * 32 / per_direction)))


def least_list(codewords: int) -> int:
    """The mean length of lists of random vectors, which no list falls short of; more directions need longer lists."""
    return 10 + ceil(2 * log2(codewords))


def code(dims: int, codewords: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(rotation, codewords of the first half, of the second half, height); the same on every machine."""
    if (dims, codewords) not in _CODES:
        random = np.random.RandomState(20_011)
        rotation, _ = np.linalg.qr(random.standard_normal((dims, dims)))
        first = random.standard_normal((codewords, (dims + 1) // 2))
        second = random.standard_normal((codewords, dims // 2))
        for half in (first, second):
            half /= np.maximum(np.linalg.norm(half, axis=1, keepdims=True), 1e-12)
        some = random.standard_normal((400, dims))
        some /= np.linalg.norm(some, axis=1, keepdims=True)
        most = 4 * least_list(codewords)
        sums = _largest_sums(some[:, : first.shape[1]] @ first.T, some[:, first.shape[1] :] @ second.T, most)
        height = float(np.sort(sums.ravel())[::-1][min(sums.size, len(some) * least_list(codewords)) - 1])
        _CODES[dims, codewords] = rotation, first, second, height
    return _CODES[dims, codewords]


def _largest_sums(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """The most largest sums of one entry of each row of a and one of the same row of b, in descending order."""
    best = []
    for scores in (a, b):
        few = min(most, scores.shape[1])
        part = np.partition(scores, scores.shape[1] - few, axis=1)[:, scores.shape[1] - few :]
        best.append(-np.sort(-part, axis=1))
    # the sum at ranks (x, y) is beaten by all below both: only (x + 1)(y + 1) <= most can be among the largest
    x, y = np.array([(x, y) for x in range(best[0].shape[1]) for y in range(most // (x + 1)) if y < best[1].shape[1]]).T
    return -np.sort(-(best[0][:, x] + best[1][:, y]), axis=1)[:, :most]


def decode(vectors: np.ndarray, codewords: int) -> list[np.ndarray]:
    """The sorted numbers of all directions that each unit vector exceeds its height at; in slices of rows, so that memory
    follows neither the batch nor the number of codewords."""
    rows = max(1, DECODED // codewords)
    return [x for at in range(0, len(vectors), rows) for x in _decoded(vectors[at : at + rows], codewords)]


def _decoded(vectors: np.ndarray, codewords: int) -> list[np.ndarray]:
    if vectors.shape[1] < LEAST_DIMS:
        vectors = np.pad(vectors, ((0, 0), (0, LEAST_DIMS - vectors.shape[1])))
    rotation, first, second, height = code(vectors.shape[1], codewords)
    turned = vectors @ rotation
    a, b = turned[:, : first.shape[1]] @ first.T, turned[:, first.shape[1] :] @ second.T
    few = least_list(codewords)
    sums = _largest_sums(a, b, few)
    heights = np.minimum(height, sums[:, -1]) - 1e-12
    out = []
    for row, least in enumerate(heights.tolist()):
        x, y = a[row], b[row]
        i, j = np.flatnonzero(x >= least - y.max()), np.flatnonzero(y >= least - x.max())
        at, to = np.nonzero(x[i][:, None] + y[j][None, :] >= least)
        out.append(np.sort(i[at] * np.int64(codewords) + j[to]))
    return out


def _links(y: np.ndarray, smaller: list[np.ndarray], weight: np.ndarray, side: np.ndarray, cross: bool, least: float):
    """(weights linked to each row at pairs that share no smaller direction, edges that join what is linked).

    Between two blocks only links across them count, and one edge joins each pair of components inside the blocks.
    """
    near = y @ y.T >= least
    np.fill_diagonal(near, False)
    linked, none = np.zeros(len(y), dtype=np.int64), np.zeros((2, 0), dtype=np.int64)
    touched = np.flatnonzero(near.any(axis=1))
    if not len(touched):
        return linked, none
    near = near[np.ix_(touched, touched)]
    other = side[touched][:, None] != side[touched][None, :]
    if cross:
        label = stars(*np.nonzero(np.triu(near & ~other)), len(touched))
        near &= other
        joined = touched[np.unique(label[np.stack(np.nonzero(np.triu(near)))], axis=1)]
    else:
        label = stars(*np.nonzero(np.triu(near)), len(touched))
        at = np.flatnonzero(label != np.arange(len(touched)))
        joined = touched[np.stack([at, label[at]])]
    # pairs that also share a smaller direction are counted there
    owner = np.repeat(np.arange(len(touched)), [len(smaller[k]) for k in touched])
    earlier, place = np.unique(np.concatenate([smaller[k] for k in touched]), return_inverse=True)
    shared = np.zeros(near.shape, dtype=np.float32)
    for begin in range(0, len(earlier), 4096):
        here = (place >= begin) & (place < begin + 4096)
        has = np.zeros((len(touched), min(4096, len(earlier) - begin)), dtype=np.float32)
        has[owner[here], place[here] - begin] = 1
        shared += has @ has.T
    linked[touched] = (near & (shared == 0)) @ weight[touched]
    return linked, joined


def link(vectors: DataFrame, least: float = 0.95, codewords: int | None = None, block: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id long, kept boolean) of every row of vectors (vec_id, embedding).

    Vectors with a cosine of at least ``least`` are linked; a component's id is its smallest vec_id. codewords is chosen
    by the number of vectors unless it is given.
    """
    single = vectors.schema["embedding"].dataType.elementType.simpleString() == "float"
    kind, width = ("float", np.float32) if single else ("double", np.float64)
    rows = vectors.select("vec_id", F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    broken = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    nonzero = F.exists("embedding", lambda x: x != 0.0)
    fine = F.coalesce(~broken & nonzero, F.lit(False)) & F.col("vec_id").isNotNull()
    # equal vectors have one key of 128 bits
    keyed = rows.withColumn("node", F.when(fine, F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(salt), "embedding")), 16, "0") for salt in (1, 2)]))))
    classes = keyed.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("embedding").alias("embedding"))
    classes = written(classes, "op10-classes")
    n = classes.count()
    codewords = codewords or codewords_for(n)

    def unit(raw: pd.Series) -> np.ndarray:
        y = np.frombuffer(b"".join(raw), dtype=width).reshape(len(raw), -1).astype(np.float64)
        y = y / np.abs(y).max(axis=1, keepdims=True)
        return y / np.linalg.norm(y, axis=1, keepdims=True)

    def encode(frames):
        for f in frames:
            raw = pd.Series([np.asarray(x, dtype=width).tobytes() for x in f["embedding"]], index=f.index)
            for size, part in f.groupby(f["embedding"].str.len()):
                lists = decode(unit(raw[part.index]), codewords)
                yield pd.DataFrame({"node": part["node"], "weight": part["weight"], "raw": raw[part.index], "filters": lists, "size": size})

    coded = written(classes.select("node", "weight", "embedding").mapInPandas(encode, "node binary, weight long, raw binary, filters array<long>, size int"), "op10-coded")
    numbered = F.struct(F.col("size"), F.col("filter"))
    met = coded.select("node", "size", F.explode("filters").alias("filter")).withColumn("direction", numbered)
    parts = met.groupBy("direction").agg(F.count("*").alias("n")).filter("n > 1").select("direction", F.ceil(F.col("n") / block).alias("parts"))
    placed = block_pairs(met.select("direction", "node"), "direction", parts, "node")
    # a vector takes along the directions that are smaller than the one where it is compared
    smaller = F.filter("filters", lambda x: x < F.col("direction.filter"))
    pieces = placed.join(growing(coded.select("node", "weight", "raw", "filters")), "node")
    pieces = pieces.select("direction.size", "direction.filter", "_i", "_j", "_own", "node", "weight", "raw", smaller.alias("smaller"))

    def compare(f: pd.DataFrame) -> pd.DataFrame | None:
        cross, side = f["_i"].iloc[0] != f["_j"].iloc[0], (f["_own"] != f["_i"]).to_numpy()
        if len(f) < 2 or cross and side.all() == side.any():
            return None  # nothing to compare, or one block alone, whose own piece counts it
        ids, y = f["node"].to_numpy(), unit(f["raw"])
        if len(f) == 2 and y[0] @ y[1] < least:  # by far the most common
            return None
        linked, joined = _links(y, list(f["smaller"]), f["weight"].to_numpy(), side, bool(cross), least)
        counted = np.flatnonzero(linked)
        return pd.DataFrame(
            {
                "u": np.concatenate([ids[counted], ids[joined[0]]]),
                "v": np.concatenate([np.full(len(counted), None, dtype=object), ids[joined[1]]]),
                "n": np.concatenate([linked[counted], np.zeros(joined.shape[1], dtype=np.int64)]),
            }
        )

    found = written(sorted_groups(pieces, ["size", "filter", "_i", "_j"], compare, "u binary, v binary, n long", ["node"]), "op10-found")
    links = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    joined = components(found.filter("v is not null").select("u", "v"), "op10")
    known = classes.select("node", "rep", "weight").join(links, "node", "left").join(joined, "node", "left")
    known = written(known.withColumn("component", F.coalesce("component", "node")), "op10-known")
    discard(coded, found, joined, classes)
    smallest = known.filter("links > 0").groupBy("component").agg(F.min("rep").alias("least_id"))
    named = known.join(smallest, "component", "left").select("node", F.coalesce("least_id", "rep").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    # a join on the vectors' keys: adaptive execution may split it where one vector is very common
    out = keyed.select("vec_id", "node").join(growing(named), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
