"""An inverted file of vectors: lists around centroids, stored by list, of which a query reads only some.

``build`` fits centroids to a bounded sample, puts every row into the list of its nearest centroid, and writes the rows
partitioned by list. ``top_k`` finds each query's nearest centroids, reads the lists that some query needs (the scan's
partition filter), and lets a list's rows meet the queries of that list alone. ``calibrate`` finds how many lists queries
have to probe for a recall, measured against all rows.

Every row with a direction is indexed: vectors that are null, zero or not finite have no cosine and are left out, as in the
exact search. A list of any size is read in as many splits as its files have, and its rows are written by several tasks, so
a cluster with a third of all rows is no task of its own.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkweave.operators.vectors import SENT, best_of, listed, unit

#: Vectors that centroids are fitted to at most, numbers that they hold at most together, and lists at most.
SAMPLE, SAMPLE_NUMBERS, MOST_LISTS = 65_536, 16_000_000, 4_096
#: Rows that one file of a list should get.
FILE_ROWS = 200_000


@dataclass(frozen=True)
class Index:
    """A stored index: the folder of its rows, and its centroids (at most MOST_LISTS unit vectors)."""

    folder: str
    centroids: np.ndarray

    @property
    def lists(self) -> int:
        return len(self.centroids)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/rows")


def fit(vectors: np.ndarray, lists: int, seed: int = 0, rounds: int = 12) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means. A centroid without vectors moves to the vector that its own fits worst."""
    r = np.random.RandomState(seed)
    lists = min(lists, len(vectors))
    centroids = vectors[r.permutation(len(vectors))[:lists]].copy()
    for _ in range(rounds):
        own, near = _nearest(vectors, centroids)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, vectors)
        size = np.linalg.norm(sums, axis=1)
        empty = np.flatnonzero(size < 1e-12)
        if len(empty):
            sums[empty] = vectors[np.argsort(near)[: len(empty)]]
            size[empty] = 1.0
        centroids = sums / size[:, None]
    return centroids


def _nearest(vectors: np.ndarray, centroids: np.ndarray, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    own, near = np.empty(len(vectors), dtype=np.int64), np.empty(len(vectors))
    for at in range(0, len(vectors), block):
        cosine = vectors[at : at + block] @ centroids.T
        own[at : at + block] = cosine.argmax(axis=1)
        near[at : at + block] = cosine.max(axis=1)
    return own, near


def usable(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows whose vector has a direction: no null, no component that is null or not finite, not all zero."""
    v = F.col(vector)
    return rows.filter(v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def build(rows: DataFrame, folder: str, lists: int | None = None, seed: int = 0) -> Index:
    """Write the index of rows (id, vector of one length, any others) to a folder that driver and executors share.

    ``lists`` is the root of the number of rows unless it is given, and MOST_LISTS at most. The sample has SAMPLE vectors and
    SAMPLE_NUMBERS numbers at most; rows are drawn by a hash of their id, so the index of a table is always the same.
    """
    good = usable(rows)
    n, size = good.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not n:
        raise ValueError("no vector to index")
    lists = min(lists or round(n**0.5), MOST_LISTS)
    most = max(1, min(SAMPLE, SAMPLE_NUMBERS // size))
    space = 1 << 40
    drawn = good.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(space)) < min(space, space * 2 * most // n))
    sample = drawn.select("vector").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most).toPandas()
    centroids = fit(unit(sample["vector"]), lists, seed)
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.assign(list=_nearest(unit(f["vector"]), shared.value)[0].astype(np.int32))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in good.schema) + ", list int"
    dealt = good.mapInPandas(placed, schema)
    # a list's rows go to as many tasks as its share of the rows asks for, at least one
    files = max(1, -(-n // FILE_ROWS))
    dealt = dealt.repartition(max(lists, files), "list", F.pmod(F.xxhash64("id", F.lit(3)), F.lit(files)))
    dealt.write.partitionBy("list").mode("overwrite").parquet(f"{folder}/rows")
    spark = rows.sparkSession
    about = [(json.dumps({"lists": len(centroids), "size": int(size)}), centroids.astype("<f8").tobytes())]
    spark.createDataFrame(about, "about string, centroids binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/centroids")
    return Index(folder, centroids)


def opened(spark: SparkSession, folder: str) -> Index:
    """The index that build() stored in a folder."""
    about, data = spark.read.parquet(f"{folder}/centroids").select("about", "centroids").first()
    about = json.loads(about)
    return Index(folder, np.frombuffer(data, dtype="<f8").reshape(about["lists"], about["size"]))


def probed(index: Index, queries: DataFrame, probes: int) -> DataFrame:
    """queries once for each of the ``probes`` lists whose centroids are nearest: (list, query_id, vector, any others)."""
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)
    probes = min(probes, index.lists)

    def near(v: pd.Series) -> pd.Series:
        cosine = unit(v) @ shared.value.T
        return pd.Series(list(np.argpartition(-cosine, probes - 1, axis=1)[:, :probes].astype(np.int32)))

    return usable(queries).withColumn("list", F.explode(F.pandas_udf(near, "array<int>")("vector")))


def top_k(index: Index, queries: DataFrame, k: int, probes: int, sent: int = SENT) -> DataFrame:
    """(query_id, id, cosine, rank): of the rows in each query's nearest lists, the k with the largest cosine.

    A query (query_id, vector) never meets its own id; ties go to the smaller id. Queries whose probes hold ``sent`` numbers
    at most in all go to every task, which reads its rows once. More of them are dealt by list, as the rows then are: a list
    and the queries that probe it are cut into blocks, and each pair of blocks is one matrix product.
    """
    spark = queries.sparkSession
    asked = probed(index, queries.select("query_id", "vector"), probes)
    schema = "query_id long, id long, cosine double"
    # as many lists as there are centroids at most
    lists = [r[0] for r in asked.select("list").distinct().collect()]
    rows = index.rows(spark).select("id", "vector", "list").filter(F.col("list").isin(lists))
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    if size * min(probes, index.lists) <= sent:
        few = asked.toPandas()  # bounded above
        by_list = {int(c): (g["query_id"].to_numpy(), unit(g["vector"])) for c, g in few.groupby("list")}
        shared = spark.sparkContext.broadcast(by_list)

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for f in frames:
                for c, part in f.groupby("list"):
                    if c in shared.value:
                        ids, q = shared.value[c]
                        found = _cosines(ids, q, part, k)
                        best[c] = found if c not in best else best_of(*(np.concatenate(x, axis=1) for x in zip(best[c], found, strict=True)), k)
            for c, found in best.items():
                yield listed(pd.DataFrame({"query_id": shared.value[c][0]}), *found)

        pairs = rows.mapInPandas(scan, schema)
    else:
        held = rows.groupBy("list").agg(F.ceil(F.count("*") / 20_000).cast("int").alias("rb"))
        asks = asked.groupBy("list").agg(F.ceil(F.count("*") / 4_096).cast("int").alias("qb"))
        blocks = held.join(asks, "list")  # a row for each list at most
        block = lambda key, of: F.pmod(F.xxhash64(key, F.lit(5)), F.col(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        r = rows.join(blocks, "list").withColumn("_r", block("id", "rb")).withColumn("_q", every("qb")).drop("rb", "qb")
        q = asked.join(blocks, "list").withColumn("_q", block("query_id", "qb")).withColumn("_r", every("rb")).drop("rb", "qb")

        def product(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            if not len(a) or not len(b):
                return pd.DataFrame({"query_id": [], "id": [], "cosine": []})
            return listed(a, *_cosines(a["query_id"].to_numpy(), unit(a["vector"]), b, k))

        keys = ["list", "_q", "_r"]
        pairs = q.groupBy(*keys).cogroup(r.groupBy(*keys)).applyInPandas(product, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _cosines(query_ids: np.ndarray, queries: np.ndarray, rows: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    ids = rows["id"].to_numpy()
    found = queries @ unit(rows["vector"]).T
    found[query_ids[:, None] == ids[None, :]] = -np.inf
    return best_of(found, ids[None, :], k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact hits (query_id, id) that were found."""
    hit = exact.join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg(F.avg(F.coalesce("hit", F.lit(0)))).first()[0] or 1.0


def calibrate(index: Index, queries: DataFrame, exact: DataFrame, k: int, least: float = 0.95) -> int:
    """The fewest probes, doubled step by step, whose recall against exact hits of some queries reaches ``least``."""
    probes = 1
    while probes < index.lists and recall(top_k(index, queries, k, probes), exact) < least:
        probes *= 2
    return min(probes, index.lists)
