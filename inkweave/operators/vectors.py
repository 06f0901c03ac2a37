"""Nearest vectors: exact search of a stated query set against all rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def unit(column: pd.Series) -> np.ndarray:
    y = np.vstack(column.to_numpy()).astype(np.float64)
    size = np.linalg.norm(y, axis=1, keepdims=True)
    return np.divide(y, size, out=np.zeros_like(y), where=size > 0)


def best_of(cosine: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest finite entries of each row and their ids ([row, entry] or one for all rows), smaller ids first on a
    tie; missing ones are -inf."""
    ids = np.broadcast_to(ids, cosine.shape)
    if cosine.shape[1] > 4 * k:
        least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k]
        wide = int((cosine >= least[:, None]).sum(axis=1).max())  # ties at the border may be more than k
        at = np.argpartition(-cosine, min(wide, cosine.shape[1] - 1), axis=1)[:, :wide]
        cosine, ids = np.take_along_axis(cosine, at, axis=1), np.take_along_axis(ids, at, axis=1)
    order = np.lexsort((ids, -cosine), axis=1)[:, :k]
    return np.take_along_axis(cosine, order, axis=1), np.take_along_axis(ids, order, axis=1)


def _cosines(queries: pd.DataFrame, asked_unit: np.ndarray, rows: pd.DataFrame, rows_unit: np.ndarray, least: float | None, within: str | None, apart: str | None) -> np.ndarray:
    found = asked_unit @ rows_unit.T
    same = lambda c: queries[c].to_numpy()[:, None] == rows[c].to_numpy()[None, :]
    found[queries["query_id"].to_numpy()[:, None] == rows["id"].to_numpy()[None, :]] = -np.inf
    if within:
        found[~same(within)] = -np.inf
    if apart:
        found[same(apart)] = -np.inf
    if least is not None:
        found[found < least] = -np.inf
    return found


def listed(queries: pd.DataFrame, cosine: np.ndarray, ids: np.ndarray) -> pd.DataFrame:
    out = pd.DataFrame({"query_id": np.repeat(queries["query_id"].to_numpy(), cosine.shape[1]), "id": ids.ravel(), "cosine": cosine.ravel()})
    return out[np.isfinite(out["cosine"])]


#: Queries that are sent to all tasks at once: at most so many numbers, and so many results of a task.
SENT = 4_000_000
#: Cosines that a task holds at once: a block of queries times a batch of rows.
HELD = 1_000_000


def _best_in(queries: pd.DataFrame, asked_unit: np.ndarray, rows: pd.DataFrame, k: int, best: tuple[np.ndarray, np.ndarray], least: float | None, within: str | None, apart: str | None) -> None:
    """Bring the k best rows of each query into best (cosines and ids, k of each query), one block of queries after another."""
    ids, step = rows["id"].to_numpy()[None, :], max(1, HELD // len(rows))
    rows_unit = unit(rows["vector"])
    for at in range(0, len(queries), step):
        block = slice(at, at + step)
        found = best_of(_cosines(queries.iloc[block], asked_unit[block], rows, rows_unit, least, within, apart), ids, k)
        both = best_of(*(np.concatenate((kept[block], new), axis=1) for kept, new in zip(best, found, strict=True)), k)
        for kept, new in zip(best, both, strict=True):
            kept[block] = new


def _none_yet(n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full((n, k), -np.inf), np.zeros((n, k), dtype=np.int64)


def top_k(rows: DataFrame, queries: DataFrame, k: int, within: str | None = None, apart: str | None = None, least: float | None = None, row_block: int = 20_000, query_block: int = 4_096, sent: int = SENT) -> DataFrame:
    """(query_id, id, cosine, rank): the k rows (id, vector) with the largest cosine to each query (query_id, vector).

    A query never meets its own id. ``within`` names a column that both sides must share, ``apart`` one in which they must
    differ; ``least`` drops smaller cosines. Ties go to the smaller id.

    Queries of at most ``sent`` numbers in all are sent to every task, which scans its rows once and hands on k rows a query.
    More of them are dealt to blocks by a hash, as the rows then are; each pair of blocks is searched by itself. In either case
    a task holds at most HELD cosines at once, and the k best of its queries. A window ranks what was found.
    """
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()
    schema = "query_id long, id long, cosine double"
    if size <= sent and n * k <= SENT:
        few = queries.toPandas()  # bounded above
        shared = rows.sparkSession.sparkContext.broadcast(few)

        def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked = shared.value
            best, asked_unit = None, unit(asked["vector"]) if len(asked) else None
            for f in frames:
                for _, part in f[f["vector"].notna()].groupby(f["vector"].str.len()):
                    if asked_unit is None or part["vector"].iloc[0].shape[0] != asked_unit.shape[1]:
                        continue
                    best = best or _none_yet(len(asked), k)
                    _best_in(asked, asked_unit, part, k, best, least, within, apart)
            if best is not None:
                yield listed(asked, *best)

        pairs = rows.mapInPandas(scan, schema)
    else:
        row_blocks, query_blocks = max(4, -(-rows.count() // row_block)), max(1, -(-n // query_block))
        dealt_rows = rows.withColumn("_r", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int")).withColumn("_q", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        dealt_queries = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
        keys = ["_q", "_r", *([within] if within else [])]

        def product(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(r):
                return pd.DataFrame({"query_id": [], "id": [], "cosine": []})
            best = _none_yet(len(q), k)
            _best_in(q, unit(q["vector"]), r, k, best, least, None, apart)
            return listed(q, *best)

        pairs = dealt_queries.groupBy(*keys).cogroup(dealt_rows.groupBy(*keys)).applyInPandas(product, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def hybrid(overall: DataFrame, pooled: DataFrame, k: int = 25) -> DataFrame:
    """The union of two searches, ranked anew: (query_id, id, cosine, rank)."""
    both = overall.select("query_id", "id", "cosine").unionByName(pooled.select("query_id", "id", "cosine")).dropDuplicates(["query_id", "id"])
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return both.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def above_floor(found: DataFrame, floor: float = 0.25) -> DataFrame:
    """The hits of those queries whose best cosine reaches the floor."""
    best = F.max("cosine").over(Window.partitionBy("query_id"))
    return found.withColumn("best", best).filter(F.col("best") >= floor).drop("best")


def below(found: DataFrame, floor: float) -> DataFrame:
    """The hits of those queries whose best cosine stays below the floor."""
    best = F.max("cosine").over(Window.partitionBy("query_id"))
    return found.withColumn("best", best).filter(F.col("best") < floor).drop("best")
