"""Very many markers in texts at once: a join on one rare piece of each marker in place of one search for each marker.

A marker that stands in a text has each of its pieces there. So each marker is known by one piece of SIZE characters (by all
of it, if it is shorter), the rarest in a sample of texts; texts meet the markers whose piece they hold, and those pairs
alone are tested. Which piece is taken never changes the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkweave.sources.tables import stage

#: Characters of a piece, texts of the sample, and pieces that are sent to all tasks at most.
SIZE, SAMPLE, SENT = 6, 2_000, 500_000


def hashes(text: str | None, size: int) -> np.ndarray:
    """The distinct hashes of all pieces of a text, of one size, in time that follows its length."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(points) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        h = (h ^ points[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h).view(np.int64)


def pieces(text: Column, size: int, among: np.ndarray | None = None) -> Column:
    """array<bigint>: the hashes of a text's pieces, those in the sorted array ``among`` alone, if it is given."""

    def run(texts: pd.Series) -> pd.Series:
        found = (hashes(t, size) for t in texts)
        return pd.Series([h if among is None else h[np.isin(h, among, assume_unique=True)] for h in found], dtype=object)

    return F.pandas_udf(run, "array<bigint>")(text)


def chosen(markers: DataFrame, texts: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(marker_id, marker, size, piece) of markers (marker_id, marker) that aren't empty: the piece that is rarest in the first
    ``sample`` texts by a hash."""
    size = F.least(F.lit(SIZE), F.length("marker"))
    own = markers.filter(F.length("marker") > 0).select("marker_id", "marker", size.cast("int").alias("size"))
    of_size = F.pandas_udf(lambda m, n: pd.Series([hashes(x, int(k)) for x, k in zip(m, n, strict=True)], dtype=object), "array<bigint>")
    own = own.select("marker_id", "marker", "size", F.explode(of_size("marker", "size")).alias("piece"))
    some = texts.select("text").filter(F.col("text").isNotNull()).orderBy(F.xxhash64("text")).limit(sample)
    seen = some.select(F.explode(pieces(F.col("text"), SIZE)).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))
    rated = own.join(seen, "piece", "left").select("marker_id", "marker", "size", "piece", F.coalesce("n", F.lit(0)).alias("n"))
    return rated.groupBy("marker_id", "marker").agg(F.min(F.struct("n", "piece", "size")).alias("p")).select("marker_id", "marker", "p.size", "p.piece")


def found(texts: DataFrame, markers: DataFrame) -> DataFrame:
    """(text_id, marker_id) of texts (text_id, text) and the markers (marker_id, marker) that they contain.

    Pieces of texts are dealt by piece only where the markers' pieces are too many to be sent to all tasks; a piece that very
    many texts hold is then split by adaptive execution. Texts are read again for the pairs that are tested.
    """
    known = stage(chosen(markers, texts), "marker-pieces")
    asked = known.select("size", "piece").distinct()
    sizes = [r[0] for r in asked.select("size").distinct().collect()]  # SIZE at most
    few = asked.count() <= SENT
    every = None
    for size in sizes:
        own = asked.filter(F.col("size") == size).select("piece")
        if few:
            among = np.sort(own.toPandas()["piece"].to_numpy(dtype=np.int64))  # SENT at most
            held = texts.select("text_id", F.explode(pieces(F.col("text"), size, among)).alias("piece"))
        else:
            held = texts.select("text_id", F.explode(pieces(F.col("text"), size)).alias("piece")).join(own.hint("merge"), "piece", "left_semi")
        held = held.select("text_id", "piece", F.lit(size).alias("size"))
        every = held if every is None else every.unionByName(held)
    if every is None:
        return texts.select("text_id").join(markers.select("marker_id"), F.lit(False))
    held = stage(every, "marker-hits")
    pairs = held.join(known, ["size", "piece"]).select("text_id", "marker_id", "marker")
    return pairs.join(texts.select("text_id", "text"), "text_id").filter(F.contains("text", F.col("marker"))).select("text_id", "marker_id").distinct()
