"""Exact comparison inside groups of any size: groups are cut into blocks, and each pair of blocks is one piece of work."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkweave.llm.common import growing


def block_pairs(rows: DataFrame, key: str, parts: DataFrame, row_id: str) -> DataFrame:
    """rows once for each pair of blocks that their block is in, with _i <= _j (the pair) and _own (the row's block).

    parts (key, parts) has the number of blocks of each group; groups that it doesn't name are left out. A row is repeated
    once for each block of its group, and no piece of work holds many more rows than two blocks, however large the group.
    """
    dealt = rows.join(growing(parts), key).withColumn("_own", F.pmod(F.xxhash64(row_id, F.lit(7)), F.col("parts")).cast("int"))
    other = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).drop("parts")
    return other.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_other")


def stars(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For the graph of edges (i, j) over n nodes, each node's smallest node of its component."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        np.minimum.at(new, label[i], low)
        np.minimum.at(new, label[j], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def joins_across(near: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Of links (upper triangle) in a pair of blocks, one for each pair of components inside the blocks: [2, n] nodes.

    Links inside a block are known from that block's own piece of work.
    """
    other = side[:, None] != side[None, :]
    label = stars(*np.nonzero(near & ~other), len(near))
    return np.unique(label[np.stack(np.nonzero(near & other))], axis=1)
