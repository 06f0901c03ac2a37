"""Grouped work in Python for very many small groups: one pass over sorted rows instead of a call for each group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def sorted_groups(df: DataFrame, keys: list[str], work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str, order: list[str] | None = None) -> DataFrame:
    """work on the rows of each group of keys, sorted by order; groups must fit a task's memory. Results are handed on in
    batches."""

    def run(frames: Iterator[pd.DataFrame]):
        held: pd.DataFrame | None = None
        for f in frames:
            if held is not None and len(held):
                f = pd.concat([held, f], ignore_index=True)
            if not len(f):
                continue
            change = np.zeros(len(f), dtype=bool)
            for k in keys:
                v = f[k].to_numpy()
                change[1:] |= v[1:] != v[:-1]
            begins = np.append(0, np.flatnonzero(change))
            held = f.iloc[begins[-1] :]
            yield from _worked(f, begins, work)
        if held is not None and len(held):
            yield from _worked(held, np.array([0, len(held)]), work)

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInPandas(run, schema)


def _worked(f: pd.DataFrame, begins: np.ndarray, work) -> Iterator[pd.DataFrame]:
    out = []
    for begin, end in zip(begins[:-1], begins[1:], strict=True):
        made = work(f.iloc[begin:end])
        if made is not None and len(made):
            out.append(made)
        if len(out) >= 2000:
            yield pd.concat(out, ignore_index=True)
            out = []
    if out:
        yield pd.concat(out, ignore_index=True)
