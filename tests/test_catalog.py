"""Every query of the library against its DuckDB SQL on the smallest tables."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from inkweave.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog.load()
#: Approximate by design, so no SQL gives their rows; tests/test_stores.py bounds their recall and errors.
APPROXIMATE = {"vector_index_topk", "sketch_merge"}


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind in "iufb" or str(df[c].dtype) in ("Int64", "Int32", "Float64"):
            df[c] = pd.to_numeric(df[c].astype("float64")).round(6).map(lambda x: str(x + 0.0))
        else:
            df[c] = df[c].map(lambda x: str(list(x)) if isinstance(x, (list, np.ndarray)) else ("None" if x is None or x is pd.NaT or x != x else str(x)))
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def test_only_approximate_queries_have_no_sql():
    assert {name for name, q in QUERIES.items() if not q.oracle} == APPROXIMATE


@pytest.mark.parametrize("name", sorted(set(QUERIES) - APPROXIMATE))
def test_query_matches_its_sql(spark, duck, name):
    q = QUERIES[name]
    ours = q.run(spark, SF).toPandas()
    assert q.oracle, f"{name} has no SQL"
    theirs = duck.execute(q.oracle).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    pd.testing.assert_frame_equal(canonical(ours), canonical(theirs))


def test_entry_points_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
