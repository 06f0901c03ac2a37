"""The registered queries: the columns and digests that their contracts name, over a small folder of tables."""

import hashlib
import zlib

import numpy as np
import pytest

from inkweave.llm import op4_packing as op4
from inkweave.llm import queries
from tests.llm.helpers import SCHEMA, odd_rows, prose
from tests.llm.test_duplicates import removed

LONG, DOUBLE, TEXT, FLAG, INT = "bigint", "double", "string", "boolean", "int"
CONTRACTS = {
    "op2": {"doc_id": LONG, "n_chars": LONG, "edited_sha256": TEXT, "fingerprint": TEXT, "edited_fingerprint": TEXT, "near_edited": DOUBLE, "near_next": DOUBLE},
    "op3": {"doc_id": LONG, "held_out": FLAG, "n_tokens": LONG, "n_known": LONG, "train_tokens": LONG, "base_score": DOUBLE, "score": DOUBLE},
    "op4": {"doc_id": LONG, "piece": INT, "start": LONG, "length": LONG, "ids_crc32": LONG, "sequence_id": LONG, "offset": LONG},
    "op5": {"doc_id": LONG, "n_words": LONG, "n_removed": LONG, "kept_sha256": TEXT},
    "op6": {"doc_id": LONG, "held_out": FLAG, "score": DOUBLE, "predicted": INT},
    "op7": {"doc_id": LONG, "held_out": FLAG, "lang_pred": TEXT, "score": DOUBLE},
    "op8": {"doc_id": LONG, "held_out": FLAG, "score": DOUBLE, "predicted": INT},
    "op9": {"doc_id": LONG, "class_id": LONG, "n_links": LONG, "kept": FLAG},
    "op11": {"lang": TEXT, "rank": LONG, "phrase": TEXT, "a": LONG, "l": LONG, "r": LONG, "n": LONG, "score": LONG},
    "op12": {"doc_id": LONG, "n_tokens": LONG, "ids_sha256": TEXT, "decoded_sha256": TEXT},
    "op13": {"word": TEXT, "form": TEXT, "root": TEXT, "n": LONG, "n_near": LONG, "form_n": LONG},
    "op10": {"vec_id": LONG, "n_links": LONG, "component_id": LONG, "kept": FLAG},
}
NAMES = {name.split("_")[0]: name for name in queries.QUERIES}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("sf")
    rows = odd_rows() + [(100 + k, prose(k % 30, 40 + k % 30), ["en", "de"][k % 2], "s", 1) for k in range(60)] + [(None, prose(700, 60), "en", "s", 1), (2**60 + 1, prose(701, 60), "de", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(place / "documents.parquet"))
    spark.createDataFrame([(100 + k, k % 2, (k // 2) % 2) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(str(place / "labels.parquet"))
    r = np.random.RandomState(3)
    vectors = [(k, (r.standard_normal(32) if k % 3 else np.full(32, float(k % 5 + 1))).astype(np.float32).tolist(), 0) for k in range(40)] + [(None, [1.0] * 32, 1), (41, None, 1)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(str(place / "embeddings.parquet"))
    return str(place), rows


@pytest.fixture(scope="module")
def results(spark, folder):
    kept = {}

    def get(which):
        if which not in kept:
            df = queries.QUERIES[NAMES[which]](spark, folder[0])
            kept[which] = dict(df.dtypes), df.collect()
        return kept[which]

    return get


@pytest.mark.parametrize("which", sorted(CONTRACTS))
def test_columns_and_rows(folder, results, which):
    types, rows = results(which)
    assert list(types.items())[: len(CONTRACTS[which])] == list(CONTRACTS[which].items())
    if which == "op10":
        assert sorted(map(str, (r.vec_id for r in rows))) == sorted([*map(str, range(40)), "None", "41"])
    elif which not in ("op4", "op11", "op13"):
        assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(i) for i, *_ in folder[1])


@pytest.mark.parametrize("which, mod, least", [("op6", 5, 0.3), ("op8", 5, 0.5), ("op7", 5, None), ("op3", 7, None)])
def test_folds_and_predictions(results, which, mod, least):
    _, rows = results(which)
    want = 2 if mod == 7 else 0
    for r in rows:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % mod == want)
        if least is not None:
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)


def test_op4_digests(folder, results):
    encode = op4.encoder(op4.default_vocabulary())
    want = []
    for i, text, *_ in folder[1]:
        ids = [*encode(text or ""), 2]
        first = len(ids) % 1024 or 1024
        for k, (a, b) in enumerate([(0, first), *((s, s + 1024) for s in range(first, len(ids), 1024))]):
            want.append((str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())))
    _, rows = results("op4")
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        ends = np.cumsum([n for _, n in sorted(p)])
        assert [o for o, _ in sorted(p)] == [0, *ends[:-1]] and ends[-1] <= 1024


def test_op5_digests(folder, results):
    """Against brute force, where rows are taken in the order of ids (none: last)."""
    rows = [(i, t) for i, t, *_ in folder[1]]
    single = {i: t for i, t in rows if i is not None and sum(j == i for j, _ in rows) == 1}
    # a repeated row keeps what its first row keeps; 7 stands twice with one text, 8 with two that share nothing
    eight = [t for i, t in rows if i == 8]
    texts = {(0, i): t for i, t in single.items()} | {(0, 7): dict(rows)[7], (0, 8): eight[0], (0, 8.5): eight[1]} | {(1, k): t for k, (i, t) in enumerate(rows) if i is None}
    want = removed(texts)
    _, got = results("op5")
    mine = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got if r.doc_id is not None and r.doc_id != 8}
    assert mine == {i: (*want[0, i][:2], hashlib.sha256(want[0, i][2].encode()).hexdigest()) for i in [*single, 7]}
    none = sorted((r.n_words, r.n_removed, r.kept_sha256) for r in got if r.doc_id is None)
    assert none == sorted((*v[:2], hashlib.sha256(v[2].encode()).hexdigest()) for k, v in want.items() if k[0] == 1)


def test_op7_has_no_language_for_marks_alone(spark, folder):
    from inkweave.llm import op7_language
    from tests.llm.helpers import frame

    rows = folder[1] + [(900, "́̂ ह"[:2], None, "s", 1), (901, "१२३", None, "s", 1)]
    out = {r.doc_id: (r.lang_pred, r.score, r.explained) for r in op7_language.predict(frame(spark, rows)).collect() if r.doc_id in (900, 901, 2, 12)}
    assert set(out.values()) == {("und", 0.0, False)}


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert sorted(int(n[2:]) for n in NAMES) == list(range(1, 14)) and set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("which", ["op11", "op13"])
def test_rows_equal_the_sql(folder, results, which):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder[0]}/documents.parquet/*.parquet')")
    want = con.execute(queries.ORACLES[NAMES[which]])
    names = [c[0] for c in want.description]
    _, rows = results(which)
    order = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in names) for r in rows), key=order) == sorted(want.fetchall(), key=order) and rows
