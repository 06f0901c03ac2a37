"""Ids come out as they went in: large ones beside nulls in one batch, for every operator and for the pipeline's stages."""

import pytest
from pyspark.sql import functions as F

from inkweave.llm import op1_sentencepiece as op1
from inkweave.llm import op2_fingerprint as op2
from inkweave.llm import op3_ppm as op3
from inkweave.llm import op4_packing as op4
from inkweave.llm import op5_repeats as op5
from inkweave.llm import op6_quality as op6
from inkweave.llm import op7_language as op7
from inkweave.llm import op8_toxicity as op8
from inkweave.llm import op9_jaccard as op9
from tests.llm.helpers import frame, prose

BIG = 2**60
IDS = [5, BIG, BIG + 1, BIG + 3, None, None, 2**63 - 1, -(2**62) - 1]


def docs(spark):
    return frame(spark, [(i, prose(k, 40 + k), "en", "s", 1) for k, i in enumerate(IDS)]).coalesce(1)


def marks(spark):
    return spark.createDataFrame([(i, k % 2, k % 2) for k, i in enumerate(IDS)], "doc_id long, quality int, toxic int")


RUNS = {
    "op1": lambda s, d: op1.round_trip(d, op1.default_model()),
    "op1_encode": lambda s, d: op1.decode(op1.encode(d, op1.default_model()), op1.default_model()),
    "op2": lambda s, d: op2.edited_pairs(d),
    "op3": lambda s, d: op3.score(d),
    "op4": lambda s, d: op4.pack(op4.pieces(d, op4.default_vocabulary()), 2),
    "op5": lambda s, d: op5.remove(d),
    "op6": lambda s, d: op6.score(d, marks(s)),
    "op7": lambda s, d: op7.predict(d),
    "op8": lambda s, d: op8.score(d, marks(s)),
    "op9": lambda s, d: op9.link(d),
}


@pytest.mark.parametrize("which", sorted(RUNS))
def test_ids_survive(spark, which):
    got = [r.doc_id for r in RUNS[which](spark, docs(spark)).select("doc_id").collect()]
    assert sorted(map(str, got)) == sorted(map(str, IDS))


def test_the_right_copy_goes(spark):
    import corpus_pipeline as p

    a, b = prose(1, 80), prose(2, 80)
    rows = [(5, a, "en", "s", 1), (BIG, b, "en", "s", 1), (BIG + 1, a, "en", "s", 1), (None, prose(3, 80), "en", "s", 1)]
    kept = p.near_duplicates(spark, frame(spark, rows).coalesce(1), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("5", a), (str(BIG), b), ("None", prose(3, 80))])


def test_op9_takes_rows_not_ids(spark):
    """One id on two texts, each with a near copy: both links are there, and the rows of the id are told apart."""
    a, b = prose(1, 90), prose(2, 90)
    near = lambda t: " ".join([*t.split()[:-1], "other"])
    rows = [(7, a), (7, b), (20, near(a)), (30, near(b)), (3, "x " + b)]
    out = op9.link(frame(spark, [(i, t, "en", "s", 1) for i, t in rows])).join(frame(spark, [(i, t, "en", "s", 1) for i, t in rows], False).select(op9.row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text"), "row_key").collect()
    got = {(r.doc_id, r.text): (r.class_id, r.n_links, r.kept) for r in out}
    assert got == {(7, a): (7, 1, True), (20, near(a)): (7, 1, False), (7, b): (3, 2, False), (30, near(b)): (3, 2, False), (3, "x " + b): (3, 2, True)}


def test_op9_links_rows_without_an_id(spark):
    a, b = prose(1, 90), prose(2, 90)
    near = " ".join([*a.split()[:-1], "other"])
    rows = [(None, a), (None, near), (4, near), (None, b), (None, b), (None, None)]
    out = sorted((str(r.doc_id), str(r.class_id), r.n_links, r.kept) for r in op9.link(frame(spark, [(i, t, "en", "s", 1) for i, t in rows])).collect())
    assert out == sorted([("None", "4", 2, False), ("None", "4", 2, False), ("4", "4", 2, True), ("None", "None", 1, True), ("None", "None", 1, True), ("None", "None", 0, True)])


def test_op5_takes_rows_not_ids(spark):
    """Rows lose words by their own windows only, also where ids are missing or stand on several texts."""
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a), (None, a), (None, b), (7, c), (7, a + " " + prose(4, 30)), (9, prose(5, 30) + " " + c)]
    out = sorted((str(r.doc_id), r.n_words, r.n_removed) for r in op5.remove(frame(spark, [(i, t, "en", "s", 1) for i, t in rows])).collect())
    assert out == sorted([("1", 60, 0), ("None", 60, 60), ("None", 60, 0), ("7", 60, 0), ("7", 90, 60), ("9", 90, 60)])
