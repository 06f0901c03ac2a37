"""Quotes and markers in the whole library against plain searches; texts are read once by the dictionary's queries."""

import random

import pytest
from pyspark.sql import functions as F

from inkweave.operators import markers, quotes
from inkweave.plans import catalog

WORDS = ["alpha", "beta", "gamma", "delta", "of", "the", "in", "epsilon", "zeta"]


@pytest.fixture(scope="module")
def library(spark):
    r = random.Random(3)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 200))) for _ in range(80)]
    texts += ["Of  the\nin — “Alpha” of the in", None, "", "of the in " * 400, texts[0], texts[3]]
    return spark.createDataFrame(list(enumerate(texts)), "page_id long, text string").cache(), texts


def form(text):
    table = str.maketrans("‘’“”–—", "''\"\"--")
    return (text or "").translate(table).lower().split()


def by_force(texts, asked):
    out = []
    for i, quote in asked:
        q = form(quote)
        for n in [len(q), *(b for b in quotes.BEGINNINGS if b < len(q))]:
            if n < 3:
                break
            hits = [(i, n, p, s) for p, t in enumerate(texts) for w in [form(t)] for s in range(len(w) - n + 1) if w[s : s + n] == q[:n]]
            if hits:
                out += hits
                break
    return sorted(out)


@pytest.mark.parametrize("sent", [quotes.SENT, 0])
def test_quotes_are_found_wherever_they_stand(spark, library, tmp_path, monkeypatch, sent):
    monkeypatch.setattr(quotes, "SENT", sent)
    pages, texts = library
    quotes.store(pages, str(tmp_path))
    r = random.Random(4)
    long = [t for t in texts if t and len(t.split()) > 60]
    asked = [(k, " ".join(t.split()[(s := r.randint(0, 20)) : s + r.choice([3, 5, 12, 45])])) for k, t in enumerate(long[:25])]
    asked += [(100, "of the in"), (101, "no such words here"), (102, "two words"), (103, None), (104, ""), (105, 'of the in - "alpha"'), (106, "of the in nowhere at all"), (107, long[0])]
    out = quotes.search(spark, str(tmp_path), spark.createDataFrame(asked, "quote_id long, quote string"))
    assert sorted((x.quote_id, x.words, x.page_id, x.start) for x in out.collect()) == by_force(texts, asked)


def test_a_search_reads_the_asked_buckets_alone(spark, library, tmp_path):
    pages, _ = library
    quotes.store(pages, str(tmp_path))
    out = quotes.search(spark, str(tmp_path), spark.createDataFrame([(1, "of the in")], "quote_id long, quote string"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert quotes.search(spark, str(tmp_path), spark.createDataFrame([], "quote_id long, quote string")).count() == 0


@pytest.mark.parametrize("sent", [markers.SENT, 0])
def test_markers_equal_contains(spark, monkeypatch, sent):
    monkeypatch.setattr(markers, "SENT", sent)
    r = random.Random(5)
    letters = "abcdeéß"
    texts = ["".join(r.choice(letters + " ") for _ in range(r.randint(0, 300))) for _ in range(60)] + [None, "", "abc", "abcabc" * 50]
    found = ["".join(r.choice(letters) for _ in range(r.randint(1, 9))) for _ in range(300)] + ["abc", "zzz", "", "abcabcabcabcabc", texts[0]]
    rows = spark.createDataFrame(list(enumerate(texts)), "text_id long, text string")
    marks = spark.createDataFrame(list(enumerate(found)), "marker_id long, marker string")
    out = markers.found(rows, marks)
    assert sorted(map(tuple, out.collect())) == sorted((i, k) for i, t in enumerate(texts) for k, m in enumerate(found) if m and t is not None and m in t)
    assert markers.found(rows, marks.limit(0)).count() == 0 and markers.found(rows.limit(0), marks).count() == 0


def test_a_hundred_thousand_markers(spark):
    """Every marker is the key of one text and stands in it; no table of texts and markers is made."""
    marks = spark.range(100_000).select(F.col("id").alias("marker_id"), F.concat(F.lit("key-"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("marker"))
    texts = spark.range(2_000).select(F.col("id").alias("text_id"), F.concat(F.lit("see key-"), F.lpad((F.col("id") * 37 % 100_000).cast("string"), 6, "0"), F.lit(" here")).alias("text"))
    out = markers.found(texts, marks)
    assert out.count() == 2_000 and out.filter("marker_id <> text_id * 37 % 100000").count() == 0


@pytest.mark.parametrize("name", ["dictionary_best", "definition_links", "lexical_edges", "page_view"])
def test_texts_are_read_once(spark, name):
    """What the query itself reads are written tables; the documents' texts were cut before."""
    out = catalog.load()[name].run(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("FileScan")[1:] if "documents.parquet" in x.split("\n")[0]]
    assert sum("text:string" in x.split("\n")[0] for x in scans) == 0
