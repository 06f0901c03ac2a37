"""What a review found on larger tables: queries against their SQL on pages that are blank, odd or very long."""

from __future__ import annotations

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from inkweave.operators import context
from inkweave.plans import catalog

TEXTS = ["One two. Three four.", "", "Alpha beta. Gamma.", " ", "\n \n", None, "  lead. And tail. ", "\u00a0", "a\x0bb c. D", "\u2003x\u00a0 y", "Ok. " * 12, "word " * 700, "Last. One"]


def library(folder, texts):
    """Documents with these texts in order of id, the last one without an id."""
    ids = pa.array([*range(len(texts) - 1), None], pa.int64())
    pq.write_table(pa.table({"doc_id": ids, "text": pa.array(texts, pa.string()), "source": pa.array([f"src{i % 3}" for i in range(len(texts))])}), f"{folder}/documents.parquet")
    return str(folder)


#: A page of so many chunks that their numbers run into the next page's, and the last texts of a library.
LAST = ["Ok. " * 8100, "Last. One", "Beta. Gamma.", "No id. At all."]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return library(tmp_path_factory.mktemp("odd"), [*TEXTS * 4, *LAST])


def against_sql(spark, folder, name):
    """(rows of the query, rows of its SQL), sorted."""
    query = catalog.load()[name]
    with duckdb.connect() as con:
        con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
        told = con.execute(query.oracle)
        columns = [c[0] for c in told.description]
        theirs = sorted(told.fetchall(), key=str)
    return sorted((tuple(r) for r in query.run(spark, folder).select(*columns).collect()), key=str), theirs


def test_blank_lines_are_lines(spark, odd):
    ours, theirs = against_sql(spark, odd, "anchored_lines")
    assert ours == theirs and sum(page == 1 for page, _, _ in ours) == 1


def test_an_edge_to_a_page_without_chunks_dangles_only_if_the_page_is_gone(spark, odd):
    ours, theirs = against_sql(spark, odd, "dangling_edges")
    assert ours == theirs and len(ours) > 0


def test_metadata_of_shared_chunk_numbers_and_of_pages_without_one(spark, tmp_path):
    plain = [t for t in TEXTS if not t or not set(t) & set("\u00a0\u2003\x0b")]
    ours, theirs = against_sql(spark, library(tmp_path, [*plain * 4, *LAST]), "book_metadata")
    assert ours == theirs and sum(block is None for _, _, block in ours) == 1


def test_metadata_deals_its_texts_once(spark):
    made = catalog.load()["book_metadata"].run(spark, "/root/testdata/sf0.001")
    plan = made._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).splitlines()
    # collected texts aren't shuffled, and all that asks for sentences asks for the same exchange
    assert not [line for line, below in zip(plan, plan[1:]) if "Exchange hash" in line and "collect_list" in below]
    assert sum("Exchange hashpartitioning(doc_id" in line for line in plan) == 3
    made.collect()
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.split("== Initial Plan ==")[0].count("ReusedExchange") >= 2


def test_metadata_needs_no_pages_of_spans(spark):
    chunks = spark.sql("select id as chunk_id, 'b' as book_id, id div 2 as page_number, cast(id % 2 as int) as chunk_index, 'proof' as structural_type, array('t') as tags, concat('word ', id) as text from range(6)")
    spans = spark.sql("select id as span_id, id div 3 as chunk_id, cast(id % 3 as int) as sentence, 'r' as role, 'N' as search_class, array('t') as tags, concat('word ', id) as span_text from range(18)")
    edges = spark.sql("select id as edge_id, id as from_span, id % 6 as to_chunk, 'b' as to_book, 'uses' as relation, 'a' as confidence from range(0, 18, 2)")
    placed = spans.selectExpr("*", "'b' as book_id", "chunk_id div 2 as page_number")
    plain = context.book_metadata(chunks, spans, edges).collect()
    assert len(plain) == 3 and sorted(plain) == sorted(context.book_metadata(chunks, placed, edges, placed).collect())
