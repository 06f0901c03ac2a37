"""What a review found: a small case for each finding that was right."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from inkweave.functions import identifiers, text
from inkweave.operators import context, layout, matching, quality, repairs, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    ("text", "found"),
    [("see arXiv:2123.123456v2 there", "2123.123456"), ("see arXiv:2123.12345v2", "2123.12345"), ("of [hep-th/10600000]", "hep-th/10600000"), ("of [hep-TH/1000001]", "hep-th/1000001"), ("none", None)],
)
def test_ids_in_text_are_read_to_their_last_digit(spark, text, found):
    assert value(spark, identifiers.first_arxiv_id(F.lit(text))) == found


def test_a_vector_search_holds_blocks_of_cosines(monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 8))
    rows = pd.DataFrame({"id": np.arange(900), "vector": list(x), "label": np.arange(900) % 3})
    asked = rows.rename(columns={"id": "query_id"})
    sizes, plain = [], vectors.best_of
    monkeypatch.setattr(vectors, "HELD", 9000)
    monkeypatch.setattr(vectors, "best_of", lambda cosine, ids, k: (sizes.append(cosine.size), plain(cosine, ids, k))[1])
    u = vectors.unit(asked["vector"])
    every = u @ u.T
    for within in (None, "label"):
        best = vectors._none_yet(900, 4)
        for at in range(0, 900, 300):
            vectors._best_in(asked, u, rows.iloc[at : at + 300], 4, best, None, within, None)
        own = every.copy()
        np.fill_diagonal(own, -np.inf)
        if within:
            own[asked.label.to_numpy()[:, None] != rows.label.to_numpy()[None, :]] = -np.inf
        assert (best[1] == np.argsort(-own, axis=1)[:, :4]).all()
    assert max(sizes) <= 9000


def test_gaps_are_those_whose_best_stays_below(spark):
    found = spark.createDataFrame([(1, 10, 0.6, 1), (1, 11, 0.1, 2), (2, 10, 0.4, 1), (2, 12, 0.3, 2), (3, 9, 0.5, 1)], "query_id long, id long, cosine double, rank int")
    assert sorted((r.query_id, r.id) for r in vectors.below(found, 0.5).collect()) == [(2, 10), (2, 12)]


@pytest.mark.parametrize("inner", ["a [[ b ] [/cite]] c", "", " \n x [x] ", "[" * 60_000])
def test_cited_text_ends_at_the_first_closing_tag(spark, inner):
    t = f'[[cite bookId="none" page="1"]] open [[cite bookId="b[[/cite]]" page="2"]]{inner}[[/cite]] rest [[/cite]] [[cite bookId="c" page="3"]] never'
    at = '[[cite bookId="none" page="1"]]'
    got = value(spark, quality.cited(F.lit(t)))
    # the first tag ends inside the second one's book
    assert [(c.book, c.page, c.quote) for c in got] == [("none", "1", t[len(at) : t.index("[[/cite]]")].strip())]
    got = value(spark, quality.cited(F.lit(t[len(at) :])))
    assert [(c.book, c.page, c.quote) for c in got] == [("b[[/cite]]", "2", inner.strip())]


def evaluations(column, pattern):
    """How often a pattern stands in an expression: inside a lambda each of them is computed for each element."""
    return str(column).count(pattern)


def test_quotes_and_tags_are_looked_up_in_forms_made_once(spark):
    place = quality.quote_place(F.col("t"), F.col("q"))
    assert evaluations(place, "[^a-z0-9]+") == 2 and evaluations(place, "translate(coalesce(t") == 1
    assert evaluations(matching.tag_text_score(F.col("g"), F.col("t")), "lower(coalesce(t") == 1
    got = value(spark, quality.quote_place(F.lit("One two-three four five six"), F.lit("zz twothreefour")))
    assert (got["pass"], got["words"]) == (0, 0)
    got = value(spark, quality.quote_place(F.lit("One two-three four five six"), F.lit("two three four")))
    assert (got["pass"], got["words"]) == (2, 20)


def test_annotations_are_counted_without_their_places(spark):
    t = "Clearly it is trivial; see [Foo12] and [Bar].\n\nTheorem 2. Clearly x (3)\n(4.1) "
    got = {x.kind: x.n for x in value(spark, text.annotation_counts(F.lit(t)))}
    kinds = {"missing_proof": text.missing_proofs(F.lit(t)), "citation": text.matches(F.lit(t), text.CITATION_KEY, 1, "citation"), "named": text.matches(F.lit(t), text.NAMED_ENVIRONMENT, 1, "named"), "equation_number": text.matches(F.lit(t), text.EQUATION_NUMBER, 1, "equation_number")}
    assert got == {k: len(value(spark, c)) for k, c in kinds.items()} and min(got.values()) > 0


def physical(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))


def test_repairs_and_columns_sort_no_rows_for_their_joins(spark):
    spans = spark.range(40).selectExpr("id as span_id", "id as chunk_id", "array('a') as tags", "'r' as role", "'N' as search_class")
    verdicts = spans.filter("span_id % 4 = 0").selectExpr("span_id", "array(named_struct('tags', array('x'), 'role', 'r', 'search_class', 'N'), named_struct('tags', array('y'), 'role', 'r', 'search_class', 'N')) as parts")
    made = repairs.decompose(spans, verdicts)
    assert "SortMergeJoin" not in physical(made) and made.filter("status = 'repaired'").count() == 20
    items = spark.range(400).selectExpr("id % 2 as page_id", "cast((id div 2) % 2 * 300 + (id div 4) % 5 * 20 as double) as x", "cast(9000 - id div 20 * 12 as double) as y", "25.0D as w", "10.0D as font", "'w' as str")
    # the items themselves (str among their columns) are neither sorted nor joined by sorting
    assert "str" not in " ".join(line for line in physical(layout.columns(items)).splitlines() if "SortMergeJoin" in line or "Sort [" in line and "line" not in line)


def test_a_page_of_metadata_hands_on_what_is_shown_alone(spark):
    chunks = spark.sql("select 1L as chunk_id, 'b' as book_id, 1L as page_number, 0 as chunk_index, 'proof' as structural_type, array('t') as tags, repeat('word ', 100) as text")
    spans = spark.sql("select 7L as span_id, 1L as chunk_id, 1 as sentence, 'r' as role, 'N' as search_class, array('t') as tags, repeat('word ', 100) as span_text")
    edges = spark.sql("select 1L as edge_id, 7L as from_span, 1L as to_chunk, 'b' as to_book, 'uses' as relation, 'a' as confidence")
    made = context.book_metadata(chunks, spans, edges)
    assert "…" in made.first()["block"] and "edge → uses" in made.first()["block"]
    joins = [line for line in str(made._jdf.queryExecution().optimizedPlan()).splitlines() if "Project" in line and "text#" in line.split("AS")[0]]
    assert joins == []


def test_short_beginnings_are_looked_for_only_where_longer_ones_fail(spark, tmp_path, monkeypatch):
    """Of ten words found as a whole no gram of a shorter beginning is probed, however common it is."""
    from inkweave.operators import quotes

    texts = [(k, "of the in " + " ".join(f"w{k}x{i}" for i in range(20))) for k in range(30)]
    quotes.store(spark.createDataFrame(texts, "page_id long, text string"), str(tmp_path))
    probed, plain = [], quotes.stage
    monkeypatch.setattr(quotes, "stage", lambda df, what: (out := plain(df, what), probed.append((what, out)))[0])
    asked = spark.createDataFrame([(1, " ".join(texts[4][1].split()[:10])), (2, "of the in w7x0 nowhere"), (3, "of the in w1x1 w1x2")], "quote_id long, quote string")
    out = quotes.search(spark, str(tmp_path), asked)
    got = {}
    for r in out.collect():
        got.setdefault((r.quote_id, r.words), set()).add((r.page_id, r.start))
    assert got == {(1, 10): {(4, 0)}, (2, 4): {(7, 0)}, (3, 3): {(k, 0) for k in range(30)}}
    tried = {(r.quote_id, r.words) for what, df in probed if what == "quote-longest" for r in df.collect()}
    assert tried == {(1, 10), (2, 4), (3, 3)}


def test_items_are_dealt_by_page_once(spark):
    items = spark.createDataFrame([(1, 0.0, 9.0, 5.0, 10.0, "a"), (1, 5.0, 9.0, 5.0, 10.0, "b"), (1, 20.0, 9.0, 5.0, 10.0, "c"), (1, 0.0, 2.0, 5.0, 10.0, "d"), (2, 0.0, 1.0, 5.0, 20.0, "e")], "page_id long, x double, y double, w double, font double, str string")
    made = layout.page_text(layout.lines(items))
    assert sorted((r.page_id, r.text) for r in made.collect()) == [(1, "ab c\nd"), (2, "@@FS20@@ e")]
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1


def cited_library(spark):
    """Citing spans of two books and chunks whose texts bear tags out as words, inside words, by beginnings or not at all."""
    tags = [["soft_limit_check", "plain_note"], ["gadget"], ["ab_cd", "plain_note"], ["non-linear_x"], ["Gadget", "hidden_zero"], ["bcfw_shift", "abc"]]
    texts = ["A plain note.", "explain notebooks", "an xgadget here", "Zab cdx", "a non-linear xy", "softer limits checked", "nothing", "[1] A. B [2] C. D [3] E. F [4] gadget", "gadgets: BCFW shifts", "éplain note"]
    citing = [(k, f"b{k % 2}", tags[k % len(tags)]) for k in range(24)] + [(99, "b0", []), (98, None, ["gadget"])]
    chunks = [(f"b{k % 2}", k, k // 3, k % 5 + 1, ["theorem", "proof", "narrative"][k % 3], tags[k * 5 % len(tags)][: k % 3], texts[k // 2 % len(texts)]) for k in range(60)]
    return (
        spark.createDataFrame(citing, "span_id long, target_book string, tags array<string>"),
        spark.createDataFrame(chunks, "book_id string, chunk_id long, chunk_index int, page_number long, structural_type string, tags array<string>, text string"),
    )


@pytest.mark.parametrize("sent", [matching.SENT, -1] if hasattr(matching, "SENT") else [None])
@pytest.mark.parametrize("least", [0.1, 1.0])
def test_best_targets_are_those_of_all_pairs(spark, monkeypatch, sent, least):
    from inkweave.functions import concepts

    monkeypatch.setattr(matching, "SENT", sent, raising=False)
    citing, chunks = cited_library(spark)
    c = chunks.filter(~identifiers.is_bibliography_text(F.col("text"))).withColumnRenamed("tags", "theirs")
    pairs = citing.filter("size(tags) > 0").crossJoin(c).filter("target_book = book_id")
    overlap = concepts.overlap(concepts.concepts_of_all(F.col("tags")), concepts.concepts_of_all(F.col("theirs")))
    pairs = pairs.withColumn("overlap", overlap).withColumn("hits", matching.tag_text_score(F.col("tags"), F.col("text"))).filter("overlap > 0 or hits > 0")
    direct = F.expr("size(array_intersect(transform(tags, t -> lower(t)), transform(theirs, t -> lower(t))))")
    score = matching.target_score(F.col("overlap"), direct, F.col("hits"), F.col("page_number"), F.col("structural_type"), F.col("chunk_index"))
    want = {}
    for r in pairs.withColumn("score", F.round(score, 6)).collect():
        if r.score >= least:
            want[r.span_id] = min(want.get(r.span_id, (0,)), (-r.score, r.chunk_id, r.overlap, r.target_book))
    got = {r.span_id: (-r.score, r.chunk_id, r.overlap, r.target_book) for r in matching.best_targets(citing, chunks, least).collect()}
    assert got == want and len(want) >= 12


def test_a_tag_inside_a_longer_word_is_found(spark):
    citing = spark.sql("select 1L as span_id, 'b' as target_book, array('gadget') as tags union all select 2L, 'b', array('ab_cd')")
    chunks = spark.sql("select 'b' as book_id, 5L as chunk_id, 0 as chunk_index, 1L as page_number, 'proof' as structural_type, array('other') as tags, 'zab cdx and xgadgets' as text")
    assert sorted((r.span_id, r.chunk_id) for r in matching.best_targets(citing, chunks, 0.1).collect()) == [(1, 5), (2, 5)]


def test_chunks_are_scored_where_they_are_made(spark):
    """Few asking sets: no text and no key of a text is shuffled or sorted, and what chunks are searched for is computed once."""
    citing, chunks = cited_library(spark)
    plan = physical(matching.best_targets(citing, chunks.repartition(3, "chunk_id")))
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not [line for line in dealt if ", k#" in line] and sum("(chunk_id#" in line for line in dealt) == 1
    assert plan.count("(?<![a-z0-9])[a-z0-9]{4}") == 1 and not [line for line in plan.splitlines() if "SortMergeJoin" in line and "own#" not in line]


@pytest.mark.parametrize("name", ["lexical_edges", "lexical_target"])
def test_edges_write_no_texts(spark, monkeypatch, name):
    from inkweave.plans import catalog, matching_queries

    written, plain = [], matching_queries.stage
    monkeypatch.setattr(matching_queries, "stage", lambda df, what: (written.append(df.columns), plain(df, what))[1])
    catalog.load()[name].run(spark, "/root/testdata/sf0.001")
    assert written and not [c for columns in written for c in columns if "text" in c]


def test_concepts_are_those_with_a_marker_inside(spark):
    """Shorter patterns, the same concepts: each marker alone, inside others, cut by a letter."""
    from inkweave.functions import concepts

    marks = sorted({m for ms in concepts.CONCEPTS.values() for m in ms})
    tags = marks + [f"x{m}s" for m in marks] + [m[1:] for m in marks] + [m[:-1] for m in marks] + ["".join(marks), "Plain", ""]
    got = {r.t: r.c for r in spark.createDataFrame([(t,) for t in tags], "t string").select("t", concepts.concepts_of(F.col("t")).alias("c")).collect()}
    assert got == {t: [k for k, ms in concepts.CONCEPTS.items() if any(m in t.lower() for m in ms)] or [t.lower()] for t in tags}
