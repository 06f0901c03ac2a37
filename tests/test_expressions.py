"""Golden values of pure expressions, and invariants of the operators."""

import pytest
from pyspark.sql import functions as F

from inkweave.functions import concepts, identifiers, scales, text, vectors
from inkweave.operators import graph, ingest, matching, quality, segments


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "column,expected",
    [
        (lambda: text.sentences(F.lit("A. B.\n\nC")), ["A.", "B.", "C"]),
        (lambda: text.sentences(F.lit(None).cast("string")), []),
        (lambda: text.mark_sentences(F.lit("A. B. C.")), "A;; B;; C."),
        (lambda: text.mark_sentences(F.lit("A. $x$. C.")), "A. $x$. C."),
        (lambda: text.snake_form(F.lit("Britto–Cachazo Shift!")), "britto_cachazo_shift"),
        (lambda: text.hyphen_form(F.lit("Britto–Cachazo Shift!")), "britto-cachazo shift"),
        (lambda: text.html_to_text(F.lit("<p>a&amp;lt;b</p><br/>c")), "a<b\n\nc"),
        (lambda: identifiers.arxiv_id(F.lit("arXiv:2312.16282v3")), "2312.16282"),
        (lambda: identifiers.arxiv_id(F.lit("hep-th/0403047")), "hep-th/0403047"),
        (lambda: identifiers.arxiv_id(F.lit("math.AG/0512411")), "math.ag/0512411"),
        (lambda: identifiers.arxiv_id(F.lit("15")), None),
        (lambda: identifiers.doi(F.lit("https://doi.org/10.1007/JHEP03(2025)154")), "10.1007/jhep03(2025)154"),
        (lambda: identifiers.citation_keys(F.lit("see [26-28] and [5, 6]")), ["26", "27", "28", "5", "6"]),
        (lambda: identifiers.citation_keys(F.lit("[22, 23-25]")), ["22"]),
        (lambda: identifiers.citation_keys(F.lit("[31-26] [1 2]")), []),
        (lambda: concepts.normal_term(F.lit(" QFT ")), "quantum field theory"),
        (lambda: concepts.concepts_of(F.lit("zero_causal_diamond_factorization")), ["hidden_zeros", "factorization", "causal_diamond"]),
        (lambda: concepts.concepts_of(F.lit("Some_Unknown")), ["some_unknown"]),
        (lambda: scales.fraction_letter(F.lit(0.0)), "a"),
        (lambda: scales.fraction_letter(F.lit(0.5)), "m"),
        (lambda: scales.fraction_letter(F.lit(1.0)), "z"),
        (lambda: scales.path_weight(F.lit("z")), 1),
        (lambda: scales.path_weight(F.lit("?")), 26),
        (lambda: scales.path_weight(F.lit(None).cast("string")), 26),
        (lambda: scales.overlap_letter(F.lit(4)), "a"),
        (lambda: scales.overlap_letter(F.lit(0)), "z"),
        (lambda: scales.role_relation(F.lit(None).cast("string")), "assumes"),
        (lambda: vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0))), 1.0),
        (lambda: vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(2.0))), 0.0),
        (lambda: matching.tag_text_score(F.array(F.lit("soft_limits"), F.lit("bcfw")), F.lit("softly limited things")), 1),
    ],
)
def test_golden(spark, column, expected):
    assert one(spark, column()) == expected


_HTML = "<h2>A &amp; B</h2><p>x  y<br>z&nbsp;&lt;w</p><div>d</div><ul><li>e</li></ul>"


@pytest.mark.parametrize(
    "way,expected",
    [
        ("spans", "A & B\n\n x y\nz <w\n\n d\n e"),
        ("pages", "A & B\n\nx  y\nz <w\n\nd\ne"),
        ("repair", "A & B\n\nx y\nz <w\n\nd\n\ne"),
        ("notes", "A & Bx  y\nz <w\nd\ne"),
        ("reprocess", "A & Bx  y\nz <w\n\nd\ne"),
    ],
)
def test_html_to_text_ways(spark, way, expected):
    assert one(spark, text.html_to_text(F.lit(_HTML), way)) == expected


@pytest.mark.parametrize("line,expected", [("QUANTUM FIELDS, REVISITED", True), ("AB CD EF GH IJ", True), ("ABCDE, FGH", True), ("ABCD, FGH", False), ("A, B, C, D, E", False), ("QUANTUM-FIELDS", False), ("Quantum FIELDS HERE", False)])
def test_headings_in_capitals(spark, line, expected):
    assert one(spark, text.is_heading(F.lit(line))) is expected


@pytest.mark.parametrize("words,expected", [("These are", True), (" it holds", True), ("Furthermore, x", True), ("Theseus", False), ("A cat. It sat", False), (None, False)])
def test_anaphors(spark, words, expected):
    assert one(spark, text.starts_with_anaphor(F.lit(words).cast("string"))) is expected


def test_codecs(spark):
    assert [tuple(r) for r in one(spark, scales.decode_ranking(F.lit("ez ct")))] == [(5, "z", 25.5 / 26), (3, "t", 19.5 / 26)]
    assert [tuple(r)[:3] for r in one(spark, scales.decode_classification(F.lit("epz cdm")))] == [("extends", "p", "z"), ("contradicts", "d", "m")]
    assert tuple(one(spark, scales.decode_pick(F.lit("nepz")))) == (False, 14, "extends", "p", "z")
    assert one(spark, scales.decode_pick(F.lit("xxxx")))["rejected"] and one(spark, scales.decode_pick(F.lit("ab"))) is None


@pytest.mark.parametrize(
    "line,expected",
    [
        ("1 hidden_zeros tr_phi3_conjecture citation S", (1, 1, ["hidden_zeros", "tr_phi3_conjecture"], "citation", [], "S", None, None)),
        ("3 hidden_zero_identity proof r3.2 Iv", (3, 3, ["hidden_zero_identity"], "proof", [("r", 3, 2)], "I", "v", None)),
        ("8 d_subset_construction definition Ld Lv", (8, 8, ["d_subset_construction"], "definition", [], "L", None, "derivation")),
        ("5 x_tag c5", (5, 5, ["x_tag"], None, [("c", 5, 0)], "N", None, None)),
    ],
)
def test_span_language(spark, line, expected):
    (s,) = one(spark, segments.parse_spans(F.lit(line)))
    assert (s.start, s.end, s.tags, s.role, [tuple(d) for d in s.declared], s.search_class, s.confidence, s.gap) == expected


@pytest.mark.parametrize("line", ["# note", "7", "foo bar", ""])
def test_span_language_skips(spark, line):
    assert one(spark, segments.parse_spans(F.lit(line))) == []


def test_folded_chunks_partition_the_spans(spark):
    rows = [(1, p, p * 100 + i, i, i, ["t"], f"{'This' if i % 5 == 0 else 'x'} {i}", i % 11 == 0) for p in (1, 2) for i in range(1, 41)]
    s = spark.createDataFrame(rows, "book_id long, page_number long, span_id long, start int, end int, tags array<string>, span_text string, declarative boolean")
    s = s.withColumn("notes", F.expr("array(named_struct('kind', 'theorem', 'start', 7), named_struct('kind', 'proof', 'start', 8))"))
    out = segments.fold_chunks(s).collect()
    assert sorted(r.span_id for r in out) == sorted(r[2] for r in rows)
    by = {}
    for r in sorted(out, key=lambda r: r.span_id):
        by.setdefault(r.page_number, []).append(r.chunk_index)
    for index in by.values():
        assert index == sorted(index) and index[0] == 0
        assert index[5] != index[6] and index[6] == index[7], "a theorem starts a chunk and keeps its proof"


def test_paths_and_chains(spark):
    e = spark.createDataFrame([(1, 1, 2, "z", "a"), (2, 2, 3, "z", "a"), (3, 1, 3, "a", "a")], "edge_id long, from_chunk long, to_chunk long, confidence string, relevance string")
    seeds = spark.createDataFrame([(1,)], "chunk_id long")
    found = {r.chunk_id: (r.weight, r.path) for r in graph.shortest_paths(e, seeds, 5).collect()}
    assert found == {1: (0, [1]), 2: (1, [1, 2]), 3: (2, [1, 2, 3])}
    nodes = spark.createDataFrame([(k,) for k in range(1, 13)], "id long")
    following = spark.createDataFrame([(1, 2), (2, 1), *[(k, k + 1) for k in range(3, 12)]], "id long, next long")
    ends = {r.id: r.resolved for r in graph.resolve_chains(nodes, following).collect()}
    assert ends[1] == 1 and ends[2] == 2 and ends[3] == 11 and ends[12] == 12


def test_guarded_swap_and_split(spark):
    stored = spark.createDataFrame([("a", 0), ("b", 0)], "k string, v int")
    arriving = spark.createDataFrame([("a", i, i < 5) for i in range(20)] + [("b", 1, False)], "k string, v int, bad boolean")
    out = ingest.guarded_swap(stored, arriving, "k", "bad").collect()
    assert [(r.k, r.v) for r in out if r.k == "a"] == [("a", 0)] and [(r.k, r.v) for r in out if r.k == "b"] == [("b", 1)]


def test_range_join_counts_each_pair_once(spark):
    h = spark.createDataFrame([(1, 1, 0, 1200), (1, 2, 499, 501)], "page_id long, highlight_id long, start long, end long")
    s = spark.createDataFrame([(1, k, k * 100, k * 100 + 150) for k in range(20)], "page_id long, span_id long, start long, end long")
    got = sorted((r.highlight_id, r.span_id) for r in quality.overlapping(h, s).collect())
    assert got == sorted((a, k) for a, lo, hi in ((1, 0, 1200), (2, 499, 501)) for k in range(20) if k * 100 + 150 > lo and k * 100 < hi)


def test_csv_and_file_source(spark, tmp_path):
    ingest.write_csv(spark.createDataFrame([(1, 'a "b", c')], "id int, t string"), str(tmp_path / "out"))
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out")).collect()
    assert [(r.id, r.t) for r in back] == [("1", 'a "b", c')]
    for n in (1, 3):
        (tmp_path / f"page-{n}.png").write_bytes(b"x")
    done = spark.createDataFrame([(1,)], "page_number int")
    assert [r.page_number for r in ingest.unprocessed_pages(ingest.files(spark, str(tmp_path), "*.png"), done).collect()] == [3]
