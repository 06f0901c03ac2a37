"""Queries over bibliographies, citations, typed edges and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweave.functions import identifiers, scales
from inkweave.operators import matching as M
from inkweave.operators import vectors as V
from inkweave.plans.catalog import query
from inkweave.plans.fixtures import DUCK_CHUNKS, DUCK_EDGES, DUCK_SPANS, chunks, documents, duck_pick, edges, pick, q, spans
from inkweave.plans.graph_queries import _REL_MAP
from inkweave.plans.knowledge_queries import _PAIRS, _asked, _ranked, _rows
from inkweave.plans.text_queries import duck_concepts
from inkweave.sources.tables import stage

_BIB = "[1] A. Author, A title, JHEP 01 (2015) 2, arXiv:15' || (10 + doc_id % 3) || '.' || (10000 + doc_id % 40) || ' [2] B. Bee and C. Sea, Phys. Rev. (19' || (60 + doc_id % 40) || ') doi:10.1007/x' || (doc_id % 25) || '. [3]  [4] no year here"


def _bibliography(spark, sf):
    n = F.col("doc_id")
    s = lambda c: c.cast("string")
    t = F.concat(
        F.lit("[1] A. Author, A title, JHEP 01 (2015) 2, arXiv:15"), s(n % 3 + 10), F.lit("."), s(n % 40 + 10000), F.lit(" [2] B. Bee and C. Sea, Phys. Rev. (19"), s(n % 40 + 60),
        F.lit(") doi:10.1007/x"), s(n % 25), F.lit(". [3]  [4] no year here"),
    )
    rows = documents(spark, sf).select(n.alias("book_id"), F.explode(identifiers.bibliography_entries(t)).alias("e")).select("book_id", "e.*")
    return rows


_ENTRIES = """en AS (SELECT doc_id AS book_id, '1' AS key, 'A. Author, A title' AS authors, 2015 AS year, '15' || (10 + doc_id % 3) || '.' || (10000 + doc_id % 40) AS arxiv_id, NULL AS doi FROM documents
 UNION ALL SELECT doc_id, '2', 'B. Bee and C. Sea', 1960 + (doc_id % 40)::int, NULL, '10.1007/x' || (doc_id % 25) FROM documents UNION ALL SELECT doc_id, '3', '[4] no year here', NULL, NULL, NULL FROM documents)"""


@query("bib_parse", "D-4", f"WITH {_ENTRIES} SELECT book_id, key, authors, year, arxiv_id, doi FROM en")
def bib_parse(spark, sf):
    return _bibliography(spark, sf).select("book_id", "key", "authors", "year", "arxiv_id", "doi")


def _books(spark, sf):
    n = F.col("doc_id")
    s = lambda c: c.cast("string")
    arxiv = F.when(n % 3 == 0, F.concat(F.lit("15"), s(n % 3 + 10), F.lit("."), s(n % 40 + 10000)))
    return documents(spark, sf).select(n.alias("book_id"), arxiv.alias("arxiv_id"), F.when(n % 4 == 1, F.concat(F.lit("10.1007/x"), s(n % 50))).alias("doi"))


_MATCHED = f"""{_ENTRIES}, bk AS (SELECT doc_id AS book_id, CASE WHEN doc_id % 3 = 0 THEN '15' || (10 + doc_id % 3) || '.' || (10000 + doc_id % 40) END AS arxiv_id, CASE WHEN doc_id % 4 = 1 THEN '10.1007/x' || (doc_id % 50) END AS doi FROM documents),
ax AS (SELECT arxiv_id, min(book_id) AS b FROM bk WHERE arxiv_id IS NOT NULL GROUP BY 1), dx AS (SELECT doi, min(book_id) AS b FROM bk WHERE doi IS NOT NULL GROUP BY 1),
mt AS (SELECT en.*, coalesce(CASE WHEN ax.b <> en.book_id THEN ax.b END, CASE WHEN dx.b <> en.book_id THEN dx.b END) AS resolved_book FROM en LEFT JOIN ax ON ax.arxiv_id = en.arxiv_id LEFT JOIN dx ON dx.doi = en.doi)"""


def _matched(spark, sf):
    return M.resolve_entries(_bibliography(spark, sf), _books(spark, sf))


@query("bib_match", "D-7 D-9", f"WITH {_MATCHED} SELECT book_id, key, resolved_book FROM mt")
def bib_match(spark, sf):
    return _matched(spark, sf).select("book_id", "key", "resolved_book")


@query("stub_create", "D-8", f"WITH {_MATCHED} SELECT coalesce(arxiv_id, doi) AS identifier, min(book_id) AS book_id, count(*) AS n FROM mt WHERE resolved_book IS NULL AND coalesce(arxiv_id, doi) IS NOT NULL GROUP BY 1")
def stub_create(spark, sf):
    return M.stubs(_matched(spark, sf)).select("identifier", "book_id", "n")


@query("stub_reconcile", "D-10", f"WITH {_MATCHED} SELECT book_id, key, CASE WHEN resolved_book % 2 = 0 THEN resolved_book + 100000 ELSE resolved_book END AS resolved_book FROM mt WHERE resolved_book IS NOT NULL")
def stub_reconcile(spark, sf):
    stubs = documents(spark, sf).filter("doc_id % 2 = 0").select(F.col("doc_id").alias("stub"), (F.col("doc_id") + 100000).alias("book"))
    return M.reconcile(_matched(spark, sf).filter("resolved_book is not null"), stubs).select("book_id", "key", "resolved_book")


@query("bib_page_locate", "D-5", r"""WITH p AS (SELECT doc_id // 20 AS book, doc_id AS page, CASE WHEN doc_id % 20 >= 17 THEN text || ' [' || (doc_id % 20 - 16) || '] A. B' ELSE text END AS t FROM documents),
f AS (SELECT book, min(page) AS first FROM p WHERE page % 20 >= 10 AND regexp_matches(t, '\[1\]') GROUP BY 1) SELECT book, first AS first_page, string_agg(page::varchar, ',' ORDER BY page) AS pages FROM p JOIN f USING (book) WHERE page >= first GROUP BY 1, 2""")
def bib_page_locate(spark, sf):
    """In the last ten pages of twenty the first that holds [1], and all from there on."""
    n = F.col("doc_id")
    p = documents(spark, sf).select(F.floor(n / 20).alias("book"), n.alias("page"), F.when(n % 20 >= 17, F.concat("text", F.lit(" ["), (n % 20 - 16).cast("string"), F.lit("] A. B"))).otherwise(F.col("text")).alias("t"))
    first = p.filter((F.col("page") % 20 >= 10) & F.contains("t", F.lit("[1]"))).groupBy("book").agg(F.min("page").alias("first_page"))
    rest = p.join(first, "book").filter("page >= first_page")
    return rest.groupBy("book", "first_page").agg(F.array_join(F.array_sort(F.collect_list("page")).cast("array<string>"), ",").alias("pages"))


@query("bib_page_exclusion", "D-14", rf"""WITH c AS (SELECT chunk_id, book_id, page_number, CASE WHEN page_number % 6 = 0 AND chunk_index <> 0 OR chunk_id % 11 = 0 THEN '[1] A. Bee [2] C. Dee [3] E. Eff [4] x' ELSE text END AS t FROM {DUCK_CHUNKS}),
m AS (SELECT *, len(regexp_extract_all(t, '\[\d+\]')) >= 4 OR (len(regexp_extract_all(t, '\[\d+\]')) >= 2 AND len(regexp_extract_all(t, '\[\d+\]')) * 200 > length(t)) AS bib, avg(0) OVER () AS z FROM c),
g AS (SELECT *, avg(bib::int) OVER (PARTITION BY page_number) AS r FROM m) SELECT chunk_id FROM g WHERE NOT bib AND length(trim(t)) >= 40 AND r < 0.6""")
def bib_page_exclusion(spark, sf):
    t = F.when(((F.col("page_number") % 6 == 0) & (F.col("chunk_index") != 0)) | (F.col("chunk_id") % 11 == 0), "[1] A. Bee [2] C. Dee [3] E. Eff [4] x").otherwise(F.col("text"))
    return M.without_bibliography(chunks(spark, sf).withColumn("text", t)).select("chunk_id")


@query("citation_span_completion", "D-15 D-16", """WITH k AS (SELECT doc_id, unnest([doc_id % 7 + 1, doc_id % 7 + 2, doc_id % 7 + 4]) AS key, unnest([1, 1, 2]) AS s FROM documents)
SELECT doc_id AS page_id, s AS sentence, string_agg(key::varchar, ',' ORDER BY key::varchar) AS keys FROM k WHERE NOT (key = doc_id % 5 + 1) GROUP BY 1, 2""")
def citation_span_completion(spark, sf):
    """Two citing sentences stand before each text; one key is covered by a span already."""
    n = F.col("doc_id")
    s = lambda c: c.cast("string")
    t = F.concat(F.lit("As in ["), s(n % 7 + 1), F.lit("-"), s(n % 7 + 2), F.lit("]. Again ["), s(n % 7 + 2), F.lit(", "), s(n % 7 + 4), F.lit("]. "), F.col("text"))
    covered = documents(spark, sf).select(n.alias("page_id"), s(n % 5 + 1).alias("key"))
    return M.complete_citations(documents(spark, sf).select(n.alias("page_id"), t.alias("text")), covered).select("page_id", "sentence", F.array_join("keys", ",").alias("keys"))


_TEXT = "CASE WHEN chunk_id % 3 = 0 THEN text || ' soft limits checked' ELSE text END"
_HIT = """len(list_filter(tags, lambda g: contains(lower(t), replace(g, '_', ' ')) OR (len(list_filter(string_split(g, '_'), lambda p: length(p) >= 4)) > 0 AND
 len(list_filter(list_filter(string_split(g, '_'), lambda p: length(p) >= 4), lambda p: len(list_filter(w, lambda x: starts_with(x, p[:4]))) = 0)) = 0)))"""


@query("tag_text_score", "G6", f"SELECT chunk_id, {_HIT} AS hits FROM (SELECT chunk_id, tags, t, list_filter(string_split_regex(lower(t), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM (SELECT chunk_id, tags, {_TEXT} AS t FROM {DUCK_CHUNKS}))")
def tag_text_score(spark, sf):
    t = F.when(F.col("chunk_id") % 3 == 0, F.concat("text", F.lit(" soft limits checked"))).otherwise(F.col("text"))
    return chunks(spark, sf).select("chunk_id", M.tag_text_score(F.col("tags"), t).cast("long").alias("hits"))


def _citing(spark, sf):
    """Citing spans (class S), each to the book whose number follows its page's; written once, without their texts."""
    rows = spans(spark, sf).filter("search_class = 'S' and role = 'citation'").withColumn("target_book", F.concat(F.lit("src"), ((F.col("page_number") * 7 + 1) % 20).cast("string")))
    return stage(rows.select("span_id", "book_id", "role", "sentence", "tags", "target_book"), "citing")


def _target_chunks(spark, sf):
    return chunks(spark, sf).withColumn("tags", F.slice("tags", 1, 3))


_TARGETS = f"""ct AS MATERIALIZED (SELECT span_id, book_id AS src, role, sentence, tags AS own, 'src' || ((page_number * 7 + 1) % 20) AS book_id FROM {DUCK_SPANS} WHERE search_class = 'S' AND role = 'citation'),
tc AS MATERIALIZED (SELECT chunk_id, book_id, chunk_index, page_number, structural_type, tags[:3] AS tags, text AS t, list_distinct(list_transform(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) >= 4), lambda x: x[:4])) AS w, list_distinct(flatten(list_transform(tags[:3], lambda x: {duck_concepts('x')}))) AS cs FROM {DUCK_CHUNKS}),
oc AS MATERIALIZED (SELECT *, list_distinct(flatten(list_transform(own, lambda x: {duck_concepts('x')}))) AS os FROM ct),
sc AS (SELECT span_id, src, role, sentence, oc.book_id AS target_book, chunk_id, len(list_intersect(os, cs)) AS overlap, len(list_intersect(own, tc.tags)) AS direct, {_HIT.replace('(tags,', '(own,').replace('lower(t)', 'lower(tc.t)')} AS hits, page_number, structural_type, chunk_index FROM oc JOIN tc ON oc.book_id = tc.book_id),
sd AS (SELECT *, round(overlap + CASE page_number WHEN 1 THEN 0 WHEN 2 THEN 0.05 WHEN 3 THEN 0.1 ELSE 0.15 END + CASE WHEN overlap >= 2 THEN CASE WHEN structural_type IN ('definition', 'theorem') THEN 0.15 WHEN structural_type = 'proof' THEN 0.1 ELSE 0 END ELSE 0 END + greatest(0, 0.01 - 0.00001 * chunk_index) + least(1.5, 0.4 * hits) + direct * 0.5, 6) AS score FROM sc WHERE overlap > 0 OR hits > 0),
bt AS MATERIALIZED (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY span_id, target_book ORDER BY score DESC, chunk_id) AS r FROM sd) WHERE r = 1 AND score >= 1)"""


@query("lexical_target", "G7", f"WITH {_TARGETS} SELECT span_id, target_book, chunk_id, overlap, score FROM bt")
def lexical_target(spark, sf):
    return M.best_targets(_citing(spark, sf), _target_chunks(spark, sf))


@query("lexical_edges", "G11 G12", f"""WITH {_TARGETS}, l AS (SELECT *, CASE WHEN overlap >= 4 THEN 'a' WHEN overlap = 3 THEN 'c' WHEN overlap = 2 THEN 'f' WHEN overlap = 1 THEN 'j' ELSE 'z' END AS confidence FROM bt),
r AS (SELECT *, row_number() OVER (PARTITION BY src, chunk_id ORDER BY confidence, score DESC, sentence, span_id) AS r FROM l)
SELECT src AS book_id, chunk_id, any_value(span_id) FILTER (r = 1) AS span_id, any_value(confidence) FILTER (r = 1) AS confidence, coalesce(string_agg(span_id::varchar, ',' ORDER BY span_id) FILTER (r > 1), '') AS related FROM r GROUP BY 1, 2""")
def lexical_edges(spark, sf):
    """Texts are cut twice, for the few citing spans and for the chunks: that costs less than to write and read them all."""
    citing = _citing(spark, sf)
    targets = stage(M.best_targets(citing, _target_chunks(spark, sf)), "targets")
    made = M.lexical_edges(targets, citing.select("span_id", "book_id", "role", "sentence"))
    return made.select("book_id", "chunk_id", "span_id", "confidence", F.array_join(F.col("related").cast("array<string>"), ",").alias("related"))


_VERDICT = "CASE WHEN query_id % 500 = 200 THEN 'x' ELSE chr((97 + query_id // 100 % 12)::int) END || 'e' || chr((97 + query_id // 100 * 7 % 26)::int) || chr((97 + (query_id // 100 * 11 + 9) % 26)::int)"


@query("funnel_edges", "G16 G18", f"""WITH {_PAIRS}, f AS ({_ranked('pr', 25)}), v AS (SELECT DISTINCT query_id, {_VERDICT} AS v FROM f)
SELECT query_id, id, v[3] AS confidence, v[4] AS relevance FROM f JOIN v USING (query_id) WHERE v[1] <> 'x' AND rank = ascii(v[1]) - 96 AND v[3] >= 'f' AND v[4] >= 'f' AND ((ascii(v[3]) - 96.5) / 26) * ((ascii(v[4]) - 96.5) / 26) >= 0.10""")
def funnel_edges(spark, sf):
    found = V.top_k(_rows(spark, sf).drop("label"), _asked(spark, sf).drop("label"), 25)
    n = F.floor(F.col("query_id") / 100)
    v = F.concat(F.when(F.col("query_id") % 500 == 200, "x").otherwise(F.char(n % 12 + 97)), F.lit("e"), F.char(n * 7 % 26 + 97), F.char((n * 11 + 9) % 26 + 97))
    return M.funnel_edges(found, _asked(spark, sf).select("query_id", v.alias("verdict"))).select("query_id", "id", "confidence", "relevance")


_RANKING = "query_id // 100 % 20 + 1, (query_id // 100 * 3 + 7) % 26 + 1"


@query("model_rank", "G13 (stand-in)", f"""WITH {_PAIRS}, f AS ({_ranked('pr', 25)}), v AS (SELECT query_id, unnest([{_RANKING}]) AS rank, unnest([1, 2]) AS place, unnest([chr((97 + query_id // 100 * 5 % 26)::int), chr((97 + query_id // 100 * 11 % 26)::int)]) AS confidence FROM (SELECT DISTINCT query_id FROM f))
SELECT query_id, id, place, confidence FROM f JOIN v USING (query_id, rank)""")
def model_rank(spark, sf):
    """A verdict of two pairs of letters for each asking row, in place of the model that ranks."""
    n = F.floor(F.col("query_id") / 100)
    letter = lambda c: F.char(c % 26 + 97)
    coded = F.concat(F.char(n % 20 + 97), letter(n * 5), F.lit(" "), letter(n * 3 + 7), letter(n * 11))
    found = V.top_k(_rows(spark, sf).drop("label"), _asked(spark, sf).drop("label"), 25)
    return M.ranked_by_verdict(found, _asked(spark, sf).select("query_id", coded.alias("verdict")))


@query("model_classify", "G14 (stand-in)", f"""WITH {_PAIRS}, f AS ({_ranked('pr', 1)}) SELECT query_id, id, coalesce({_REL_MAP}[chr((97 + query_id // 100 * 3 % 26)::int)], 'assumes') AS relation, chr((97 + query_id // 100 * 5 % 26)::int) AS confidence, chr((97 + query_id // 100 * 7 % 26)::int) AS relevance FROM f""")
def model_classify(spark, sf):
    """Three letters for each asking row and its nearest one, in place of the model that classifies."""
    n = F.floor(F.col("query_id") / 100)
    letter = lambda c: F.char(c % 26 + 97)
    pairs = V.top_k(_rows(spark, sf).drop("label"), _asked(spark, sf).drop("label"), 1)
    return M.classified(pairs, _asked(spark, sf).select("query_id", F.concat(letter(n * 3), letter(n * 5), letter(n * 7)).alias("verdict")))


@query("page_tag_context", "G20", f"""WITH t AS (SELECT page_number, tag, count(*) AS n FROM (SELECT page_number, unnest(tags[:6]) AS tag FROM {DUCK_CHUNKS}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY n DESC, tag) AS r FROM t)
SELECT page_number, string_agg(tag, ', ' ORDER BY r) AS tags FROM r WHERE r <= 8 GROUP BY 1""")
def page_tag_context(spark, sf):
    return M.page_tags(chunks(spark, sf)).select("page_number", "tags")


@query("note_match", "G21 G5", f"WITH {_PAIRS}, f AS ({_ranked('pr', 25, 'la <> lb')}), g AS (SELECT *, max(cosine) OVER (PARTITION BY query_id) AS best FROM f) SELECT query_id, id, rank FROM g WHERE best >= 0.25")
def note_match(spark, sf):
    """All asking vectors as chunks of notes, against the vectors of all other books; a vector's book is its label."""
    found = V.top_k(_rows(spark, sf), _asked(spark, sf), 25, apart="label")
    return V.above_floor(found, 0.25).select("query_id", "id", "rank")


@query("gap_fill", "G22", f"WITH {_PAIRS}, f AS ({_ranked('pr', 5, 'query_id NOT IN (SELECT query_id FROM pr WHERE cosine >= 0.5)')}) SELECT query_id, id, rank FROM f")
def gap_fill(spark, sf):
    """Asking rows that nothing covers (no cosine of 0.5) get their five nearest."""
    found = V.top_k(_rows(spark, sf).drop("label"), _asked(spark, sf).drop("label"), 5)
    return V.below(found, 0.5).select("query_id", "id", "rank")


@query("coverage_report", "G23", f"SELECT book_id, count(*) AS chunks, count(*) FILTER (hit) AS covered, round(count(*) FILTER (hit) / count(*)::double, 6) AS ratio FROM (SELECT c.book_id, c.chunk_id IN (SELECT to_chunk FROM {DUCK_EDGES} WHERE list_contains(['extends', 'proves'], relation)) AS hit FROM {DUCK_CHUNKS} c) GROUP BY 1")
def coverage_report(spark, sf):
    hit = edges(spark, sf).filter(F.array_contains(F.array(F.lit("extends"), F.lit("proves")), F.col("relation"))).select(F.col("to_chunk").alias("chunk_id")).distinct().withColumn("hit", F.lit(1))
    rows = chunks(spark, sf).select("chunk_id", "book_id").join(hit, "chunk_id", "left")
    return rows.groupBy("book_id").agg(F.count("*").alias("chunks"), F.count("hit").alias("covered"), F.round(F.count("hit") / F.count("*"), 6).alias("ratio"))


_ITEMS = "it AS (SELECT doc_id AS item_id, CASE WHEN doc_id % 9 = 0 THEN []::bigint[] WHEN doc_id % 2 = 0 THEN [doc_id, doc_id + 3] ELSE [doc_id * 2] END AS tp, [doc_id + 8 + doc_id % 13] AS sp FROM documents)"


def _coverage_sql(tw: int, nw: int, strict: bool) -> str:
    typed = " AND relation <> 'annotates'" if strict else ""
    return f"""WITH {_ITEMS}, e AS (SELECT from_page, to_page, relation FROM {DUCK_EDGES}),
s AS (SELECT item_id, tp, (SELECT count(*) FROM e WHERE len(list_filter(tp, lambda x: abs(x - to_page) <= {tw})) > 0) AS on_target, (SELECT count(*) FROM e WHERE len(list_filter(sp, lambda x: abs(x - from_page) <= {nw})) > 0) AS seen,
 (SELECT count(*) FROM e WHERE len(list_filter(tp, lambda x: abs(x - to_page) <= {tw})) > 0 AND len(list_filter(sp, lambda x: abs(x - from_page) <= {nw})) > 0{typed}) AS both_ FROM it)
SELECT item_id, CASE WHEN len(tp) = 0 THEN CASE WHEN seen > 0 THEN 'COVERED' ELSE 'MISSING' END WHEN on_target = 0 THEN CASE WHEN seen > 0 THEN 'WRONG_TARGET' ELSE 'MISSING' END WHEN both_ > 0 THEN 'COVERED' ELSE 'PARTIAL' END AS status FROM s"""


def _coverage(spark, sf, *args):
    n = F.col("doc_id")
    targets = F.when(n % 9 == 0, F.expr("cast(array() as array<bigint>)")).when(n % 2 == 0, F.array(n, n + 3)).otherwise(F.array(n * 2))
    items = documents(spark, sf).select(n.alias("item_id"), targets.alias("target_pages"), F.array(n + 8 + n % 13).alias("source_pages"))
    return M.score_coverage(items, edges(spark, sf).select(F.col("from_page").alias("source_page"), F.col("to_page").alias("target_page"), "relation"), *args)


@query("coverage_score", "K14", _coverage_sql(1, 5, False))
def coverage_score(spark, sf):
    return _coverage(spark, sf, 1, 5)


@query("coverage_score_strict", "K14", _coverage_sql(0, 2, True))
def coverage_score_strict(spark, sf):
    return _coverage(spark, sf, 0, 2, True)
