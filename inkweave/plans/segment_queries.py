"""Queries over spans and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweave.functions import text
from inkweave.operators import segments
from inkweave.plans.catalog import query
from inkweave.plans.fixtures import DUCK, DUCK_CHUNKS, DUCK_SPANS, chunks, documents, pick, q, spans, tag_of

# spans with references back, declarative tags, gaps and annotated pages
_N = "(page_number * 3 + sentence)"


def _rich_spans(spark, sf):
    n = F.col("page_number") * 3 + F.col("sentence")
    rows = spans(spark, sf).withColumn("n", n)
    rows = rows.withColumn("start", (F.col("sentence") + 5 * F.floor(F.col("sentence") / 13)).cast("int")).withColumn("end", F.when(F.col("n") % 7 == 3, F.col("start") + 1).otherwise(F.col("start")))
    rows = rows.withColumn("span_text", F.concat(F.when(F.col("n") % 9 == 4, "This ").otherwise(""), F.col("span_text"))).withColumn("declarative", F.col("n") % 23 == 0)
    rows = rows.withColumn("tags", F.when(F.col("n") % 5 == 0, F.col("tags")).otherwise(F.array(F.lit("plain_note"))))
    note = lambda k, kind: F.struct(F.lit(kind).alias("kind"), (F.col("page_number") % 4 + k).cast("int").alias("start"))
    return rows.withColumn("notes", F.array(note(3, "theorem"), note(5, "proof"), note(9, "citation"), note(12, "example"))).drop("sentence")


_DUCK_RICH = f"""(SELECT span_id, book_id, page_number, (sentence + 5 * (sentence // 13))::int AS start, (sentence + 5 * (sentence // 13) + CASE WHEN {_N} % 7 = 3 THEN 1 ELSE 0 END)::int AS "end",
 CASE WHEN {_N} % 5 = 0 THEN tags ELSE ['plain_note'] END AS tags, search_class, CASE WHEN {_N} % 9 = 4 THEN 'This ' ELSE '' END || span_text AS span_text, {_N} % 23 = 0 AS declarative,
 [{{'kind': 'theorem', 'start': (page_number % 4 + 3)::int}}, {{'kind': 'proof', 'start': (page_number % 4 + 5)::int}}, {{'kind': 'citation', 'start': (page_number % 4 + 9)::int}}, {{'kind': 'example', 'start': (page_number % 4 + 12)::int}}] AS notes FROM {DUCK_SPANS})"""
_BOUND = "[" + ", ".join(q(b) for b in segments.BOUNDARIES) + "]"
_TAG_TYPE = "CASE WHEN t = 'theorem' OR suffix(t, '_theorem') OR t = 'lemma' THEN 'theorem' WHEN t = 'definition' OR suffix(t, '_definition') THEN 'definition' WHEN t = 'proof' THEN 'proof' WHEN t = 'example' OR suffix(t, '_example') THEN 'example' END"
_FOLD = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_number ORDER BY start, "end", span_id) AS k,
 list_contains([{', '.join(q(a) for a in text.ANAPHORS)}], lower(regexp_extract(span_text, '^\\p{{L}}+'))) AS back, list_filter(list_transform(tags, lambda t: {_TAG_TYPE}), lambda x: x IS NOT NULL)[1] AS kind,
 list_filter(notes, lambda n: n.start = start AND list_contains({_BOUND}, n.kind))[1].kind AS here FROM {_DUCK_RICH}),
f AS (SELECT page_number, span_id, k, 0 AS chunk_index, 1 AS size, start AS first, "end" AS last, kind AS cur FROM s WHERE k = 1
 UNION ALL SELECT page_number, span_id, k, CASE WHEN brk THEN chunk_index + 1 ELSE chunk_index END, CASE WHEN brk THEN 1 ELSE size + 1 END, CASE WHEN brk THEN start ELSE first END, "end", CASE WHEN brk THEN kind ELSE coalesce(cur, kind) END FROM (
 SELECT s.page_number, s.span_id, s.k, f.chunk_index, f.size, f.first, f.cur, s.start, s."end", s.kind, CASE WHEN s.start <= f.last THEN false WHEN s.back THEN false
 WHEN s.here IS NOT NULL THEN NOT (s.here = 'proof' AND coalesce(f.cur, list_filter(s.notes, lambda n: n.start BETWEEN f.first AND f.last AND list_contains({_BOUND}, n.kind))[1].kind, 'narrative') IN ('theorem', 'definition'))
 ELSE s.start - f.last > 3 OR f.size >= 8 OR s.declarative END AS brk FROM f JOIN s ON s.page_number = f.page_number AND s.k = f.k + 1))"""


@query("chunk_fold", "C19", f"{_FOLD} SELECT page_number, span_id, chunk_index FROM f")
def chunk_fold(spark, sf):
    return segments.fold_chunks(_rich_spans(spark, sf)).select("page_number", "span_id", "chunk_index")


@query("chunk_build", "C20 C17 C22", f"""{_FOLD}, g AS (SELECT f.page_number, f.chunk_index, s.* EXCLUDE (page_number) FROM f JOIN s USING (page_number, span_id))
SELECT page_number, chunk_index, min(start) AS start, arg_max("end", (start, "end", span_id)) AS "end", count(*) AS n_spans, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ',') AS tags, any_value(unresolved) AS unresolved, any_value(words) AS words,
 coalesce(any_value(kd), list_filter(any_value(notes), lambda n: n.start BETWEEN any_value(lo) AND any_value(hi) AND list_contains({_BOUND}, n.kind))[1].kind, 'narrative') AS structural_type FROM (
 SELECT *, flatten(list(tags) OVER w) AS t, list_filter(list(kind) OVER w, lambda x: x IS NOT NULL)[1] AS kd, bool_or(search_class <> 'N') OVER w AS unresolved, first_value(start) OVER w AS lo, last_value("end") OVER w AS hi, len(string_split_regex(string_agg(span_text, ' ') OVER w, '\\s+')) AS words
 FROM g WINDOW w AS (PARTITION BY page_number, chunk_index ORDER BY start, "end", span_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY page_number, chunk_index, t""")
def chunk_build(spark, sf):
    rich = _rich_spans(spark, sf)
    made = segments.build_chunks(rich, segments.fold_chunks(rich))
    return made.select("page_number", "chunk_index", "start", "end", F.size("span_ids").cast("long").alias("n_spans"), F.array_join("tags", ",").alias("tags"), "unresolved", F.col("words").cast("long").alias("words"), "structural_type")


@query("chunk_links", "C21", f"SELECT chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM {DUCK_CHUNKS} WINDOW w AS (PARTITION BY book_id, page_number ORDER BY chunk_index)")
def chunk_links(spark, sf):
    return segments.link_neighbours(chunks(spark, sf)).select("chunk_id", "prev_id", "next_id")


@query("neighbour_context", "K18", f"SELECT chunk_id, array_to_string(list(chunk_id) OVER (PARTITION BY page_number ORDER BY chunk_index ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), ',') AS before, array_to_string(list(chunk_id) OVER (PARTITION BY page_number ORDER BY chunk_index ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), ',') AS after FROM {DUCK_CHUNKS}".replace("array_to_string(list", "coalesce(array_to_string(list").replace("), ',') AS", "), ','), '') AS"))
def neighbour_context(spark, sf):
    made = segments.neighbour_text(chunks(spark, sf))
    join = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return made.select("chunk_id", join("before"), join("after"))


@query("previous_chunk", "K19", f"SELECT chunk_id, lag(chunk_id) OVER (PARTITION BY page_number // 10 ORDER BY page_number, chunk_index) AS prev_id FROM {DUCK_CHUNKS}")
def previous_chunk(spark, sf):
    """The chunk before across pages; ten pages in a row make a section here, so that no task holds a whole book."""
    return segments.link_neighbours(chunks(spark, sf).withColumn("book_id", F.floor(F.col("page_number") / 10)).withColumn("at", F.struct("page_number", "chunk_index")).withColumn("all", F.lit(0)), "all", "at").select("chunk_id", "prev_id")


@query("chunk_type", "C17", f"SELECT span_id, coalesce(list_filter(list_transform(tags, lambda t: {_TAG_TYPE}), lambda x: x IS NOT NULL)[1], 'narrative') AS kind FROM {DUCK_SPANS}")
def chunk_type(spark, sf):
    return spans(spark, sf).select("span_id", F.coalesce(segments.tags_type(F.col("tags")), F.lit("narrative")).alias("kind"))


@query("toc_build", "C26", """
WITH p AS (SELECT doc_id // 25 AS group_id, doc_id AS page_number, CASE WHEN doc_id % 10 = 3 THEN 'Chapter ' || doc_id END AS chapter, CASE WHEN doc_id % 3 = 0 THEN 'Section ' || doc_id END AS section FROM documents),
u AS (SELECT *, last_value(CASE WHEN chapter IS NOT NULL THEN page_number END IGNORE NULLS) OVER w AS cp, last_value(chapter IGNORE NULLS) OVER w AS under FROM p WINDOW w AS (PARTITION BY group_id ORDER BY page_number))
SELECT group_id, coalesce(cp, page_number) AS page_number, coalesce(any_value(under), any_value(section)) AS title, coalesce(string_agg(CASE WHEN under IS NOT NULL THEN section END, '|' ORDER BY u.page_number), '') AS sections
FROM u WHERE chapter IS NOT NULL OR section IS NOT NULL GROUP BY group_id, coalesce(cp, u.page_number)""")
def toc_build(spark, sf):
    n = F.col("doc_id")
    p = documents(spark, sf).select(F.floor(n / 25).alias("group_id"), n.alias("page_number"), F.when(n % 10 == 3, F.concat(F.lit("Chapter "), n.cast("string"))).alias("chapter"), F.when(n % 3 == 0, F.concat(F.lit("Section "), n.cast("string"))).alias("section"))
    return segments.contents(p).withColumn("sections", F.array_join("sections", "|"))


@query("page_metadata_rollup", "C27 I13", f"""
WITH p AS (SELECT doc_id // 10 AS group_id, doc_id AS page_number, [{DUCK['tag_of']('doc_id', 0)}, {DUCK['tag_of']('doc_id', 1)}] AS topics, [{DUCK['tag_of']('doc_id', 2)}] AS concepts, CASE WHEN doc_id % 4 <> 0 THEN 'level ' || doc_id % 3 END AS level FROM documents),
g AS (SELECT group_id, flatten(list(topics ORDER BY page_number)) AS t, flatten(list(concepts ORDER BY page_number)) AS c, list(level ORDER BY page_number) FILTER (level IS NOT NULL) AS l FROM p GROUP BY group_id)
SELECT group_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[:6], ',') AS topics, array_to_string(list_filter(c, lambda x, i: list_position(c, x) = i)[:4], ',') AS concepts, l[len(l)] AS level FROM g""")
def page_metadata_rollup(spark, sf):
    n = F.col("doc_id")
    p = documents(spark, sf).select(
        F.floor(n / 10).alias("group_id"), n.alias("page_number"), F.array(tag_of(n, 0), tag_of(n, 1)).alias("topics"), F.array(tag_of(n, 2)).alias("concepts"), F.when(n % 4 != 0, F.concat(F.lit("level "), (n % 3).cast("string"))).alias("level")
    )
    made = segments.rollup(p, 6, 4)
    return made.select("group_id", F.array_join("topics", ",").alias("topics"), F.array_join("concepts", ",").alias("concepts"), "level")


_DSL = ["1 hidden_zeros tr_phi3_conjecture citation S", "3-5 hidden_zero_identity proof r3.2 Iv", "8 d_subset_construction definition Ld Lv", "5 x_tag claim Lt", "5 x_tag Sa", "5 x_tag c5", "# note", "7", "foo bar", "2-4 a_tag b_tag p14.3 Bs"]
# what the first line of each document parses to, by its number among the ten
_PARSED = [
    (1, 1, "hidden_zeros,tr_phi3_conjecture", "citation", "", "S", None, None), (3, 5, "hidden_zero_identity", "proof", "r3.2", "I", "v", None), (8, 8, "d_subset_construction", "definition", "", "L", None, "derivation"),
    (5, 5, "x_tag", "claim", "", "L", "t", None), (5, 5, "x_tag", None, "", "S", None, None), (5, 5, "x_tag", None, "c5.0", "N", None, None), None, None, None, (2, 4, "a_tag,b_tag", None, "p14.3", "B", "s", None),
]
_VALUES = ", ".join("(" + ", ".join([str(k), *["NULL" if v is None else (str(v) if isinstance(v, int) else q(v)) for v in row]]) + ")" for k, row in enumerate(_PARSED) if row)


def _dsl(spark, sf):
    n = F.col("doc_id")
    return documents(spark, sf).select("doc_id", F.concat_ws("\n", pick(_DSL, n), F.lit("# a remark"), pick(_DSL, n * 3 + 1)).alias("lines"))


@query("dsl_parse", "C10 C11", f"""WITH v(k, start, "end", tags, role, declared, search_class, confidence, gap) AS (VALUES {_VALUES})
SELECT doc_id, start, "end", tags, role, declared, search_class, confidence, gap FROM (SELECT doc_id, doc_id % 10 AS k FROM documents UNION ALL SELECT doc_id, (doc_id * 3 + 1) % 10 FROM documents) JOIN v USING (k)""")
def dsl_parse(spark, sf):
    made = _dsl(spark, sf).select("doc_id", F.explode(segments.parse_spans(F.col("lines"))).alias("s"))
    declared = F.array_join(F.transform("s.declared", lambda d: F.concat(d["kind"], d["chunk"].cast("string"), F.lit("."), d["tag"].cast("string"))), ",")
    return made.select("doc_id", "s.start", "s.end", F.array_join("s.tags", ",").alias("tags"), "s.role", declared.alias("declared"), "s.search_class", "s.confidence", "s.gap")


_RENDERED = ["1 hidden_zeros tr_phi3_conjecture citation S", "3-5 hidden_zero_identity proof r3.2 Iv", "8 d_subset_construction definition Lv", "5 x_tag claim Lt", "5 x_tag S", "5 x_tag c5.0", None, None, None, "2-4 a_tag b_tag p14.3 Bs"]


@query("dsl_render", "K11", f"SELECT doc_id, line FROM (SELECT doc_id, [{', '.join('NULL' if r is None else q(r) for r in _RENDERED)}][k % 10 + 1] AS line FROM (SELECT doc_id, doc_id AS k FROM documents UNION ALL SELECT doc_id, doc_id * 3 + 1 FROM documents)) WHERE line IS NOT NULL")
def dsl_render(spark, sf):
    return _dsl(spark, sf).select("doc_id", F.explode(segments.parse_spans(F.col("lines"))).alias("s")).select("doc_id", segments.render_span(F.col("s")).alias("line"))


@query("enrichment_ratio", "C12", """
WITH r AS (SELECT doc_id AS page, p AS pass, ((doc_id * 7 + p * 5) % 11) / 10.0 AS ratio FROM documents, (SELECT unnest([1, 2, 3]) AS p))
SELECT page, arg_max(pass, ratio * 10 - pass * 0.001) AS pass, max(ratio) AS ratio FROM r GROUP BY page""")
def enrichment_ratio(spark, sf):
    """Of three passes over a page the one with the highest share of enriched spans stays, the earlier on a tie."""
    n = F.col("doc_id")
    tries = documents(spark, sf).select(n.alias("page"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("pass"))
    tries = tries.select("page", "pass", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("span"), ((F.col("page") * 7 + F.col("pass") * 5) % 11).alias("full"))
    hit = segments.enriched(F.when(F.col("span") <= F.col("full"), F.array(F.lit("t"))).otherwise(F.expr("cast(array() as array<string>)")), F.lit(None).cast("string"), F.expr("array()"), F.lit("N"))
    ratio = tries.groupBy("page", "pass").agg(F.coalesce(F.avg(hit.cast("int")), F.lit(1.0)).alias("ratio"))
    best = ratio.groupBy("page").agg(F.max(F.struct("ratio", (-F.col("pass")).alias("minus"))).alias("b"))
    return best.select("page", (-F.col("b.minus")).alias("pass"), F.col("b.ratio").alias("ratio"))


@query("count_sessions", "C13", "SELECT page_number, session FROM (SELECT doc_id AS page_number, ((row_number() OVER (PARTITION BY doc_id // 100 ORDER BY doc_id) - 1) // 8)::int AS session FROM documents)")
def count_sessions(spark, sf):
    return segments.sessions(documents(spark, sf).select(F.floor(F.col("doc_id") / 100).alias("book_id"), F.col("doc_id").alias("page_number"))).select("page_number", "session")


@query("group_spans", "J3", f'SELECT page_number, start, "end", count(*) AS n, array_to_string(list(span_id ORDER BY span_id), \',\') AS span_ids FROM (SELECT span_id, page_number, sentence // 3 AS start, sentence // 3 + 2 AS "end" FROM {DUCK_SPANS}) GROUP BY ALL')
def group_spans(spark, sf):
    rows = spans(spark, sf).select("span_id", "page_number", F.floor(F.col("sentence") / 3).alias("start"), (F.floor(F.col("sentence") / 3) + 2).alias("end"))
    return rows.groupBy("page_number", "start", "end").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("span_id")).cast("array<string>"), ",").alias("span_ids"))


@query("retry_merge", "C14", """WITH p AS (SELECT doc_id AS page, doc_id % 4 AS n, ((doc_id * 7 + 5) % 11) / 10.0 AS r1, ((doc_id * 7 + 10) % 11) / 10.0 AS r2, ((doc_id * 7 + 15) % 11) / 10.0 AS r3 FROM documents)
SELECT page, CASE WHEN n = 0 THEN 2 WHEN r1 < 0.5 AND r3 > r1 THEN 3 ELSE 1 END AS pass, CASE WHEN n = 0 THEN r2 WHEN r1 < 0.5 AND r3 > r1 THEN r3 ELSE r1 END AS ratio FROM p""")
def retry_merge(spark, sf):
    """Every fourth page's first pass is empty; the ratios of the three passes come by arithmetic."""
    n = F.col("doc_id")
    tries = documents(spark, sf).select(n.alias("page"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("pass"))
    tries = tries.select("page", "pass", F.when(F.col("pass") == 1, F.col("page") % 4).otherwise(5).alias("n_spans"), ((F.col("page") * 7 + F.col("pass") * 5) % 11 / 10.0).alias("ratio"))
    return segments.kept_pass(tries)
