"""Queries over sources, scopes, rendered context, repairs, sweeps and caches."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkweave.functions import text as T
from inkweave.operators import context as X
from inkweave.operators import quality as Q
from inkweave.operators import repairs as R
from inkweave.plans.catalog import query
from inkweave.plans.fixtures import DUCK, DUCK_CHUNKS, DUCK_EDGES, DUCK_SPANS, chunks, documents, duck_chain, edges, pages, q, read, spans, tag_of
from inkweave.sources.tables import stage

_CID = "page_number * 1000 + (sentence - 1) // 8"


def _flat(t: str) -> str:
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def _chunk_spans(spark, sf):
    return spans(spark, sf).withColumn("chunk_id", F.col("page_number") * 1000 + F.floor((F.col("sentence") - 1) / 8))


@query("source_pick", "C15 B20 (stand-in: pages.html)", f"""SELECT page_id, CASE WHEN t = '' THEN 'skipped' WHEN v THEN 'vision' ELSE 'raw' END AS source, md5(t) AS text_md5 FROM (SELECT page_id, v, CASE WHEN v THEN {duck_chain('h', T.HTML_TO_TEXT['spans'])} ELSE coalesce(raw, '') END AS t
 FROM (SELECT *, page_id % 3 <> 0 AND h <> '' AS v FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '' ELSE html END AS h, CASE WHEN page_id % 14 = 0 THEN NULL ELSE url || ' raw' END AS raw FROM pages)))""")
def source_pick(spark, sf):
    """Every third page isn't processed yet, every seventh has no HTML, every fourteenth no raw text either."""
    n = F.col("page_id")
    html, raw = F.when(n % 7 == 0, "").otherwise(F.col("html")), F.when(n % 14 != 0, F.concat("url", F.lit(" raw")))
    picked = pages(spark, sf).select("page_id", X.picked_source(html, raw, n % 3 != 0).alias("p"))
    return picked.select("page_id", "p.source", F.md5("p.text").alias("text_md5"))


@query("scope_resolve", "I9", """SELECT doc_id, CASE WHEN b AND p AND h THEN 'highlight' WHEN b AND p THEN 'page' WHEN b THEN 'book' WHEN c THEN 'collection' ELSE 'library' END AS scope
 FROM (SELECT doc_id, doc_id % 2 = 0 AS h, doc_id % 3 <> 0 AS b, doc_id % 5 > 0 AS p, doc_id % 7 < 3 AS c FROM documents)""")
def scope_resolve(spark, sf):
    n = F.col("doc_id")
    found = X.scope(F.when(n % 2 == 0, "x").when(n % 4 == 1, ""), F.when(n % 3 != 0, F.col("source")), n % 5, F.when(n % 7 < 3, "c"))
    return documents(spark, sf).select("doc_id", found.alias("scope"))


@query("context_assemble", "I10", """WITH RECURSIVE s AS (SELECT doc_id // 10 AS g, doc_id AS id, ceil(length(text) / 4)::bigint AS size, row_number() OVER (PARTITION BY doc_id // 10 ORDER BY doc_id % 3, doc_id) AS k FROM documents),
w AS (SELECT g, 0::bigint AS k, (200 + g % 7 * 100)::bigint AS used, ''::varchar AS taken FROM (SELECT DISTINCT g FROM s) UNION ALL SELECT s.g, s.k, CASE WHEN used + size <= 3000 THEN used + size ELSE used END, CASE WHEN used + size <= 3000 THEN taken || id || ',' ELSE taken END FROM w JOIN s ON s.g = w.g AND s.k = w.k + 1)
SELECT g AS group_id, arg_max(used, k) AS used, arg_max(taken, k) AS taken FROM w GROUP BY 1""")
def context_assemble(spark, sf):
    """Sections by priority under 3,000 tokens, of which the overview's own tokens are reserved beforehand."""
    n = F.col("doc_id")
    section = F.struct((n % 3).alias("priority"), n.alias("id"), X.token_estimate(F.col("text")).alias("size"))
    groups = documents(spark, sf).groupBy(F.floor(n / 10).alias("group_id")).agg(F.collect_list(section).alias("sections"))
    made = Q.within_greedy_budget(groups.withColumn("reserved", F.col("group_id") % 7 * 100 + 200), "sections", 3000, "reserved")
    return made.select("group_id", "used", F.array_join(F.transform("taken", lambda x: F.concat(x.cast("string"), F.lit(","))), "").alias("taken"))


# ── rendered context ──


@query("book_metadata", "I11", f"""WITH c AS MATERIALIZED (SELECT * FROM {DUCK_CHUNKS}), e AS (SELECT from_span AS span_id, string_agg('          edge → ' || relation || ' (conf=' || confidence || ') target_book_id="' || to_book || '" target_page=' || t.page_number || ' target_type=' || t.structural_type || chr(10) || '            target_quote: "' || left({_flat('t.text')}, 200) || '"', chr(10) ORDER BY edge_id) AS edges
 FROM {DUCK_EDGES} e JOIN c t ON t.chunk_id = e.to_chunk WHERE from_span IS NOT NULL GROUP BY 1),
s AS (SELECT {_CID} AS chunk_id, string_agg('      • span role=' || role || ' class=' || search_class || ' span_tags=[' || array_to_string(tags[:8], ',') || '] "' || CASE WHEN length(f) <= 120 THEN f ELSE left(f, 80) || '...' || right(f, 40) END || '"' || coalesce(chr(10) || edges, ''), chr(10) ORDER BY sentence) AS spans
 FROM (SELECT *, {_flat('span_text')} AS f FROM {DUCK_SPANS}) LEFT JOIN e USING (span_id) GROUP BY 1)
SELECT book_id, page_number, md5('  [Page ' || page_number || ']' || chr(10) || string_agg('  Chunk #' || chunk_index || ' (' || structural_type || ')' || chr(10) || '    chunk_tags: ' || array_to_string(tags[:20], ', ') || chr(10) || '    chunk_text: "' || left({_flat('text')}, 220) || CASE WHEN length(text) > 220 THEN '…' ELSE '' END || '"' || coalesce(chr(10) || spans, ''), chr(10) ORDER BY chunk_index)) AS block
 FROM c LEFT JOIN s USING (chunk_id) GROUP BY 1, 2""")
def book_metadata(spark, sf):
    """Sentences are cut and dealt by page once, and chunks, targets and spans are made where they lie; edges and numbers come
    without texts. Documents without an id have no number to meet by, and no block."""
    chunk = (F.col("page_number") * 1000 + F.floor((F.col("sentence") - 1) / 8)).alias("chunk_id")
    numbers = stage(spans(spark, sf).select("span_id", "book_id", "page_number", "sentence", chunk), "numbers")
    numbered = numbers.filter("page_number is not null")
    ids = numbered.select("book_id", "page_number", "chunk_id", F.floor((F.col("sentence") - 1) / 8).cast("int").alias("chunk_index")).distinct()
    cut = documents(spark, sf).filter("doc_id is not null").select("doc_id", "source", T.sentences(F.col("text")).alias("sentences"))
    dealt = spans(spark, sf, cut.repartition("doc_id"))
    made = X.book_metadata(chunks(spark, sf, dealt), dealt.select("*", chunk), edges(spark, sf, ids), numbered.select("span_id", "chunk_id", "page_number"))
    unnumbered = numbers.filter("page_number is null").select("book_id", "page_number", F.lit(None).cast("string").alias("block")).distinct()
    return made.unionByName(unnumbered).select("book_id", "page_number", F.md5("block").alias("block"))


def _notes(spark, sf):
    n = F.col("doc_id")
    return documents(spark, sf).select(
        n.alias("note_id"), F.col("source").alias("book_id"), (n % 30).alias("page_number"), (n * 7919 % 1000).alias("created"), F.when(n % 4 != 0, F.concat(F.lit("T"), n.cast("string"))).alias("title"),
        F.concat(F.lit("<p>"), F.substring("text", 1, 1500), F.lit("</p><br/>A &amp; B")).alias("content"), F.when(n % 3 == 0, F.substring("text", 5, 300)).alias("highlight"),
    )


def _duck_notes(body: int, quote: int) -> str:
    text = duck_chain("'<p>' || substring(text, 1, 1500) || '</p><br/>A &amp; B'", T.HTML_TO_TEXT["notes"])
    return f"""SELECT book_id, page_number, md5('    [Page ' || CASE WHEN page_number = 0 THEN '?' ELSE page_number::varchar END || ']' || chr(10) || string_agg('    • Note' || coalesce(' "' || title || '"', '') || CASE WHEN h <> '' THEN chr(10) || '        on highlight: "' || left({_flat('h')}, {quote}) || '"' ELSE '' END
 || CASE WHEN b <> '' THEN chr(10) || '        ' || replace(b, chr(10), chr(10) || '        ') ELSE '' END, chr(10) ORDER BY created, doc_id)) AS block
 FROM (SELECT doc_id, source AS book_id, doc_id % 30 AS page_number, doc_id * 7919 % 1000 AS created, CASE WHEN doc_id % 4 <> 0 THEN 'T' || doc_id END AS title, left({text}, {body}) AS b, CASE WHEN doc_id % 3 = 0 THEN substring(text, 5, 300) ELSE '' END AS h FROM documents) GROUP BY 1, 2"""


@query("note_render", "I12", _duck_notes(800, 180))
def note_render(spark, sf):
    return X.note_blocks(_notes(spark, sf)).select("book_id", "page_number", F.md5("block").alias("block"))


@query("library_notes", "I12", _duck_notes(600, 160))
def library_notes(spark, sf):
    return X.note_blocks(_notes(spark, sf), 600, 160).select("book_id", "page_number", F.md5("block").alias("block"))


def _titled(spark, sf):
    n = F.col("doc_id")
    s = n.cast("string")
    return documents(spark, sf).select(
        F.col("source").alias("book_id"), n.alias("page_number"), F.when(n % 5 == 0, F.concat(F.lit("Chapter "), s)).alias("chapter"), F.when(n % 3 == 0, F.concat(F.lit("Section "), s)).alias("section"),
        F.when(n % 11 == 0, "").otherwise(F.col("text")).alias("text"),
    )


_TITLES = "SELECT source AS book_id, doc_id AS page_number, CASE WHEN doc_id % 5 = 0 THEN 'Chapter ' || doc_id END AS chapter, CASE WHEN doc_id % 3 = 0 THEN 'Section ' || doc_id END AS section, CASE WHEN doc_id % 11 = 0 THEN '' ELSE text END AS text FROM documents"


@query("page_context", "I13", f"SELECT book_id, page_number, md5('Page ' || page_number || coalesce(' — ' || chapter, '') || coalesce(' > ' || section, '') || ':' || chr(10) || substring(text, 1, 3000)) AS context FROM ({_TITLES}) WHERE text <> '' AND page_number >= 1")
def page_context(spark, sf):
    return X.page_context(_titled(spark, sf)).select("book_id", "page_number", F.md5("context").alias("context"))


@query("chapter_list", "I13", f"SELECT book_id, page_number, '  p.' || page_number || ': ' || chapter || coalesce(' > ' || section, '') AS line FROM ({_TITLES}) WHERE chapter IS NOT NULL")
def chapter_list(spark, sf):
    return X.chapter_lines(_titled(spark, sf))


@query("page_chunk_lines", "I13", f"SELECT book_id, page_number, string_agg('[' || structural_type || '] tags: ' || array_to_string(tags, ', '), chr(10) ORDER BY chunk_index) AS context FROM {DUCK_CHUNKS} GROUP BY 1, 2")
def page_chunk_lines(spark, sf):
    return X.page_chunk_lines(chunks(spark, sf))


@query("highlight_chunk", "I13", f"""WITH c AS MATERIALIZED (SELECT * FROM {DUCK_CHUNKS}), h AS (SELECT chunk_id AS highlight_id, page_number, CASE WHEN chunk_id % 9 = 0 THEN 'nowhere at all: ' ELSE '' END || substring(text, 4, 120) AS hl FROM c WHERE chunk_id % 3 = 0)
SELECT highlight_id, arg_min(chunk_id, chunk_index) AS chunk_id FROM h JOIN c USING (page_number) WHERE contains(text, left(hl, 50)) GROUP BY 1""")
def highlight_chunk(spark, sf):
    """A highlight in every third chunk; every third of them stands nowhere."""
    c = chunks(spark, sf)
    marked = F.concat(F.when(F.col("chunk_id") % 9 == 0, "nowhere at all: ").otherwise(""), F.substring("text", 4, 120))
    h = c.filter("chunk_id % 3 = 0").select(F.col("chunk_id").alias("highlight_id"), "book_id", "page_number", marked.alias("highlight"))
    return X.highlight_chunk(h, c)


def _books(spark, sf):
    """One book for each source, with what is known of it by arithmetic on its first document."""
    b = documents(spark, sf).groupBy(F.col("source").alias("book_id")).agg(F.min("doc_id").alias("m"), F.count("*").alias("n"))
    link = lambda k: F.concat(F.lit("src"), ((F.col("m") + k) % 20).cast("string"))
    return b.select(
        "book_id", "m", F.concat(F.lit("On "), "book_id").alias("title"), F.when(F.col("m") % 3 != 0, F.concat(F.lit("A. "), "book_id")).alias("author"), F.array(*[tag_of(F.col("m"), k) for k in range(4)]).alias("concepts"),
        F.when(F.col("m") % 4 != 3, F.col("n")).alias("page_count"), F.when(F.col("m") % 5 == 2, "pending-citation").alias("status"), F.when(F.col("m") % 2 == 0, "notes").otherwise("paper").alias("kind"),
        F.array(link(1), link(3), link(3)).alias("linked_books"),
    )


_BOOKS = f"""(SELECT source AS book_id, m, 'On ' || source AS title, CASE WHEN m % 3 <> 0 THEN 'A. ' || source END AS author, [{', '.join(DUCK['tag_of']('m', k) for k in range(4))}] AS concepts, CASE WHEN m % 4 <> 3 THEN n END AS page_count,
 CASE WHEN m % 5 = 2 THEN 'pending-citation' END AS status, CASE WHEN m % 2 = 0 THEN 'notes' ELSE 'paper' END AS kind, ['src' || ((m + 1) % 20), 'src' || ((m + 3) % 20)] AS linked FROM (SELECT source, min(doc_id) AS m, count(*) AS n FROM documents GROUP BY 1))"""


@query("library_overview", "I14", f"SELECT book_id, '- id=' || book_id || ' \"' || title || '\"' || coalesce(' (' || author || ')', '') || ' [' || array_to_string(concepts[:3], ', ') || ']' AS line FROM {_BOOKS} WHERE status IS NULL")
def library_overview(spark, sf):
    return X.overview_lines(_books(spark, sf))


@query("collection_context", "I14", f"SELECT m % 3 AS collection_id, book_id, '  - id=' || book_id || ' | \"' || title || '\"' || coalesce(' by ' || author, '') || coalesce(' (' || page_count || ' pp.)', '') AS line FROM {_BOOKS}")
def collection_context(spark, sf):
    b = _books(spark, sf)
    return X.collection_lines(b.groupBy((F.col("m") % 3).alias("collection_id")).agg(F.collect_list("book_id").alias("book_ids")), b)


@query("rematch_books", "G24", f"SELECT DISTINCT book_id, l AS changed_book FROM (SELECT book_id, kind, unnest(linked) AS l FROM {_BOOKS}) WHERE kind = 'notes' AND l IN (SELECT book_id FROM {_BOOKS} WHERE m % 3 = 0)")
def rematch_books(spark, sf):
    b = _books(spark, sf)
    return X.rematch_books(b, b.filter("m % 3 = 0"))


@query("funnel_calls", "G19", f"""SELECT book_id, span_id, spent::bigint AS spent FROM (SELECT book_id, span_id, coalesce(sum(1 + span_id % 3) OVER (PARTITION BY book_id ORDER BY span_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM {DUCK_SPANS} WHERE search_class = 'S') WHERE spent < 200""")
def funnel_calls(spark, sf):
    """The spans of each book that are resolved before 200 calls are spent; a span takes one to three."""
    s = spans(spark, sf).filter("search_class = 'S'").withColumn("calls", F.col("span_id") % 3 + 1)
    return X.within_calls(s, "book_id", ["span_id"], "calls").select("book_id", "span_id", "spent")


@query("cache_reloads", "A16", """WITH RECURSIVE l AS (SELECT user_id, min(ts) AS at FROM events GROUP BY 1 UNION ALL SELECT l.user_id, min(e.ts) FROM l JOIN events e ON e.user_id = l.user_id AND e.ts >= l.at + INTERVAL 300 MINUTE GROUP BY 1)
SELECT user_id, uses, loads FROM (SELECT user_id, count(*) AS uses FROM events GROUP BY 1) JOIN (SELECT user_id, count(*) AS loads FROM l GROUP BY 1) USING (user_id)""")
def cache_reloads(spark, sf):
    """How often a cache of five hours for each user loads."""
    return X.reloads(read(spark, sf, "events"), "user_id", "ts", 300 * 60)


# ── repairs and sweeps ──


@query("repair_decompose", "K20", f"""WITH s AS (SELECT span_id, {_CID} AS chunk_id, tags, role, search_class, span_id % 6 = 0 AS v, span_id % 12 = 0 AS g FROM {DUCK_SPANS})
SELECT span_id, chunk_id, array_to_string(tags, ',') AS tags, role, search_class, CASE WHEN g THEN 'replaced' WHEN v THEN 'unrepairable' END AS status, CASE WHEN g THEN (span_id * 100 + 1) || ',' || (span_id * 100 + 2) END AS replaced_by FROM s
UNION ALL SELECT span_id * 100 + k, chunk_id, CASE WHEN k = 1 THEN tags[1] ELSE 'second' END, CASE WHEN k = 1 THEN 'claim' END, CASE WHEN k = 1 THEN 'L' ELSE 'N' END, 'repaired', NULL FROM s, (SELECT unnest([1, 2]) AS k) WHERE g""")
def repair_decompose(spark, sf):
    """Every sixth span has a verdict of three parts, one of them without tags; in every other one just one part is good."""
    s = _chunk_spans(spark, sf).select("span_id", "chunk_id", "tags", "role", "search_class")
    none = F.expr("cast(array() as array<string>)")
    part = lambda tags, role, kind: F.struct(tags.alias("tags"), F.lit(role).cast("string").alias("role"), F.lit(kind).cast("string").alias("search_class"))
    second = F.when(F.col("span_id") % 12 == 0, F.array(F.lit("second"))).otherwise(none)
    verdicts = s.filter("span_id % 6 = 0").select("span_id", F.array(part(F.array(F.col("tags")[0]), "claim", "L"), part(none, None, "S"), part(second, None, None)).alias("parts"))
    made = R.decompose(s, verdicts)
    return made.select("span_id", "chunk_id", F.array_join("tags", ",").alias("tags"), "role", "search_class", "status", F.array_join(F.col("replaced_by").cast("array<string>"), ",").alias("replaced_by"))


@query("repair_disambiguate", "K20", f"""WITH c AS MATERIALIZED (SELECT chunk_id, page_number, chunk_index, tags, chunk_id % 8 = 0 AS v FROM {DUCK_CHUNKS}), s AS (SELECT span_id, {_CID} AS chunk_id, tags, (sentence - 1) % 8 = 0 AS first FROM {DUCK_SPANS})
SELECT 'chunk' AS kind, chunk_id AS id, len(tags) + CASE WHEN v THEN 1 ELSE 0 END AS n_tags, CASE WHEN v THEN 'extra_tag' ELSE tags[-1] END AS last_tag, CASE WHEN v THEN 'repaired' END AS status FROM c
UNION ALL SELECT 'span', span_id, len(list_distinct(s.tags)) + CASE WHEN v AND first THEN 1 + CASE WHEN list_contains(s.tags, c.tags[1]) THEN 0 ELSE 1 END ELSE len(s.tags) - len(list_distinct(s.tags)) END, CASE WHEN v AND first THEN 'extra_tag' ELSE s.tags[-1] END, CASE WHEN v AND first THEN 'repaired' END FROM s JOIN c USING (chunk_id)""")
def repair_disambiguate(spark, sf):
    """Every eighth chunk gets a new tag beside one that it has; verdicts for others name none."""
    c = chunks(spark, sf)
    new = F.when(F.col("chunk_id") % 8 == 0, F.array(F.col("tags")[0], F.lit("extra_tag"))).otherwise(F.expr("cast(array() as array<string>)"))
    a, b = R.disambiguate(c, _chunk_spans(spark, sf), c.filter("chunk_id % 4 = 0").select("chunk_id", new.alias("new_tags")))
    shown = lambda df, kind, id_: df.select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.size("tags").cast("long").alias("n_tags"), F.element_at("tags", -1).alias("last_tag"), "status")
    return shown(a, "chunk", "chunk_id").unionByName(shown(b, "span", "span_id"))


@query("repair_retag", "K20", f"""SELECT span_id, array_to_string(list_sort(CASE WHEN v THEN list_distinct(list_concat(tags, CASE WHEN first THEN ['aa', 'plain_note', 'bb'] ELSE ['bb'] END)) ELSE tags END), ',') AS tags, CASE WHEN v THEN 'proof' ELSE role END AS role, CASE WHEN v THEN 'L' ELSE search_class END AS search_class, CASE WHEN v THEN 'repaired' END AS status
 FROM (SELECT *, ({_CID}) % 5 = 0 AS v, (sentence - 1) % 8 = 0 AS first FROM {DUCK_SPANS})""")
def repair_retag(spark, sf):
    """Every fifth chunk has verdicts: one for the range of its first span, one for a range that no span has, an empty one."""
    s = _chunk_spans(spark, sf).withColumn("start", F.col("sentence")).withColumn("end", F.col("sentence"))
    verdict = lambda place, at, tags, role, kind: F.struct(F.lit(place).alias("place"), at.alias("start"), at.alias("end"), tags.alias("tags"), F.lit(role).cast("string").alias("role"), F.lit(kind).alias("search_class"))
    tags = lambda *names: F.array(*[F.lit(n) for n in names]) if names else F.expr("cast(array() as array<string>)")
    every = F.array(verdict(1, F.col("start"), tags("aa", "plain_note"), None, "N"), verdict(2, F.lit(-1), tags("bb"), "proof", "L"), verdict(3, F.lit(-1), tags(), "claim", "S"))
    verdicts = chunks(spark, sf).filter("chunk_id % 5 = 0").select("chunk_id", F.explode(every).alias("v")).select("chunk_id", "v.*")
    made = R.retag(s, verdicts)
    return made.select("span_id", F.array_join(F.array_sort("tags"), ",").alias("tags"), "role", "search_class", "status")


_SWEEP = f"""(SELECT *, row_number() OVER w AS place, coalesce(sum(cost) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM (SELECT book_id, chunk_id, ['p1', 'p2', 'p3'][chunk_id % 3 + 1] AS kind, chunk_id % 50 AS cost, ['repaired', 'review', 'error', 'repaired'][chunk_id % 4 + 1] AS outcome FROM {DUCK_CHUNKS})
 WINDOW w AS (PARTITION BY book_id ORDER BY CASE kind WHEN 'p2' THEN 1 WHEN 'p1' THEN 2 ELSE 3 END, chunk_id))"""


def _sweep(spark, sf):
    n = F.col("chunk_id")
    kind = F.element_at(F.array(F.lit("p1"), F.lit("p2"), F.lit("p3")), (n % 3 + 1).cast("int"))
    outcome = F.element_at(F.array(*[F.lit(x) for x in ("repaired", "review", "error", "repaired")]), (n % 4 + 1).cast("int"))
    return R.sweep(chunks(spark, sf).select("book_id", "chunk_id", kind.alias("kind"), (n % 50).alias("cost"), outcome.alias("outcome")), 2000)


@query("sweep_order", "K22", f"SELECT book_id, chunk_id, kind, place::int AS place, spent::bigint AS spent, ((place - 1) // 5 + 1)::bigint AS flush FROM {_SWEEP} WHERE spent < 2000")
def sweep_order(spark, sf):
    return _sweep(spark, sf).select("book_id", "chunk_id", "kind", "place", "spent", "flush")


@query("sweep_counts", "K22", f"SELECT book_id, kind, outcome, count(*) AS n, sum(cost)::bigint AS cost FROM {_SWEEP} WHERE spent < 2000 GROUP BY 1, 2, 3")
def sweep_counts(spark, sf):
    return R.sweep_counts(_sweep(spark, sf))


@query("audit_report", "A14", f"""WITH a AS (SELECT relation, count(*) AS n, count(*) FILTER (confidence >= 's') AS high FROM {DUCK_EDGES} GROUP BY 1) SELECT 0 AS at, '# Edges' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, '| relation | n | high |' UNION ALL SELECT 3, '| --- | --- | --- |'
 UNION ALL SELECT 3 + row_number() OVER (ORDER BY relation), '| ' || relation || ' | ' || n || ' | ' || high || ' |' FROM a""")
def audit_report(spark, sf):
    """A Markdown report of edges by relation, as lines."""
    from inkweave.operators import ingest

    a = edges(spark, sf).groupBy("relation").agg(F.count("*").alias("n"), F.sum((F.col("confidence") >= "s").cast("int")).alias("high"))
    return ingest.markdown_lines(a, "Edges", ["relation"])
